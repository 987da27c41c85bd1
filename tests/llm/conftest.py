import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from squadron.session import local_session

    return local_session(cpus=4, shuffle_partitions=4, app="squadron-llm-tests")


@pytest.fixture
def docs(spark):
    """A table builder: rows of (doc_id, text), with columns whose names clash
    with those that the operators make."""
    def make(rows):
        schema = "doc_id bigint, text string, row string, score double, n bigint, component string"
        return spark.createDataFrame([(i, t, "r", 0.5, 7, "c") for i, t in rows], schema)

    return make
