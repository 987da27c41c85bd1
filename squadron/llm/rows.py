"""Arrow annotation of whole rows.

``annotate`` sends each input row through a task as one struct and adds result
columns beside it, so an operator keeps every column of its input, whatever
its name, without a join back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from squadron.llm import textkit as T


def annotate(df: DataFrame, text_col: str, fields: str, work: Callable[[], Callable[[pa.Array], list[pa.Array]]],
             limit: int = T.PIECE_BYTES) -> DataFrame:
    """Columns ``row`` (the input row) and those of ``fields`` (DDL), which
    ``work()`` (called once a task) returns for each slice of at most ``limit``
    bytes of texts."""
    whole = S.StructType([S.StructField("row", df.schema, False), *S.StructType.fromDDL(fields)])
    at = df.columns.index(text_col)
    names = [f.name for f in whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = work()

        def flat() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row = batch.column(0)
                yield pa.RecordBatch.from_arrays([row, row.field(at).cast(pa.large_string())], ["row", "text"])

        for part in T.pieces(flat(), "text", limit):
            yield pa.RecordBatch.from_arrays([part.column("row"), *judge(part.column("text"))], names)
            pa.default_memory_pool().release_unused()  # else a worker keeps its largest slice's memory

    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row")).mapInArrow(run, whole)
