"""The running sum of position_rank has two levels."""

import random
import re

from pyspark.sql import Window, functions as F

from squadron.operators.ranking import position_rank


def test_no_window_orders_scores_and_buckets(spark):
    r = random.Random(7)
    df = spark.createDataFrame([(k % 2, r.randint(0, 5), k) for k in range(600)], "g int, score int, entry bigint")
    ranked = position_rank(df, ["g"], "score", "entry", out="r", bucket_size=8)
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.col("score").desc(), "entry")))
    assert sorted(map(tuple, ranked.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    specs = re.findall(r"windowspecdefinition\((.*?specifiedwindowframe)", plan)
    assert specs and not any("DESC" in s and "__bucket" in s for s in specs)
