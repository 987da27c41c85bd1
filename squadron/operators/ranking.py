"""Ranking and per-group top-k (W1, W2, W3, T1, T2 and the generic top-k).

Groups here are ``(league_id, gameweek)``; one public league can hold a
third of all entries, so a plain ``row_number() over (partition by G)`` would
sort that league in one task.  ``position_rank`` and ``average_rank`` instead
rank through small count tables:

* count rows per (G, score, id-bucket) -- a partial (map-side) aggregate;
* a running sum over the distinct scores of G, then one over the buckets of a
  (G, score), gives each bucket its offset;
* a window over (G, score, id-bucket) numbers rows inside one bucket, whose
  size is bounded by ``bucket_size`` whatever the league size.

The result equals ``row_number() over (partition by G order by score desc,
id asc)`` exactly.  Top-k uses ``row_number() <= k``, which Spark plans as a
``WindowGroupLimit`` that keeps at most k rows per group before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 1 << 16


def _cols(keys):
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def position_rank(df: DataFrame, keys: Sequence[str], score: str, id_col: str,
                  out: str = "rank", bucket_size: int = DEFAULT_BUCKET,
                  stage: bool = False) -> DataFrame:
    """1-based position by ``score`` desc then ``id_col`` asc within ``keys``.

    The input is read twice (count table, then numbering).  For an
    expensive derived input pass ``stage=True``: it is written once as a
    stage table in the shared checkpoint folder and both passes read that."""
    keys = list(keys)
    if stage:
        from squadron.session import stage_table
        df = stage_table(df, "rank_input")
    b = "__bucket"
    with_b = df.withColumn(b, F.floor(F.col(id_col) / F.lit(bucket_size)))
    counts = with_b.groupBy(*keys, score, b).agg(F.count(F.lit(1)).alias("__n"))
    # Two levels: over the distinct scores of a group, then over the buckets of a score.
    higher = (Window.partitionBy(*keys).orderBy(F.col(score).desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    above = (counts.groupBy(*keys, score).agg(F.sum("__n").alias("__n"))
             .select(*keys, score, F.coalesce(F.sum("__n").over(higher), F.lit(0)).alias("__above")))
    before = (Window.partitionBy(*keys, score).orderBy(F.col(b).asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (counts.select(*keys, score, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
               .join(above, [*keys, score], "inner")
               .select(*keys, score, b, (F.col("__above") + F.col("__before")).alias("__off")))
    # The numbering comes first: its order by id also serves the merge with the
    # offsets, and the rows stay in that order.
    inner = Window.partitionBy(*keys, score, b).orderBy(F.col(id_col).asc())
    numbered = with_b.withColumn("__nth", F.row_number().over(inner))
    ranked = (numbered.join(offsets.hint("merge"), [*keys, score, b], "inner")
              .withColumn(out, (F.col("__off") + F.col("__nth")).cast("int")))
    return ranked.drop(b, "__off", "__nth")


def average_rank(df: DataFrame, keys: Sequence[str], score: str,
                 out: str = "rank") -> DataFrame:
    """Rank with ties averaged and truncated to int:
    ``floor(min_rank + (ties - 1) / 2)``, min_rank = 1 + number of higher scores."""
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("__ties"))
    higher = (Window.partitionBy(*keys).orderBy(F.col(score).desc())
              .rowsBetween(Window.unboundedPreceding, -1))
    table = counts.select(
        *keys, score,
        F.floor(F.coalesce(F.sum("__ties").over(higher), F.lit(0)) + 1
                + (F.col("__ties") - 1) / 2).cast("int").alias(out))
    return df.join(table, [*keys, score], "inner")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          out: str = "k") -> DataFrame:
    """Keep the first ``k`` rows per group in ``order`` and number them 1..k."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k).withColumn(
        out, F.col(out).cast("int"))


def rank_change(standings: DataFrame) -> DataFrame:
    """rank_delta = last_rank - rank (positive means the entry rose)."""
    return standings.withColumn("rank_delta", (F.col("last_rank") - F.col("rank")).cast("int"))


def rank_movers(standings: DataFrame, direction: str = "rise", k: int = 3) -> DataFrame:
    """Top ``k`` risers (positive change, largest first) or fallers
    (negative change, most negative first) per (league, week); ties by entry."""
    s = rank_change(standings)
    if direction == "rise":
        s, order = s.where(F.col("rank_delta") > 0), [F.col("rank_delta").desc(), F.col("entry")]
    else:
        s, order = s.where(F.col("rank_delta") < 0), [F.col("rank_delta").asc(), F.col("entry")]
    return top_k(s, ["league_id", "gw"], order, k).select(
        "league_id", F.col("gw").alias("gameweek"), "k", F.col("entry").alias("entry_id"),
        F.col("rank").alias("current_rank"), F.col("last_rank").alias("prev_rank"),
        "rank_delta", F.col("player_name").alias("participant_name"))
