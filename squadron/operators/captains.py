"""Captain operators: A1, A21, J6, A22."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.operators.picks import G


def captain_counts(ws: DataFrame) -> DataFrame:
    """A1: how many entries captained each player, per (league, week);
    entries without a captain are dropped (Q13)."""
    return (ws.where(F.col("captain").isNotNull())
            .groupBy(*G, "captain").agg(F.count(F.lit(1)).alias("count")))


def captain_counts_points(ws: DataFrame, score: DataFrame) -> DataFrame:
    """Captain counts with the captain's points (x2)."""
    pts = score.select(F.col("player_id").alias("captain"), F.col("gameweek"),
                       (F.col("total_points") * 2).alias("points"))
    return (captain_counts(ws).join(pts, ["captain", "gameweek"], "left")
            .withColumn("points", F.coalesce("points", F.lit(0)).cast("int")))


def captain_minutes(ws: DataFrame, score: DataFrame) -> DataFrame:
    """The captain's minutes that week; no captain or no score row -> 0."""
    mins = score.select(F.col("player_id").alias("captain"), "gameweek",
                        F.col("minutes").alias("cap_minutes"))
    return (ws.join(mins, ["captain", "gameweek"], "left")
            .withColumn("cap_minutes", F.coalesce("cap_minutes", F.lit(0)).cast("int")))


def promoted_vice(ws: DataFrame, score: DataFrame) -> DataFrame:
    """A22 (inferred from saved reports): vice-captains who stood in for a
    captain with 0 minutes: per (league, week, vice) the count and the vice's
    points doubled."""
    cm = captain_minutes(ws, score).where(
        (F.col("cap_minutes") == 0) & F.col("vice_captain").isNotNull())
    pts = score.select(F.col("player_id").alias("vice_captain"), "gameweek",
                       (F.col("total_points") * 2).alias("points"))
    return (cm.groupBy(*G, "vice_captain").agg(F.count(F.lit(1)).alias("count"))
            .join(pts, ["vice_captain", "gameweek"], "left")
            .withColumn("points", F.coalesce("points", F.lit(0)).cast("int")))
