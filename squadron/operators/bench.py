"""Bench and automatic substitutions: A9, A12, T5, T6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.operators.picks import G, lookup_points
from squadron.operators.ranking import top_k


def _names(participants: DataFrame) -> DataFrame:
    return participants.select("league_id", F.col("entry").alias("entry_id"),
                               F.col("entry_name").alias("team_name"))


def auto_sub_points(auto_sub: DataFrame, score: DataFrame) -> DataFrame:
    """A12 (Q5 fixed: every non-blank sub counts): per (entry, week) the
    players subbed in and out (ascending ids) and their points."""
    s = lookup_points(auto_sub, score, out="points")
    is_in = F.col("direction") == "in"
    return s.groupBy("entry_id", F.col("gw").alias("gameweek")).agg(
        F.array_sort(F.collect_list(F.when(is_in, F.col("player_id")))).alias("auto_sub_in"),
        F.array_sort(F.collect_list(F.when(~is_in, F.col("player_id")))).alias("auto_sub_out"),
        F.coalesce(F.sum(F.when(is_in, F.col("points"))), F.lit(0)).cast("int").alias("auto_sub_in_points"),
        F.coalesce(F.sum(F.when(~is_in, F.col("points"))), F.lit(0)).cast("int").alias("auto_sub_out_points"))


def jammy_points(j1: DataFrame, auto_sub: DataFrame, score: DataFrame,
                 participants: DataFrame, k: int = 3) -> DataFrame:
    """T5: the ``k`` largest auto-sub gains per (league, week) over J1's
    rows; rows without subs count 0.  Ties by entry id."""
    a = auto_sub_points(auto_sub, score)
    j = (j1.select(*G, "entry_id").join(a, ["entry_id", "gameweek"], "left")
         .withColumn("auto_sub_in_points", F.coalesce("auto_sub_in_points", F.lit(0))))
    top = top_k(j, G, [F.col("auto_sub_in_points").desc(), F.col("entry_id").asc()], k)
    empty = F.array().cast("array<bigint>")
    return (top.join(_names(participants), ["league_id", "entry_id"], "left")
            .select(*G, "k", "entry_id", "team_name",
                    F.coalesce("auto_sub_in", empty).alias("sub_in"),
                    F.coalesce("auto_sub_out", empty).alias("sub_out"),
                    F.col("auto_sub_in_points").alias("points")))


def most_points_on_bench(j1: DataFrame, pick: DataFrame, participants: DataFrame,
                         k: int = 3) -> DataFrame:
    """The ``k`` entries per (league, week) with most points on the
    bench (unknown last, ties by entry id), with their bench players in
    squad order.  Lists are built for the k winners only."""
    top = top_k(j1.select(*G, "entry_id", "points_on_bench"), G,
                [F.col("points_on_bench").desc_nulls_last(), F.col("entry_id").asc()], k)
    bench = pick.where(F.col("multiplier") == 0).select(
        "entry_id", F.col("gw").alias("gameweek"), "position", "player_id")
    lists = (top.join(bench, ["entry_id", "gameweek"], "left")
             .groupBy(*G, "k", "entry_id", "points_on_bench")
             .agg(F.array_sort(F.collect_list(F.when(F.col("player_id").isNotNull(),
                                                     F.struct("position", "player_id")))).alias("__b")))
    return (lists.join(_names(participants), ["league_id", "entry_id"], "left")
            .select(*G, "k", "entry_id", "team_name",
                    F.transform("__b", lambda s: s["player_id"]).alias("players"),
                    F.col("points_on_bench").alias("point_on_bench")))


def most_benched(j1: DataFrame, pick: DataFrame, score: DataFrame) -> DataFrame:
    """Per (league, week) and player, how many of J1's entries benched
    the player, and the player's points that week."""
    bench = pick.where(F.col("multiplier") == 0).select(
        "entry_id", F.col("gw").alias("gameweek"), "player_id")
    counts = (j1.select(*G, "entry_id").join(bench, ["entry_id", "gameweek"], "inner")
              .groupBy(*G, "player_id").agg(F.count(F.lit(1)).alias("count")))
    return lookup_points(counts, score, gw_col="gameweek", out="points")
