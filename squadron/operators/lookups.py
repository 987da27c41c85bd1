"""Gameweek and league lookups: F6, F10, F11, A13, A14, A15, S13."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.lists import valid_gameweek


def chip_plays(entry: DataFrame) -> DataFrame:
    """how often each chip was played, one row per (gameweek, chip)."""
    return (entry.where(F.col("active_chip").isNotNull())
            .groupBy(F.col("gw").alias("gameweek"), F.col("active_chip").alias("chip"))
            .agg(F.count(F.lit(1)).alias("plays")))


def gameweek_status(entry: DataFrame, current=None) -> DataFrame:
    """F10 / F11 derived from the weekly entries: ``current`` (an int or a
    Column; by default the latest week) is current, earlier weeks are finished
    (and data-checked), later ones not yet played; each week's chip plays
    (``chip:plays``, by chip), highest-scoring entry (ties: lowest id) and floor
    of the mean entry score.  Status text: current / not yet played / summary."""
    per = entry.groupBy(F.col("gw").alias("gameweek")).agg(
        F.min(F.struct((-F.col("total_points")).alias("neg"), F.col("entry_id"))).alias("__hi"),
        F.floor(F.sum("total_points") / F.count("total_points")).cast("int").alias("average_entry_score"))
    # A week has as many items as there are kinds of chips.
    chips = chip_plays(entry).groupBy("gameweek").agg(
        F.array_sort(F.collect_list(F.struct("chip", "plays"))).alias("__chips"))
    if current is None:
        current = entry.select(F.max("gw")).scalar()
    is_current = F.col("gameweek") == current
    finished = F.col("gameweek") < current
    text = F.transform("__chips", lambda x: F.concat_ws(":", x["chip"], x["plays"].cast("string")))
    return per.join(chips, "gameweek", "left").select(
        "gameweek", is_current.alias("is_current"), finished.alias("finished"),
        finished.alias("data_checked"),
        F.when(is_current, "current").when(~finished, "not yet played").otherwise("summary").alias("status"),
        F.coalesce(text, F.array().cast("array<string>")).alias("chip_plays"),
        F.col("__hi.entry_id").alias("highest_scoring_entry"),
        (-F.col("__hi.neg")).alias("highest_score"),
        "average_entry_score")


def current_gameweek(status: DataFrame) -> DataFrame:
    """(gameweek, finished, data_checked) of the current week."""
    return status.where(F.col("is_current")).select("gameweek", "finished", "data_checked")


def valid_gameweeks(*weeks: DataFrame) -> DataFrame:
    """F6 over data: every distinct week seen in the given single-column
    frames, flagged valid when it is in 1..38."""
    u = None
    for w in weeks:
        w = w.select(w.columns[0]).toDF("gameweek")
        u = w if u is None else u.unionByName(w)
    return u.distinct().select("gameweek", valid_gameweek("gameweek").alias("valid"))


def gameweek_row_counts(score: DataFrame) -> DataFrame:
    """Rows stored per gameweek."""
    return score.groupBy("gameweek").agg(F.count(F.lit(1)).alias("rows"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct gameweeks / teams."""
    return df.select(column).distinct()


def league_count(league: DataFrame) -> DataFrame:
    """Entries per league."""
    return league.groupBy("league_id", "league_name").agg(F.count(F.lit(1)).alias("n_entries"))


def league_entry_ids(league: DataFrame) -> DataFrame:
    """Each league's entry ids with the league's size.  The size comes
    from a partial aggregate joined back, not a window over one league."""
    return league.select("league_id", "entry").join(
        league_count(league).select("league_id", "n_entries"), "league_id")
