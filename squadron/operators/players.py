"""Player lookups and leaders: J7, J8, F9, F12, F13, T7, S9, S10, S11."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.lists import season_half
from squadron.operators.ranking import top_k


def player_payload(score: DataFrame, player: DataFrame, nested: bool = False, ids=None,
                   gameweek=None) -> DataFrame:
    """Per (player, gameweek) the player's info for that season
    half and the week's score, optionally of the listed ``ids`` and one
    ``gameweek``.  ``nested`` returns the API shape
    ``{id, info: struct, gameweekScore: struct}`` with every score column."""
    score = player_week_score(score, gameweek=gameweek)
    if ids is not None:
        score = score.where(F.col("player_id").isin(list(ids)))
    info = player.select("player_id", "half", "player_name", "team", "position")
    j = (score.withColumn("half", season_half("gameweek"))
         .join(info, ["player_id", "half"], "inner"))
    if not nested:
        return j
    fields = [c for c in score.columns if c not in ("player_id", "gameweek")]
    return j.select(
        F.col("player_id").alias("id"), "gameweek",
        F.struct("player_name", "team", "position", "half").alias("info"),
        F.struct(*fields).alias("gameweekScore"))


def player_by_half(player: DataFrame, player_id=None, half=None) -> DataFrame:
    """player rows, optionally for one player and/or half."""
    p = player
    if player_id is not None:
        p = p.where(F.col("player_id") == player_id)
    if half is not None:
        p = p.where(F.col("half") == half)
    return p


def player_week_score(score: DataFrame, player_id=None, gameweek=None) -> DataFrame:
    """Score rows filtered by player and/or gameweek (the
    filters reach the scan; partition pruning when stored by gameweek)."""
    s = score
    if player_id is not None:
        s = s.where(F.col("player_id") == player_id)
    if gameweek is not None:
        s = s.where(F.col("gameweek") == gameweek)
    return s


def points_by_gameweek(score: DataFrame, gameweek=None) -> DataFrame:
    """The two columns the weekly report needs."""
    return player_week_score(score, gameweek=gameweek).select("player_id", "gameweek", "total_points")


def season_stats(score: DataFrame) -> DataFrame:
    """The whole season, latest gameweek first (sorted only at output)."""
    return score.orderBy(F.col("gameweek").desc(), F.col("player_id"))


def squad_names(pick: DataFrame, player: DataFrame) -> DataFrame:
    """Per (entry, week) the starters' names in squad order; names come
    from the player row for that season half."""
    names = player.select("player_id", "half", "player_name")
    p = (pick.where(F.col("multiplier") > 0)
         .withColumn("half", season_half("gw"))
         .join(names, ["player_id", "half"], "left"))
    return p.groupBy("entry_id", F.col("gw").alias("gameweek")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "player_name"))),
                    lambda s: s["player_name"]).alias("player_names"))


def dream_team(score: DataFrame, player: DataFrame) -> DataFrame:
    """the week's dream-team members with their names and teams."""
    d = score.where(F.col("in_dreamteam")).select("player_id", "gameweek", "total_points")
    return player_payload(d, player).select("gameweek", "player_id", "player_name", "team",
                                            "total_points")


LEADER_METRICS = ["total_points", "expected_goals", "expected_goals_conceded", "expected_assists"]


def gameweek_leaders(score: DataFrame, player: DataFrame, metrics=LEADER_METRICS) -> DataFrame:
    """T7 (Q15 fixed: decimals sort as numbers): per gameweek and metric the
    top player (ties by player id).  The metrics are stacked long first and
    reduced to the first player of each value, so one top-1 window (a
    WindowGroupLimit) over that small table serves all of them."""
    stack = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    long_ = score.select("player_id", "gameweek", stack.alias("m")).select(
        "player_id", "gameweek", "m.metric", "m.value")
    # The first player of each value (no id before any id): a small table, so no row is sorted.
    first = F.when(F.bool_or(F.col("player_id").isNull()), F.lit(None)).otherwise(F.min("player_id"))
    values = long_.groupBy("gameweek", "metric", "value").agg(first.alias("player_id"))
    top = top_k(values, ["gameweek", "metric"], [F.col("value").desc(), F.col("player_id")], 1)
    info = player.select("player_id", "half", "player_name", "team")
    return (top.withColumn("half", season_half("gameweek"))
            .join(info, ["player_id", "half"], "left")
            .select("gameweek", "metric", "player_id", "value", "player_name", "team"))
