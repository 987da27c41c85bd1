"""Distribution and game-view aggregates: A5, A6, A7, A8, A16, A17, A18, A24.

``percentile`` is exact (linear interpolation, numpy's default) and is a
partial aggregate holding a value->count map per group; weekly points are
small integers, so the map stays small even for a huge league.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squadron.functions.dims import bounded_broadcast
from squadron.functions.lists import season_half
from squadron.operators.picks import G


def basic_stats(df: DataFrame, keys, value: str = "total_points") -> DataFrame:
    """A5: Q1, mean and Q3 of ``value`` per group."""
    return df.groupBy(*keys).agg(
        F.percentile(value, 0.25).alias("q1"),
        F.avg(value).alias("average"),
        F.percentile(value, 0.75).alias("q3"))


def outliers(ws: DataFrame, participants: DataFrame, rule: str = "max") -> DataFrame:
    """A6, every row (Q10): ``exceptional`` = at the week's maximum (rule
    ``max``) or above Q3 + 1.5 IQR (rule ``iqr``); ``abysmal`` = below
    Q1 - 1.5 IQR.  Each row carries the league average."""
    quarters = F.percentile("total_points", [0.25, 0.75])
    st = ws.groupBy(*G).agg(quarters.alias("q"), F.avg("total_points").alias("average"),
                            F.max("total_points").alias("max_points"))
    j = ws.join(st.select(*G, "average", "max_points", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"),
                          (F.col("q")[1] - F.col("q")[0]).alias("iqr")), G)
    if rule == "max":
        high = F.col("total_points") == F.col("max_points")
    elif rule == "iqr":
        high = F.col("total_points") > F.col("q3") + 1.5 * F.col("iqr")
    else:
        raise ValueError(f"rule must be 'max' or 'iqr', got {rule!r}")
    low = F.col("total_points") < F.col("q1") - 1.5 * F.col("iqr")
    kind = F.explode(F.array(F.when(high, F.lit("exceptional")), F.when(low, F.lit("abysmal"))))
    names = participants.select("league_id", F.col("entry").alias("entry_id"),
                                F.col("entry_name").alias("team_name"))
    return (j.select(*G, "entry_id", "total_points", "average", kind.alias("kind"))
            .where(F.col("kind").isNotNull())
            .join(names, ["league_id", "entry_id"], "left")
            .select(*G, "kind", "entry_id", "team_name", F.col("total_points").alias("score"),
                    F.col("average").alias("league_average")))


def outliers_reported(ws: DataFrame, participants: DataFrame) -> DataFrame:
    """A6 as the report shows it (Q10): one row per (league, week) with the
    last tied maximum (largest entry id), the lowest abysmal score (largest
    entry id on ties) and the league average."""
    o = outliers(ws, participants, "max")
    hi = F.max(F.when(F.col("kind") == "exceptional", F.struct("entry_id", "team_name", "score")))
    lo = F.max(F.when(F.col("kind") == "abysmal",
                      F.struct((-F.col("score")).alias("neg"), "entry_id", "team_name")))
    r = o.groupBy(*G).agg(hi.alias("hi"), lo.alias("lo"), F.max("league_average").alias("league_average"))
    return r.select(*G,
                    F.col("hi.entry_id").alias("exceptional_entry"), F.col("hi.team_name").alias("exceptional_team"),
                    F.col("hi.score").alias("exceptional_score"),
                    F.col("lo.entry_id").alias("abysmal_entry"), F.col("lo.team_name").alias("abysmal_team"),
                    (-F.col("lo.neg")).alias("abysmal_score"), "league_average")


def stats_with_dims(score: DataFrame, player: DataFrame) -> DataFrame:
    """J4 (Q9 fixed): each score row with the player's team and position for
    that season half.  Joined on (player_id, half) so rows never double."""
    dims = player.select("player_id", "half", "team", "position")
    return (score.withColumn("half", season_half("gameweek"))
            .join(dims, ["player_id", "half"], "left").drop("half"))


def gameview(stats: DataFrame, keys=("gameweek", "position")) -> DataFrame:
    """Sums of goals, points and assists by any key set (typed numbers,
    Q14 fixed)."""
    return stats.groupBy(*keys).agg(
        F.sum("goals_scored").alias("goals_scored"),
        F.sum("total_points").alias("total_points"),
        F.sum("assists").alias("assists"))


GAMEVIEW_SETS = [("gameweek", "position"), ("gameweek", "team"), ("position", "team"),
                 ("gameweek",), ("position",), ("team",)]


def gameview_grouping_sets(stats: DataFrame, sets=GAMEVIEW_SETS) -> DataFrame:
    """Every requested key set in one pass with GROUPING SETS (one scan,
    one shuffle); ``level`` is grouping_id(gameweek, position, team)."""
    keys = ["gameweek", "position", "team"]
    return stats.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        F.grouping_id(*keys).alias("level"),
        F.sum("goals_scored").alias("goals_scored"),
        F.sum("total_points").alias("total_points"),
        F.sum("assists").alias("assists"))


def gameview_ict(stats: DataFrame) -> DataFrame:
    """Sums and maxima of creativity, influence and threat by
    (gameweek, position).  Decimal sums are exact."""
    aggs = []
    for c in ("creativity", "influence", "threat"):
        aggs += [F.sum(c).cast("double").alias(f"{c}_sum"), F.max(c).cast("double").alias(f"{c}_max")]
    return stats.groupBy("gameweek", "position").agg(*aggs)


def stat_totals(score: DataFrame, keys=("gameweek",)) -> DataFrame:
    """Totals of every numeric column of the frame but its ids (per
    gameweek by default; ``keys=()`` for the season)."""
    ids = {"player_id", "gameweek", *keys}
    return score.groupBy(*keys).agg(*[
        (F.sum(f.name).cast("double") if isinstance(f.dataType, T.DecimalType) else F.sum(f.name)).alias(f.name)
        for f in score.schema if isinstance(f.dataType, T.NumericType) and f.name not in ids])


def fixture_results(fixture: DataFrame, team: DataFrame, code_base: int = 2444470) -> DataFrame:
    """Fixtures with team names, code re-based to the
    fixture number, and 0/1 home-win / draw / away-win flags (unplayed
    fixtures give 0, 0, 0 -- Q20).  The team dimension (20 rows) is broadcast
    after a size check."""
    names = bounded_broadcast(team.select("id", "name"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    hg, ag = F.col("homegoals"), F.col("awaygoals")
    return (fixture
            .join(names.withColumnsRenamed({"id": "home", "name": "home_name"}), "home", "left")
            .join(names.withColumnsRenamed({"id": "away", "name": "away_name"}), "away", "left")
            .select("homedifficulty", "awaydifficulty",
                    F.col("home_name").alias("home"), F.col("away_name").alias("away"),
                    "homegoals", "awaygoals", (F.col("code") - F.lit(code_base)).alias("fixtures"),
                    "gameweek", "finished", "date",
                    flag(hg > ag).alias("homewin"), flag(hg == ag).alias("draw"),
                    flag(hg < ag).alias("awaywin")))


def difficulty_outcomes(results: DataFrame) -> DataFrame:
    """Outcome counts by (home difficulty, away difficulty)."""
    return results.groupBy("homedifficulty", "awaydifficulty").agg(
        F.sum("homewin").alias("homewin"), F.sum("draw").alias("draw"), F.sum("awaywin").alias("awaywin"))


def season_extremes(standings: DataFrame) -> DataFrame:
    """Per entry the best and worst week by points and by rank.  Ties
    go to the earliest week.  ``min(struct)`` is a partial aggregate."""
    def first(v: Column):
        return F.min(F.struct(v.alias("v"), F.col("gw").alias("gw")))
    s = standings.groupBy("league_id", "entry").agg(
        first(-F.col("event_total")).alias("hi"), first(F.col("event_total")).alias("lo"),
        first(F.col("rank")).alias("best"), first(-F.col("rank")).alias("worst"))
    return s.select(
        "league_id", F.col("entry").alias("entry_id"),
        F.col("hi.gw").alias("highest_gw"), (-F.col("hi.v")).alias("highest_points"),
        F.col("lo.gw").alias("lowest_gw"), F.col("lo.v").alias("lowest_points"),
        F.col("best.gw").alias("best_rank_gw"), F.col("best.v").alias("best_rank"),
        F.col("worst.gw").alias("worst_rank_gw"), (-F.col("worst.v")).alias("worst_rank"))


def season_extreme_weeks(history: DataFrame) -> DataFrame:
    """A24 by overall rank: every week at which an entry has its highest or
    lowest points, or its best or worst overall rank (ties: all of them).  The
    windows hold one entry's season."""
    season = Window.partitionBy("entry_id")
    ends = [("highest_points", "points", F.max), ("lowest_points", "points", F.min),
            ("best_rank", "overall_rank", F.min), ("worst_rank", "overall_rank", F.max)]
    weeks = history.select("entry_id", "gameweek", "points", "overall_rank").distinct()
    kinds = F.array(*[F.when(F.col(c) == end(c).over(season), F.struct(F.lit(kind).alias("kind"), F.col(c).cast(
        "bigint").alias("value"))) for kind, c, end in ends])
    return (weeks.select("entry_id", "gameweek", kinds.alias("kinds"))
            .select("entry_id", "gameweek", F.explode("kinds").alias("k")).where("k is not null")
            .select("entry_id", "gameweek", "k.kind", "k.value"))
