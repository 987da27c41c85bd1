"""Squads and weekly scores: F4, J2, J3, W1, W2, W4, S5.

Squads are held long (one row per entry, week and player).  Points are looked
up with one equi-join on (player_id, gameweek) -- the reference's per-row
dictionary lookups and N+1 queries -- and lists are only assembled at the end,
over groups bounded by the squad size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.lists import first_argmax, ids_csv, ordered_ids
from squadron.operators.ranking import average_rank, position_rank

G = ["league_id", "gameweek"]


def lookup_points(df: DataFrame, score: DataFrame, id_col: str = "player_id",
                  gw_col: str = "gw", out: str = "points", keep_missing: bool = False) -> DataFrame:
    """Left join a player's points for that week; unknown players score 0
    (Q7).  With ``keep_missing`` a boolean ``<out>_missing`` column is kept."""
    s = score.select(F.col("player_id").alias(id_col), F.col("gameweek").alias(gw_col),
                     F.col("total_points").alias(out), F.lit(False).alias("__known"))
    j = df.join(s, [id_col, gw_col], "left")
    if keep_missing:
        j = j.withColumn(f"{out}_missing", F.col("__known").isNull())
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("__known")


def scored_picks(pick: DataFrame, score: DataFrame) -> DataFrame:
    """J2 long form: every pick with its points that week."""
    return lookup_points(pick, score, keep_missing=True)


def entry_from_picks(pick: DataFrame, auto_sub: DataFrame | None = None) -> DataFrame:
    """One entry row per (entry_id, gw): starting players and bench
    as ordered lists and CSV strings, captain, vice-captain and auto-subs."""
    squads = pick.groupBy("entry_id", "gw").agg(
        ordered_ids(F.col("multiplier") > 0, "position", "player_id").alias("players"),
        ordered_ids(F.col("multiplier") == 0, "position", "player_id").alias("bench"),
        F.max(F.when(F.col("is_captain"), F.col("player_id"))).alias("captain"),
        F.max(F.when(F.col("is_vice_captain"), F.col("player_id"))).alias("vice_captain"))
    squads = squads.withColumn("players_csv", ids_csv("players")).withColumn(
        "bench_csv", ids_csv("bench"))
    if auto_sub is not None:
        subs = auto_sub.groupBy("entry_id", "gw").agg(
            F.array_sort(F.collect_list(F.when(F.col("direction") == "in", F.col("player_id")))).alias("auto_sub_in"),
            F.array_sort(F.collect_list(F.when(F.col("direction") == "out", F.col("player_id")))).alias("auto_sub_out"))
        empty = F.array().cast("array<bigint>")
        squads = (squads.join(subs, ["entry_id", "gw"], "left")
                  .withColumn("auto_sub_in", F.coalesce("auto_sub_in", empty))
                  .withColumn("auto_sub_out", F.coalesce("auto_sub_out", empty)))
    return squads


def weekly_squads(pick: DataFrame, score: DataFrame, with_lists: bool = False) -> DataFrame:
    """Per (entry_id, gw): number of starters, captain and vice with their
    points (captain x2, J3), missing-player count and optionally the
    points breakdown in squad order (J2)."""
    sp = scored_picks(pick, score)
    starter = F.col("multiplier") > 0
    aggs = [
        F.count(F.when(starter, 1)).cast("int").alias("n_players"),
        F.max(F.when(F.col("is_captain"), F.col("player_id"))).alias("captain"),
        F.max(F.when(F.col("is_vice_captain"), F.col("player_id"))).alias("vice_captain"),
        F.coalesce(F.max(F.when(F.col("is_captain"), F.col("points") * 2)), F.lit(0)).cast("int").alias("captain_points"),
        F.coalesce(F.max(F.when(F.col("is_vice_captain"), F.col("points"))), F.lit(0)).cast("int").alias("vice_captain_points"),
        F.count(F.when(starter & F.col("points_missing"), 1)).cast("int").alias("missing_players"),
    ]
    if with_lists:
        pair = F.struct(F.col("position").alias("p"), F.col("player_id").alias("i"),
                        F.col("points").alias("v"))
        aggs.append(F.array_sort(F.collect_list(F.when(starter, pair))).alias("__s"))
    # dealt by squad first: behind the join on players a squad's picks are far apart
    out = sp.repartition("entry_id", "gw").groupBy("entry_id", "gw").agg(*aggs)
    if with_lists:
        out = (out.withColumn("players", F.transform("__s", lambda s: s["i"]))
               .withColumn("points_breakdown", F.transform("__s", lambda s: s["v"]))
               .drop("__s"))
    return out


def squad_roles(pick: DataFrame) -> DataFrame:
    """Per (entry_id, gw): number of starters, captain and vice.  No points, so
    no score is read."""
    return pick.groupBy("entry_id", "gw").agg(
        F.count(F.when(F.col("multiplier") > 0, 1)).cast("int").alias("n_players"),
        F.max(F.when(F.col("is_captain"), F.col("player_id"))).alias("captain"),
        F.max(F.when(F.col("is_vice_captain"), F.col("player_id"))).alias("vice_captain"))


def weekly_scores(entry: DataFrame, pick: DataFrame, score: DataFrame, league: DataFrame,
                  with_rank: bool = True, stage: bool = False, points: bool = True) -> DataFrame:
    """The league-week frame of R1 (``o_df``): entries that fielded a squad
    (F4, Q6: null or empty squads dropped), joined to every league they are
    in, with captain / vice points and, ``with_rank``, the 1-based league
    rank (W1, ties by entry_id, Q12).  Consumers that never read the rank
    skip its extra shuffles; ``stage`` writes the frame once before ranking
    so the rank's two passes do not recompute the squad aggregation.  Without
    ``points`` the captain and vice points and ``missing_players`` are left out
    and the scores are not read."""
    sq = (weekly_squads(pick, score) if points else squad_roles(pick)).where(F.col("n_players") > 0)
    members = league.select("league_id", F.col("entry").alias("entry_id"))
    ws = (entry.join(sq, ["entry_id", "gw"], "inner")
          .join(members, "entry_id", "inner")
          .withColumnRenamed("gw", "gameweek"))
    if not with_rank:
        return ws
    return position_rank(ws, G, "total_points", "entry_id", out="rank", stage=stage)


def rank_position(ws: DataFrame) -> DataFrame:
    """W1 as its own output."""
    return ws.select(*G, "entry_id", "total_points", "rank")


def rank_average(ws: DataFrame) -> DataFrame:
    """Ties share the truncated average of their positions."""
    return average_rank(ws.select(*G, "entry_id", "total_points"), G, "total_points", out="rank")


def points_breakdown(pick: DataFrame, score: DataFrame) -> DataFrame:
    """Per (entry, week) the starters and their points in squad order."""
    return weekly_squads(pick, score, with_lists=True).select(
        "entry_id", F.col("gw").alias("gameweek"), "players", "points_breakdown", "missing_players")


def captain_vice_points(pick: DataFrame, score: DataFrame) -> DataFrame:
    """Captain points x2 (triple captain included, Q8), vice x1, 0 when absent."""
    role = F.coalesce(F.col("is_captain") | F.col("is_vice_captain"), F.lit(False))
    cols = ["entry_id", "gw", "player_id", "is_captain", "is_vice_captain"]
    # Only captains and vices need their points; the others stand for their squad.
    marked = lookup_points(pick.where(role).select(*cols), score).select(*cols, "points")
    others = pick.where(~role).select("entry_id", "gw").distinct()
    rows = marked.unionByName(others, allowMissingColumns=True)
    cap, vice = F.col("is_captain"), F.col("is_vice_captain")
    return rows.repartition("entry_id", "gw").groupBy("entry_id", F.col("gw").alias("gameweek")).agg(
        F.max(F.when(cap, F.col("player_id"))).alias("captain"),
        F.max(F.when(vice, F.col("player_id"))).alias("vice_captain"),
        F.coalesce(F.max(F.when(cap, F.col("points") * 2)), F.lit(0)).cast("int").alias("captain_points"),
        F.coalesce(F.max(F.when(vice, F.col("points"))), F.lit(0)).cast("int").alias("vice_captain_points"))


def highest_scoring_player(pick: DataFrame, score: DataFrame) -> DataFrame:
    """The first starter (squad order) with the week's highest points."""
    pb = weekly_squads(pick, score, with_lists=True).where(F.col("n_players") > 0)
    pos = first_argmax("points_breakdown")
    return pb.select("entry_id", F.col("gw").alias("gameweek"),
                     F.element_at("players", pos.cast("int")).alias("player_id"),
                     F.array_max("points_breakdown").alias("points"))
