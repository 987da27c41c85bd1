"""Participant (season) operators: F8, R2, A19, A23 (summary), J11, S14, U3, U4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.lists import check_gameweeks, season_half
from squadron.operators.picks import G
from squadron.operators.ranking import position_rank, top_k


def entries_span(entry: DataFrame, weeks=None, upto=None) -> DataFrame:
    """F8 (Q18 fixed): weekly entries for weeks 1..``upto`` or exactly the
    listed ``weeks``; ``upto`` may be a Column (e.g. the current week)."""
    if weeks is not None:
        return entry.where(F.col("gw").isin(check_gameweeks(weeks)))
    if upto is None:
        return entry
    if isinstance(upto, int):
        check_gameweeks(upto)
    return entry.where(F.col("gw") <= upto)


#: Roles of a squad whose player is reported as a whole.
ROLES = ("captain", "vice_captain", "highest_scoring_player")


def player_payloads(pick: DataFrame, score: DataFrame, player: DataFrame) -> DataFrame:
    """Every pick with ``payload``: the player's id, ``info`` (of the week's half
    of the season, J7) and ``score`` (all of that week's statistics); parts that
    are not known are null."""
    info = [c for c in player.columns if c not in ("player_id", "half")]
    stats = [c for c in score.columns if c not in ("player_id", "gameweek")]
    who = player.select("player_id", "half", F.struct("half", *info).alias("info"))
    week = score.select("player_id", F.col("gameweek").alias("gw"), F.struct(*stats).alias("score"))
    return (pick.withColumn("half", season_half("gw"))
            .join(who, ["player_id", "half"], "left").join(week, ["player_id", "gw"], "left")
            .withColumn("payload", F.struct("player_id", "info", "score")))


def participant_report(entry: DataFrame, pick: DataFrame, score: DataFrame,
                       player: DataFrame, auto_sub: DataFrame, upto=None) -> DataFrame:
    """R2: per entry and week 1..upto the entry's chip, points, bench points and
    transfer cost; squad, bench and automatic substitutions; the points
    breakdown; and captain (points x2, J3), vice and top scorer (W4), each as a
    whole player: info by season half and that week's score.

    The scores and the player table meet the picks in one join each; an
    aggregate over the squad picks the three players' structs."""
    p = player_payloads(pick, score, player)
    points = F.coalesce(F.col("payload.score.total_points"), F.lit(0))
    starter = F.col("multiplier") > 0

    def listed(cond):
        return F.array_sort(F.collect_list(F.when(cond, placed)))

    def only(cond, value):
        return F.max_by(F.when(cond, value), F.when(cond, F.col("player_id")))

    # Only starters, captains and vices can be reported as a whole.  The picks are
    # dealt by squad first: behind the joins on players a squad's picks are far apart.
    whole = F.coalesce(starter, F.lit(False)) | F.coalesce(F.col("is_captain") | F.col("is_vice_captain"), F.lit(False))
    p = p.select("entry_id", "gw", "player_id", "position", "multiplier", "is_captain", "is_vice_captain",
                 points.alias("points"), F.when(whole, F.col("payload")).alias("payload")).repartition("entry_id", "gw")
    points = F.col("points")
    placed = F.struct("position", "player_id", "points")
    squads = p.groupBy("entry_id", "gw").agg(
        listed(starter).alias("s"), listed(F.col("multiplier") == 0).alias("b"),
        only(F.col("is_captain"), F.col("payload")).alias("captain"),
        only(F.col("is_vice_captain"), F.col("payload")).alias("vice_captain"),
        F.min_by(F.when(starter, F.col("payload")), F.when(starter, F.struct(-points, F.col("position"))))
        .alias("highest_scoring_player")).where(F.size("s") > 0)
    is_in = F.col("direction") == "in"
    subs = auto_sub.groupBy("entry_id", "gw").agg(
        F.array_sort(F.collect_list(F.when(is_in, F.col("player_id")))).alias("auto_sub_in"),
        F.array_sort(F.collect_list(F.when(~is_in, F.col("player_id")))).alias("auto_sub_out"))
    none = F.array().cast("array<bigint>")
    got = lambda role: F.coalesce(F.col(f"{role}.score.total_points"), F.lit(0))
    return (entries_span(entry, upto=upto).join(squads, ["entry_id", "gw"]).join(subs, ["entry_id", "gw"], "left")
            .select("entry_id", F.col("gw").alias("gameweek"), "active_chip", "total_points", "points_on_bench",
                    "event_transfers_cost", F.transform("s", lambda x: x["player_id"]).alias("players"),
                    F.transform("b", lambda x: x["player_id"]).alias("bench"),
                    F.coalesce("auto_sub_in", none).alias("auto_sub_in"),
                    F.coalesce("auto_sub_out", none).alias("auto_sub_out"),
                    F.transform("s", lambda x: x["points"]).alias("points_breakdown"),
                    *ROLES, (got("captain") * 2).cast("int").alias("captain_points"),
                    got("vice_captain").cast("int").alias("vice_captain_points"),
                    F.array_max(F.transform("s", lambda x: x["points"])).alias("highest_scoring_player_points")))


def player_frequency(pick: DataFrame) -> DataFrame:
    """Per entry how often each player was a starter ('players') or on
    the bench ('bench') over the season."""
    metric = F.when(F.col("multiplier") > 0, "players").otherwise("bench")
    return pick.groupBy("entry_id", metric.alias("metric"), "player_id").agg(
        F.count(F.lit(1)).alias("count"))


def most_owned(ws: DataFrame, pick: DataFrame, k: int | None = None) -> DataFrame:
    """A19 per league: how many squads of each (league, week) hold each player;
    with ``k`` only the k most owned, numbered (ties by player id).  Owner counts are partial aggregates and the
    top-k is a group limit, so a huge league is never one task."""
    p = pick.select("entry_id", F.col("gw").alias("gameweek"), "player_id")
    owned = (ws.select(*G, "entry_id").join(p, ["entry_id", "gameweek"])
             .groupBy(*G, "player_id").agg(F.count(F.lit(1)).alias("owners")))
    if k is None:
        return owned
    return top_k(owned, G, [F.col("owners").desc(), F.col("player_id")], k).select(
        *G, "k", "player_id", "owners")


def season_wrap(entry: DataFrame, pick: DataFrame, score: DataFrame) -> DataFrame:
    """A23 (inferred from saved season reports): per entry the season
    average, highest and lowest week (ties: earliest), chips used, most
    captained player (ties: lowest id) and how often the vice was promoted
    because the captain played 0 minutes."""
    e = entry.select("entry_id", "gw", "total_points", "active_chip").repartition("entry_id").groupBy("entry_id").agg(
        F.avg("total_points").alias("season_average"),
        F.min(F.struct((-F.col("total_points")).alias("v"), "gw")).alias("hi"),
        F.min(F.struct(F.col("total_points").alias("v"), "gw")).alias("lo"),
        F.array_sort(F.collect_set("active_chip")).alias("chips_used"))
    caps = pick.where(F.col("is_captain"))
    # dealt by entry once, for both counts
    cap_counts = (caps.select("entry_id", "player_id").repartition("entry_id")
                  .groupBy("entry_id", "player_id").agg(F.count(F.lit(1)).alias("n")))
    top_cap = cap_counts.groupBy("entry_id").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), "player_id")).alias("c"))
    mins = score.select(F.col("player_id"), F.col("gameweek").alias("gw"), "minutes")
    vice_weeks = (pick.groupBy("entry_id", "gw").agg(
        F.max(F.when(F.col("is_captain"), F.col("player_id"))).alias("player_id"),
        F.max(F.when(F.col("is_vice_captain"), 1)).alias("has_vice"))
        .where(F.col("player_id").isNotNull() & F.col("has_vice").isNotNull())
        .join(mins, ["player_id", "gw"], "left")
        .where(F.coalesce("minutes", F.lit(0)) == 0)
        .groupBy("entry_id").agg(F.count(F.lit(1)).alias("promoted_vice")))
    return (e.join(top_cap, "entry_id", "left").join(vice_weeks, "entry_id", "left")
            .select("entry_id", "season_average",
                    F.col("hi.gw").alias("highest_gw"), (-F.col("hi.v")).alias("highest_points"),
                    F.col("lo.gw").alias("lowest_gw"), F.col("lo.v").alias("lowest_points"),
                    "chips_used",
                    F.col("c.player_id").alias("most_captained"),
                    (-F.col("c.neg")).alias("most_captained_count"),
                    F.coalesce("promoted_vice", F.lit(0)).alias("promoted_vice")))


def history_named(entry: DataFrame, league: DataFrame) -> DataFrame:
    """Weekly history joined (inner) to participant names."""
    names = league.select("league_id", F.col("entry").alias("entry_id"), "entry_name", "player_name")
    return entry.join(names, "entry_id").select(
        "league_id", F.col("gw").alias("gameweek"), "entry_id", "entry_name", "player_name",
        "points_on_bench", "total_points")


def participant_history(standings: DataFrame, entry: DataFrame) -> DataFrame:
    """S14 over the derived tables: per entry and week the points, running
    total, league rank, overall rank (all entries that week, skew-safe) and
    bench points / transfer cost when the entry played."""
    per_entry = standings.select("entry", "gw", "event_total", "total").distinct()
    overall = position_rank(per_entry, ["gw"], "total", "entry", out="overall_rank", stage=True)
    e = entry.select(F.col("entry_id").alias("entry"), "gw", "points_on_bench", "event_transfers_cost")
    return (standings.select("league_id", "entry", "gw", "rank")
            .join(overall, ["entry", "gw"]).join(e, ["entry", "gw"], "left")
            .select(F.col("entry").alias("entry_id"), F.col("gw").alias("gameweek"), "league_id",
                    F.col("event_total").alias("points"), F.col("total").alias("total_points"),
                    "rank", "overall_rank", "points_on_bench", "event_transfers_cost"))


def league_shield(ws: DataFrame, pick: DataFrame) -> DataFrame:
    """U4: per (league, week) the players in every squad of the league.
    Picks are unique per (entry, week, player), so a plain count equals the
    distinct count; the league size comes from a partial aggregate."""
    p = pick.select("entry_id", F.col("gw").alias("gameweek"), "player_id")
    members = ws.select(*G, "entry_id")
    size = members.groupBy(*G).agg(F.count(F.lit(1)).alias("n_entries"))
    owned = members.join(p, ["entry_id", "gameweek"]).groupBy(*G, "player_id").agg(
        F.count(F.lit(1)).alias("owners"))
    return (owned.join(size, G).where(F.col("owners") == F.col("n_entries"))
            .select(*G, "player_id", "n_entries"))


def common_to(squads: DataFrame, pick: DataFrame, keys, least: int = 1) -> DataFrame:
    """The players in every one of the chosen squads of each group of at
    least ``least`` squads; ``squads`` has the group's ``keys``, entry_id and
    gameweek, a squad once (an intersection as group-by-having).  Groups that
    are too small are left out before any pick is read."""
    p = pick.select("entry_id", F.col("gw").alias("gameweek"), "player_id")
    size = squads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_squads")).where(F.col("n_squads") >= least)
    owned = squads.join(size, list(keys)).join(p, ["entry_id", "gameweek"]).groupBy(
        *keys, "player_id", "n_squads").agg(F.count(F.lit(1)).alias("n"))
    return owned.where(F.col("n") == F.col("n_squads")).select(*keys, "player_id", "n_squads")


def common_players(ws: DataFrame, pick: DataFrame, top: int = 3) -> DataFrame:
    """U3 for the squads of each league-week's ``top`` ranked entries."""
    lead = top_k(ws.select(*G, "entry_id", "total_points"), G,
                 [F.col("total_points").desc(), F.col("entry_id")], top).drop("k")
    return common_to(lead, pick, G)
