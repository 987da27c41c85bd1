"""Transfers: W5, A10, A11, J1 (+ fallback), A3, A4, T3, T4, T8, J10, U1,
F7, A20.

Transfers carry an entry but no league; per-entry facts are computed once and
then joined to league membership before grouping by (league, week).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron.functions.lists import check_gameweeks, first_item
from squadron.operators.picks import G, lookup_points
from squadron.operators.ranking import top_k


def empty_ids():
    return F.array().cast("array<bigint>")


def single_transfers(transfer: DataFrame) -> DataFrame:
    """W5 (Q1, league mode): one transfer per (entry, week) -- the earliest by
    time, ties by transfer id.  ``min(struct)`` is a partial aggregate, so a
    busy entry is never sorted in one task."""
    first = F.min(F.struct("time", "transfer_id", "element_in", "element_out")).alias("t")
    return (transfer.groupBy(F.col("entry").alias("entry_id"), F.col("event").alias("gameweek"))
            .agg(first)
            .select("entry_id", "gameweek",
                    F.array(F.col("t.element_in")).alias("element_in"),
                    F.array(F.col("t.element_out")).alias("element_out")))


def collected_transfers(transfer: DataFrame) -> DataFrame:
    """A10 (participant mode): every transfer of an (entry, week) as lists,
    newest first as the source lists them (ties by transfer id desc).  The
    group is one entry's week, bounded by the game's squad rules."""
    s = F.struct(F.col("time").alias("t"), F.col("transfer_id").alias("id"),
                 F.col("element_in").alias("i"), F.col("element_out").alias("o"))
    g = (transfer.groupBy(F.col("entry").alias("entry_id"), F.col("event").alias("gameweek"))
         .agg(F.sort_array(F.collect_list(s), asc=False).alias("__l")))
    return g.select("entry_id", "gameweek",
                    F.transform("__l", lambda x: x["i"]).alias("element_in"),
                    F.transform("__l", lambda x: x["o"]).alias("element_out"))


def transfer_points(transfer: DataFrame, score: DataFrame, mode: str = "single") -> DataFrame:
    """Per (entry, week) points of players in and out that week, number
    of transfers and delta = in - out (unknown players score 0, Q7).

    ``single`` (league mode, W5) reduces each (entry, week) to its earliest
    transfer first and then looks up two scores; ``all`` (participant mode,
    A10) looks up scores on the raw transfer rows and builds the lists and
    the sums in one aggregation -- no explode and re-group."""
    if mode == "single":
        one = single_transfers(transfer).select(
            "entry_id", "gameweek", "element_in", "element_out",
            F.col("element_in")[0].alias("pin"), F.col("element_out")[0].alias("pout"))
        one = lookup_points(one, score, id_col="pin", gw_col="gameweek", out="transfer_points_in")
        one = lookup_points(one, score, id_col="pout", gw_col="gameweek", out="transfer_points_out")
        return one.select(
            "entry_id", "gameweek", "element_in", "element_out",
            F.col("transfer_points_in").cast("int").alias("transfer_points_in"),
            F.col("transfer_points_out").cast("int").alias("transfer_points_out"),
            F.lit(1).alias("transfers"),
            (F.col("transfer_points_in") - F.col("transfer_points_out")).cast("int").alias("delta"))
    if mode != "all":
        raise ValueError(f"mode must be 'single' or 'all', got {mode!r}")
    t = transfer.select(F.col("entry").alias("entry_id"), F.col("event").alias("gameweek"),
                        "time", "transfer_id", "element_in", "element_out")
    t = lookup_points(t, score, id_col="element_in", gw_col="gameweek", out="p_in")
    t = lookup_points(t, score, id_col="element_out", gw_col="gameweek", out="p_out")
    s = F.struct(F.col("time").alias("t"), F.col("transfer_id").alias("id"),
                 F.col("element_in").alias("i"), F.col("element_out").alias("o"))
    g = t.groupBy("entry_id", "gameweek").agg(
        F.sort_array(F.collect_list(s), asc=False).alias("__l"),
        F.sum("p_in").cast("int").alias("transfer_points_in"),
        F.sum("p_out").cast("int").alias("transfer_points_out"),
        F.count(F.lit(1)).cast("int").alias("transfers"))
    return g.select(
        "entry_id", "gameweek",
        F.transform("__l", lambda x: x["i"]).alias("element_in"),
        F.transform("__l", lambda x: x["o"]).alias("element_out"),
        "transfer_points_in", "transfer_points_out", "transfers",
        (F.col("transfer_points_in") - F.col("transfer_points_out")).cast("int").alias("delta"))


def entry_transfer_join(ws: DataFrame, transfer: DataFrame, score: DataFrame,
                        league: DataFrame, population: str = "transferred") -> DataFrame:
    """The week's entries right-joined to the week's transfers (Q3).

    ``population="transferred"``: per (league, week) the rows are the
    entries that transferred (entry columns null when the entry fielded no
    squad); a (league, week) where nobody transferred falls back to all its
    entries with delta 0.  ``population="all"``: every entry, transfers
    left-joined."""
    tp = transfer_points(transfer, score, "single")
    members = league.select("league_id", F.col("entry").alias("entry_id"))
    t = tp.join(members, "entry_id", "inner")
    ws_cols = [c for c in ws.columns if c not in ("league_id", "gameweek", "entry_id")]
    if population == "all":
        j = ws.join(t, [*G, "entry_id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0)))
        return j.withColumn("has_transfer", F.col("transfers").isNotNull())
    if population != "transferred":
        raise ValueError(f"population must be 'transferred' or 'all', got {population!r}")
    # One pass over the week frame: a full outer join keeps transfer rows
    # (entry columns null without a squad) and every entry; a small
    # (league, week) flag table then drops the entries of weeks where
    # somebody transferred, which leaves the fallback rows of the others.
    groups_with_t = t.select(*G).distinct().withColumn("__week_has_t", F.lit(True))
    fo = (ws.join(t.withColumn("__has_t", F.lit(True)), [*G, "entry_id"], "full")
          .join(groups_with_t, G, "left")
          .where(F.col("__has_t").isNotNull() | F.col("__week_has_t").isNull()))
    cols = [*G, "entry_id", *ws_cols, "element_in", "element_out", "transfer_points_in",
            "transfer_points_out", "transfers"]
    return fo.select(*cols, F.coalesce("delta", F.lit(0)).alias("delta"),
                     F.col("__has_t").isNotNull().alias("has_transfer"))


def chip_usage(j1: DataFrame) -> DataFrame:
    """A2: chips played, over J1's rows; no chip is not counted (Q13)."""
    return (j1.where(F.col("active_chip").isNotNull())
            .groupBy(*G, "active_chip").agg(F.count(F.lit(1)).alias("count")))


def transfer_counts(j1: DataFrame, column: str) -> DataFrame:
    """Counts of whole transfer lists (Q4) per (league, week)."""
    return (j1.where(F.col(column).isNotNull())
            .groupBy(*G, column).agg(F.count(F.lit(1)).alias("count")))


def most_transferred(j1: DataFrame, direction: str = "out", k: int = 3,
                     least: bool = False, per_player: bool = False) -> DataFrame:
    """A3 / A4 (most) and T8 (least): top ``k`` whole lists by count,
    showing each list's first player; ties by that player (Q11, Q12).
    ``per_player`` counts each listed player instead of whole lists (Q4)."""
    column = "element_out" if direction == "out" else "element_in"
    if per_player:
        single = (j1.select(*G, F.explode(column).alias("__p"))
                  .select(*G, F.array("__p").alias(column)))
        c = transfer_counts(single, column).withColumn("player", first_item(column))
    else:
        c = transfer_counts(j1, column).withColumn("player", first_item(column))
    order = [F.col("count").asc() if least else F.col("count").desc(), F.col("player").asc(),
             F.col(column).asc()]
    return top_k(c, G, order, k).select(*G, "k", "player", "count")


def transfer_leaders(j1: DataFrame, participants: DataFrame, best: bool = True,
                     k: int | None = None, more_than: int = 2) -> DataFrame:
    """T3 (best, 3 rows) / T4 (worst, 2 rows -- the reference loop stops one
    short): chip-free transfer rows by delta, only where a (league, week) has
    more than ``more_than`` chip-free rows.  Ties by entry id.  ``k=1`` and
    ``more_than=0`` give the single best / worst transfer (T9), which needs one
    row only."""
    nc = j1.where(F.col("active_chip").isNull() & F.col("has_transfer"))
    if more_than:
        n = nc.groupBy(*G).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > more_than)
        nc = nc.join(n, G, "left_semi")
    order = [F.col("delta").desc() if best else F.col("delta").asc(), F.col("entry_id").asc()]
    names = participants.select("league_id", F.col("entry").alias("entry_id"),
                                F.col("entry_name").alias("team_name"))
    return (top_k(nc, G, order, k or (3 if best else 2))
            .join(names, ["league_id", "entry_id"], "left")
            .select(*G, "k", "entry_id", "team_name",
                    first_item("element_in").alias("player_in"),
                    first_item("element_out").alias("player_out"),
                    F.col("delta").alias("points_delta")))


def transfer_participation(transfer: DataFrame, league: DataFrame) -> DataFrame:
    """Per (league, week) how many entries transferred and how many made
    more than one transfer."""
    per = transfer.groupBy(F.col("entry").alias("entry_id"), F.col("event").alias("gameweek")).agg(
        F.count(F.lit(1)).alias("n"))
    members = league.select("league_id", F.col("entry").alias("entry_id"))
    return (per.join(members, "entry_id").groupBy(*G)
            .agg(F.count(F.lit(1)).alias("transferred"),
                 F.count(F.when(F.col("n") > 1, 1)).alias("multiple")))


def transfers_in_weeks(transfer: DataFrame, weeks=None) -> DataFrame:
    """transfers of one week, a list of weeks, or all (``weeks=None``);
    invalid weeks raise GameweekError before any job runs."""
    if weeks is None:
        return transfer
    return transfer.where(F.col("event").isin(check_gameweeks(weeks)))


def week_spine(members: DataFrame, last_week) -> DataFrame:
    """Every entry x weeks 1..last_week (a generator, not a join)."""
    lw = last_week if not isinstance(last_week, int) else F.lit(last_week)
    return members.select("entry_id", F.explode(F.sequence(F.lit(1), lw)).alias("gameweek"))


def participant_transfer_weeks(transfer: DataFrame, score: DataFrame, members: DataFrame,
                               last_week) -> DataFrame:
    """J10 (+A11): the dense week spine of each entry with all its transfers
    that week (participant mode) -- empty lists where none were made."""
    tp = transfer_points(transfer, score, "all")
    spine = week_spine(members, last_week)
    j = spine.join(tp, ["entry_id", "gameweek"], "left")
    return j.select(
        "entry_id", "gameweek",
        F.coalesce("element_in", empty_ids()).alias("element_in"),
        F.coalesce("element_out", empty_ids()).alias("element_out"),
        F.coalesce("transfer_points_in", F.lit(0)).alias("transfer_points_in"),
        F.coalesce("transfer_points_out", F.lit(0)).alias("transfer_points_out"),
        F.coalesce("transfers", F.lit(0)).alias("transfers"),
        F.coalesce("delta", F.lit(0)).alias("delta"))


def weeks_without_transfers(transfer: DataFrame, members: DataFrame, last_week) -> DataFrame:
    """Spine weeks minus transfer weeks (left anti join)."""
    made = transfer.select(F.col("entry").alias("entry_id"), F.col("event").alias("gameweek"))
    return week_spine(members, last_week).join(made, ["entry_id", "gameweek"], "left_anti")
