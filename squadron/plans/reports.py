"""R1 league weekly report (and its JSON documents) as one job over every
(league, gameweek).

The report is tidy: one row per report item, ``section`` naming the part.
Every (league, week) with a fielded squad has at least its ``league_name``
row, so empty parts never drop a group.  The two shared frames (weekly scores
and the entry/transfer join) are written as stage tables in the shared
checkpoint folder (``materialize=True``, the default): the parts read them
instead of recomputing them, and their lineage is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadron.operators import bench, captains, stats, transfers
from squadron.operators.picks import G, weekly_scores
from squadron.operators.ranking import position_rank, rank_movers
from squadron.session import stage_table

LONG_SCHEMA = [("league_id", "int"), ("gameweek", "int"), ("section", "string"), ("k", "int"),
               ("entry_id", "bigint"), ("player_id", "bigint"), ("team_name", "string"),
               ("label", "string"), ("value", "bigint"), ("value2", "bigint"),
               ("detail", "array<bigint>"), ("detail2", "array<bigint>"), ("average", "double")]

SECTIONS = ["captain", "chips", "exceptional", "abysmal", "league_average", "rise", "fall",
            "most_transferred_out", "most_transferred_in", "best_transfer_in", "worst_transfer_in",
            "most_points_on_bench", "jammy_points", "most_benched", "league_name"]


def _long(df: DataFrame, section: str, **cols) -> DataFrame:
    """Project one report part onto the long schema (one ``selectExpr``)."""
    exprs = []
    for name, typ in LONG_SCHEMA:
        if name == "section":
            exprs.append(f"'{section}' AS section")
        elif name in cols:
            exprs.append(f"CAST(`{cols[name]}` AS {typ}) AS {name}")
        elif name in ("league_id", "gameweek"):
            exprs.append(f"CAST(`{name}` AS {typ}) AS {name}")
        else:
            exprs.append(f"CAST(NULL AS {typ}) AS {name}")
    return df.selectExpr(*exprs)


def week_frame(t, materialize: bool = True) -> DataFrame:
    """The weekly scores that every part reads, staged with ``materialize``."""
    ws = weekly_scores(t.entry, t.pick, t.score, t.league, with_rank=False, points=False)
    return stage_table(ws, "weekly_scores") if materialize else ws


def league_weekly_report(t, population: str = "transferred", materialize: bool = True,
                         ws: DataFrame | None = None) -> DataFrame:
    """R1 over all leagues and weeks.  ``t`` provides the domain tables
    (entry, pick, score, league, standings, transfer, auto_sub); ``ws`` the
    weekly scores where the caller has them already."""
    ws = week_frame(t, materialize) if ws is None else ws
    j1 = transfers.entry_transfer_join(ws, t.transfer, t.score, t.league, population)
    if materialize:
        j1 = stage_table(j1, "entry_transfer_join")
    league = t.league
    rep = stats.outliers_reported(ws, league)
    parts = [
        _long(captains.captain_counts(ws), "captain", player_id="captain", value="count"),
        _long(transfers.chip_usage(j1), "chips", label="active_chip", value="count"),
        _long(rep.where(F.col("exceptional_entry").isNotNull()), "exceptional",
              entry_id="exceptional_entry", team_name="exceptional_team", value="exceptional_score"),
        _long(rep.where(F.col("abysmal_entry").isNotNull()), "abysmal",
              entry_id="abysmal_entry", team_name="abysmal_team", value="abysmal_score"),
        _long(rep, "league_average", average="league_average"),
    ]
    for direction in ("rise", "fall"):
        m = rank_movers(t.standings, direction).join(ws.select(*G).distinct(), G, "left_semi")
        parts.append(_long(m, direction, k="k", entry_id="entry_id", team_name="participant_name",
                           value="current_rank", value2="prev_rank"))
    for direction in ("out", "in"):
        parts.append(_long(transfers.most_transferred(j1, direction), f"most_transferred_{direction}",
                           k="k", player_id="player", value="count"))
    for best in (True, False):
        parts.append(_long(transfers.transfer_leaders(j1, league, best),
                           "best_transfer_in" if best else "worst_transfer_in",
                           k="k", entry_id="entry_id", team_name="team_name", player_id="player_in",
                           value="points_delta", value2="player_out"))
    parts += [
        _long(bench.most_points_on_bench(j1, t.pick, league), "most_points_on_bench",
              k="k", entry_id="entry_id", team_name="team_name", value="point_on_bench", detail="players"),
        _long(bench.jammy_points(j1, t.auto_sub, t.score, league), "jammy_points",
              k="k", entry_id="entry_id", team_name="team_name", value="points",
              detail="sub_in", detail2="sub_out"),
        _long(bench.most_benched(j1, t.pick, t.score), "most_benched",
              player_id="player_id", value="count", value2="points"),
    ]
    names = league.select("league_id", "league_name").distinct()
    groups = ws.select(*G).distinct().join(names, "league_id", "left")
    parts.append(_long(groups, "league_name", label="league_name"))
    return reduce(DataFrame.unionByName, parts)


#: Sections of a document in the reference's order.  Per section: the item's
#: fields (name, column), and whether larger or smaller values come first.  Items
#: are ordered by that column, then player, then first letter of the label.
DOCUMENT = {
    "captain": ([("player", "player_id"), ("count", "value")], "-value"),
    "chips": ([("chip", "label"), ("count", "value")], "-value"),
    "promoted_vice": ([("player", "player_id"), ("count", "value"), ("points", "value2")], "-value"),
    "exceptional": ([("team_name", "team_name"), ("score", "value")], "-value"),
    "abysmal": ([("team_name", "team_name"), ("score", "value")], "value"),
    "league_average": ([("average", "average")], "k"),
    "rise": ([("participant_name", "team_name"), ("current_rank", "value"), ("prev_rank", "value2")], "k"),
    "fall": ([("participant_name", "team_name"), ("current_rank", "value"), ("prev_rank", "value2")], "k"),
    "most_transferred_out": ([("player", "player_id"), ("out", "value")], "k"),
    "most_transferred_in": ([("player", "player_id"), ("in", "value")], "k"),
    "best_transfer_in": ([("entry_id", "entry_id"), ("team_name", "team_name"), ("player_in", "player_id"),
                          ("player_out", "value2"), ("points_delta", "value")], "k"),
    "worst_transfer_in": ([("entry_id", "entry_id"), ("team_name", "team_name"), ("player_in", "player_id"),
                           ("player_out", "value2"), ("points_delta", "value")], "k"),
    "most_points_on_bench": ([("team_name", "team_name"), ("players", "detail"), ("point_on_bench", "value")], "k"),
    "jammy_points": ([("team_name", "team_name"), ("sub_in", "detail"), ("sub_out", "detail2"), ("points", "value")], "k"),
    "most_benched": ([("player", "player_id"), ("count", "value"), ("points", "value2")], "-value2"),
    "league_name": ([("name", "label")], "k"),
}

#: Items of one page of a section.
PAGE_ITEMS = 50


def _by_section(of) -> Column:
    """``of(name)`` of the row's section."""
    out = None
    for name in DOCUMENT:
        out = F.when(F.col("section") == name, of(name)) if out is None else out.when(F.col("section") == name, of(name))
    return out


def promoted_vice_part(ws: DataFrame, score: DataFrame) -> DataFrame:
    """A22 in the report's long form."""
    return _long(captains.promoted_vice(ws, score), "promoted_vice", player_id="vice_captain", value="count",
                 value2="points")


def report_pages(report: DataFrame, page_items: int = PAGE_ITEMS) -> DataFrame:
    """K5 / R1 as documents: for every (league, week) and section, in the
    reference's order, pages of at most ``page_items`` items as a JSON list.  An
    empty section has one page, ``[]``.

    Items are numbered without sorting a section in one task, so captains or
    benched players may be as many as there are players; a page is a bounded
    group, and a document is the pages of its (league, week) in order."""
    names = list(DOCUMENT)
    first = _by_section(lambda n: F.col(DOCUMENT[n][1].lstrip("-")) * (1 if DOCUMENT[n][1][0] == "-" else -1))
    item = _by_section(lambda n: F.to_json(F.struct(*[F.col(c).alias(f) for f, c in DOCUMENT[n][0]]),
                                           {"ignoreNullFields": "false"}))
    items = report.select(
        *G, "section", F.coalesce(first, F.lit(0)).cast("bigint").alias("first"),
        F.coalesce("player_id", F.ascii("label").cast("bigint"), F.lit(0)).alias("then"), item.alias("item"))
    placed = position_rank(items, [*G, "section"], "first", "then", out="place")
    # dealt by page first: behind the ranks a page's items are far apart
    pages = (placed.select(*G, "section", F.floor((F.col("place") - 1) / page_items).cast("int").alias("page"),
                           "place", "item")
             .repartition(*G, "section", "page").groupBy(*G, "section", "page")
             .agg(F.array_sort(F.collect_list(F.struct("place", "item"))).alias("l"))
             .select(*G, "section", "page", F.transform("l", lambda x: x["item"]).alias("l")))
    skeleton = report.where("section = 'league_name'").select(*G, F.posexplode(
        F.array(*[F.lit(n) for n in names])).alias("place", "section"))
    return (skeleton.join(pages, [*G, "section"], "left")
            .select(*G, "place", "section", F.coalesce("page", F.lit(0)).alias("page"),
                    F.coalesce(F.size("l"), F.lit(0)).alias("n_items"),
                    F.concat(F.lit("["), F.coalesce(F.array_join("l", ","), F.lit("")), F.lit("]")).alias("items")))


def league_report_documents(t, page_items: int = PAGE_ITEMS) -> DataFrame:
    """The report's documents for all leagues and weeks, promoted vices included."""
    ws = week_frame(t)
    whole = league_weekly_report(t, ws=ws).unionByName(promoted_vice_part(ws, t.score))
    return report_pages(stage_table(whole, "report-items"), page_items)
