"""Queries for transfers and the entry/transfer join."""

from __future__ import annotations

from pyspark.sql import functions as F

from squadron.operators import ranking, transfers
from squadron.oracle_views import with_views
from squadron.plans.oracle_common import WS_CTES, WS_VIEWS
from squadron.plans.registry import register
from squadron.plans.weekly import ws_of
from squadron.sources.testdata import tables

# ---- oracle CTEs -----------------------------------------------------------
T1 = ("t1", """SELECT entry AS entry_id, event AS gameweek, [element_in] AS element_in, [element_out] AS element_out
  FROM (SELECT *, row_number() OVER (PARTITION BY entry, event ORDER BY time, transfer_id) AS rn FROM transfer)
  WHERE rn = 1""")
TP = ("tp", """SELECT t.entry_id, t.gameweek, t.element_in, t.element_out,
       CAST(coalesce(si.total_points, 0) AS INTEGER) AS transfer_points_in,
       CAST(coalesce(so.total_points, 0) AS INTEGER) AS transfer_points_out,
       CAST(len(t.element_out) AS INTEGER) AS transfers,
       CAST(coalesce(si.total_points, 0) - coalesce(so.total_points, 0) AS INTEGER) AS delta
  FROM t1 t LEFT JOIN score si ON si.player_id = t.element_in[1] AND si.gameweek = t.gameweek
  LEFT JOIN score so ON so.player_id = t.element_out[1] AND so.gameweek = t.gameweek""")
TPL = ("tpl", "SELECT m.league_id, tp.* FROM tp JOIN league m ON m.entry = tp.entry_id")
J1 = ("j1", """SELECT t.league_id, t.gameweek, t.entry_id, w.active_chip, w.total_points, w.points_on_bench,
       w.captain, w.rank, t.element_in, t.element_out, t.transfer_points_in, t.transfer_points_out,
       t.transfers, t.delta, true AS has_transfer
  FROM tpl t LEFT JOIN ws w ON w.league_id = t.league_id AND w.gameweek = t.gameweek AND w.entry_id = t.entry_id
  UNION ALL
  SELECT w.league_id, w.gameweek, w.entry_id, w.active_chip, w.total_points, w.points_on_bench,
       w.captain, w.rank, NULL, NULL, NULL, NULL, NULL, 0, false
  FROM ws w WHERE NOT EXISTS (SELECT 1 FROM tpl t WHERE t.league_id = w.league_id AND t.gameweek = w.gameweek)""")
J1_CTES = (*WS_CTES, T1, TP, TPL, J1)
J1_VIEWS = (*WS_VIEWS, "transfer")

# participant (all) mode: every transfer, lists newest first
TA_LONG = ("ta_long", """SELECT t.entry AS entry_id, t.event AS gameweek, t.time, t.transfer_id,
       t.element_in, t.element_out,
       coalesce(si.total_points, 0) AS p_in, coalesce(so.total_points, 0) AS p_out
  FROM transfer t LEFT JOIN score si ON si.player_id = t.element_in AND si.gameweek = t.event
  LEFT JOIN score so ON so.player_id = t.element_out AND so.gameweek = t.event""")
TA = ("ta", """SELECT entry_id, gameweek,
       list(element_in ORDER BY time DESC, transfer_id DESC) AS element_in,
       list(element_out ORDER BY time DESC, transfer_id DESC) AS element_out,
       CAST(sum(p_in) AS INTEGER) AS transfer_points_in, CAST(sum(p_out) AS INTEGER) AS transfer_points_out,
       CAST(count(*) AS INTEGER) AS transfers, CAST(sum(p_in) - sum(p_out) AS INTEGER) AS delta
  FROM ta_long GROUP BY entry_id, gameweek""")
MEMBERS = ("members", "SELECT DISTINCT entry AS entry_id FROM league")
SPINE = ("spine", """SELECT m.entry_id, CAST(w.gameweek AS INTEGER) AS gameweek
  FROM members m CROSS JOIN (SELECT unnest(generate_series(1, (SELECT max(gw) FROM entry))) AS gameweek) w""")

J1_COLS = ["league_id", "gameweek", "entry_id", "active_chip", "total_points", "points_on_bench",
           "captain", "rank", "element_in", "element_out", "transfer_points_in",
           "transfer_points_out", "transfers", "delta", "has_transfer"]

SPAN = [8, 10, 3]  # the reference's span fixture


def j1_of(t, rank: bool = False):
    return transfers.entry_transfer_join(ws_of(t, rank), t.transfer, t.score, t.league)


def current_week(t):
    """F10 over the data: the latest gameweek with entries."""
    return t.entry.select(F.max("gw")).scalar()


def members_of(t):
    return t.league.select(F.col("entry").alias("entry_id")).distinct()


@register("league_gw_transfers", with_views(
    "SELECT entry_id, gameweek, element_in, element_out FROM t1", "transfer", extra=(T1,)), "W5 Q1", list_cols=('element_in', 'element_out'))
def q_single(spark, sf_dir):
    return transfers.single_transfers(tables(spark, sf_dir).transfer)


@register("transfers_collected", with_views(
    "SELECT entry_id, gameweek, element_in, element_out FROM ta",
    "transfer", "score", extra=(TA_LONG, TA)), "A10", list_cols=('element_in', 'element_out'))
def q_collected(spark, sf_dir):
    return transfers.collected_transfers(tables(spark, sf_dir).transfer)


@register("transfer_delta", with_views(
    "SELECT * FROM tp", "transfer", "score", extra=(T1, TP)), "A11", list_cols=('element_in', 'element_out'))
def q_transfer_delta(spark, sf_dir):
    t = tables(spark, sf_dir)
    return transfers.transfer_points(t.transfer, t.score, "single").select(
        "entry_id", "gameweek", "element_in", "element_out", "transfer_points_in",
        "transfer_points_out", "transfers", "delta")


@register("entry_transfer_join", with_views(
    f"SELECT {', '.join(J1_COLS)} FROM j1", *J1_VIEWS, extra=J1_CTES), "J1 F5", list_cols=('element_in', 'element_out'))
def q_j1(spark, sf_dir):
    return j1_of(tables(spark, sf_dir), rank=True).select(*J1_COLS)


CHIP_BODY = """SELECT league_id, gameweek, active_chip, count(*) AS count FROM j1
       WHERE active_chip IS NOT NULL GROUP BY ALL"""


@register("chip_usage", with_views(
    CHIP_BODY, *J1_VIEWS, extra=J1_CTES), "A2")
def q_chip_usage(spark, sf_dir):
    return transfers.chip_usage(j1_of(tables(spark, sf_dir)))


def _most_body(col, least=False):
    order = "ASC" if least else "DESC"
    return f"""SELECT league_id, gameweek, CAST(k AS INTEGER) AS k, player, count FROM (
         SELECT league_id, gameweek, {col}[1] AS player, count(*) AS count,
                row_number() OVER (PARTITION BY league_id, gameweek ORDER BY count(*) {order}, {col}[1], {col}) AS k
         FROM j1 WHERE {col} IS NOT NULL GROUP BY league_id, gameweek, {col}) WHERE k <= 3"""


def _most_sql(col, least=False):
    return with_views(_most_body(col, least), *J1_VIEWS, extra=J1_CTES)


@register("most_transferred_out", _most_sql("element_out"), "A3 H9 Q4 Q11")
def q_most_out(spark, sf_dir):
    return transfers.most_transferred(j1_of(tables(spark, sf_dir)), "out")


@register("most_transferred_in", _most_sql("element_in"), "A4")
def q_most_in(spark, sf_dir):
    return transfers.most_transferred(j1_of(tables(spark, sf_dir)), "in")


@register("least_transferred", with_views(
    f"""SELECT 'in' AS direction, * FROM ({_most_body("element_in", True)})
        UNION ALL SELECT 'out' AS direction, * FROM ({_most_body("element_out", True)})""",
    *J1_VIEWS, extra=J1_CTES), "T8")
def q_least(spark, sf_dir):
    j1 = j1_of(tables(spark, sf_dir))
    a = transfers.most_transferred(j1, "in", least=True).withColumn("direction", F.lit("in"))
    b = transfers.most_transferred(j1, "out", least=True).withColumn("direction", F.lit("out"))
    return a.unionByName(b)


def _leader_body(best, k=None, more_than=2):
    order = "delta DESC, entry_id" if best else "delta ASC, entry_id"
    k = k or (3 if best else 2)
    return f"""SELECT x.league_id, x.gameweek, CAST(x.k AS INTEGER) AS k, x.entry_id, m.entry_name AS team_name,
              x.element_in[1] AS player_in, x.element_out[1] AS player_out, x.delta AS points_delta
       FROM (SELECT j.*, row_number() OVER (PARTITION BY league_id, gameweek ORDER BY {order}) AS k
             FROM j1 j WHERE active_chip IS NULL AND has_transfer
               AND (SELECT count(*) FROM j1 c WHERE c.league_id = j.league_id AND c.gameweek = j.gameweek
                    AND c.active_chip IS NULL AND c.has_transfer) > {more_than}) x
       LEFT JOIN league m ON m.league_id = x.league_id AND m.entry = x.entry_id
       WHERE x.k <= {k}"""


def _leader_sql(best):
    return with_views(_leader_body(best), *J1_VIEWS, extra=J1_CTES)


@register("best_transfer_in", _leader_sql(True), "T3 T9")
def q_best(spark, sf_dir):
    t = tables(spark, sf_dir)
    return transfers.transfer_leaders(j1_of(t), t.league, best=True)


@register("worst_transfer_in", _leader_sql(False), "T4 T9")
def q_worst(spark, sf_dir):
    t = tables(spark, sf_dir)
    return transfers.transfer_leaders(j1_of(t), t.league, best=False)


@register("single_best_and_worst_transfer", with_views(
    f"""SELECT 'best' AS kind, * FROM ({_leader_body(True, 1, 0)})
        UNION ALL SELECT 'worst' AS kind, * FROM ({_leader_body(False, 1, 0)})""", *J1_VIEWS, extra=J1_CTES), "T9")
def q_single_best_and_worst(spark, sf_dir):
    t = tables(spark, sf_dir)
    j1 = j1_of(t)
    parts = [transfers.transfer_leaders(j1, t.league, best, k=1, more_than=0).select(F.lit(kind).alias("kind"), "*")
             for kind, best in (("best", True), ("worst", False))]
    return parts[0].unionByName(parts[1])


@register("transfer_participation", with_views(
    """SELECT m.league_id, p.gameweek, count(*) AS transferred, count(CASE WHEN p.n > 1 THEN 1 END) AS multiple
       FROM (SELECT entry AS entry_id, event AS gameweek, count(*) AS n FROM transfer GROUP BY ALL) p
       JOIN league m ON m.entry = p.entry_id GROUP BY m.league_id, p.gameweek""",
    "transfer", "league"), "A20")
def q_participation(spark, sf_dir):
    t = tables(spark, sf_dir)
    return transfers.transfer_participation(t.transfer, t.league)


@register("transfers_span", with_views(
    f"SELECT * FROM transfer WHERE event IN ({', '.join(map(str, SPAN))})", "transfer"), "F7 F6")
def q_span(spark, sf_dir):
    return transfers.transfers_in_weeks(tables(spark, sf_dir).transfer, SPAN)


@register("participant_transfer_weeks", with_views(
    """SELECT s.entry_id, s.gameweek,
              coalesce(ta.element_in, CAST([] AS BIGINT[])) AS element_in,
              coalesce(ta.element_out, CAST([] AS BIGINT[])) AS element_out,
              coalesce(ta.transfer_points_in, 0) AS transfer_points_in,
              coalesce(ta.transfer_points_out, 0) AS transfer_points_out,
              coalesce(ta.transfers, 0) AS transfers, coalesce(ta.delta, 0) AS delta
       FROM spine s LEFT JOIN ta ON ta.entry_id = s.entry_id AND ta.gameweek = s.gameweek""",
    "transfer", "score", "league", "entry", extra=(TA_LONG, TA, MEMBERS, SPINE)), "J10 A11", list_cols=('element_in', 'element_out'))
def q_transfer_weeks(spark, sf_dir):
    t = tables(spark, sf_dir)
    return transfers.participant_transfer_weeks(t.transfer, t.score, members_of(t), current_week(t))


@register("weeks_without_transfers", with_views(
    """SELECT s.entry_id, s.gameweek FROM spine s
       WHERE NOT EXISTS (SELECT 1 FROM transfer t WHERE t.entry = s.entry_id AND t.event = s.gameweek)""",
    "transfer", "league", "entry", extra=(MEMBERS, SPINE)), "U1")
def q_weeks_without(spark, sf_dir):
    t = tables(spark, sf_dir)
    return transfers.weeks_without_transfers(t.transfer, members_of(t), current_week(t))


RISE_BODY = """SELECT league_id, gw AS gameweek, CAST(k AS INTEGER) AS k, entry AS entry_id, rank AS current_rank,
              last_rank AS prev_rank, rank_delta, player_name AS participant_name
       FROM (SELECT *, CAST(last_rank - rank AS INTEGER) AS rank_delta,
                    row_number() OVER (PARTITION BY league_id, gw ORDER BY last_rank - rank DESC, entry) AS k
             FROM standings WHERE last_rank - rank > 0) WHERE k <= 3"""


@register("rank_risers", with_views(
    RISE_BODY, "standings"), "T1 W3")
def q_risers(spark, sf_dir):
    return ranking.rank_movers(tables(spark, sf_dir).standings, "rise")


FALL_BODY = """SELECT league_id, gw AS gameweek, CAST(k AS INTEGER) AS k, entry AS entry_id, rank AS current_rank,
              last_rank AS prev_rank, rank_delta, player_name AS participant_name
       FROM (SELECT *, CAST(last_rank - rank AS INTEGER) AS rank_delta,
                    row_number() OVER (PARTITION BY league_id, gw ORDER BY last_rank - rank ASC, entry) AS k
             FROM standings WHERE last_rank - rank < 0) WHERE k <= 3"""


@register("rank_fallers", with_views(
    FALL_BODY, "standings"), "T2 W3")
def q_fallers(spark, sf_dir):
    return ranking.rank_movers(tables(spark, sf_dir).standings, "fall")
