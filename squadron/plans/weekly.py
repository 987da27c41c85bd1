"""Queries for weekly squads, scores, ranks and captains."""

from __future__ import annotations


from squadron.operators import captains, picks
from squadron.oracle_views import with_views
from squadron.plans.oracle_common import WS_CTES, WS_SQ, WS_VIEWS
from squadron.plans.registry import register
from squadron.sources.testdata import tables

WS_COLS = ["league_id", "gameweek", "entry_id", "total_points", "active_chip", "points_on_bench",
           "event_transfers_cost", "captain", "vice_captain", "captain_points",
           "vice_captain_points", "missing_players", "rank"]


def ws_of(t, rank: bool = False, points: bool = False):
    """Weekly league frame; the W1 rank only where a query outputs it (then
    the frame is staged once so the rank's two passes share it), and the
    captain and vice points too."""
    return picks.weekly_scores(t.entry, t.pick, t.score, t.league, with_rank=rank, stage=rank, points=points)


CAPTAIN_BODY = """SELECT league_id, gameweek, captain, count(*) AS count FROM ws
       WHERE captain IS NOT NULL GROUP BY league_id, gameweek, captain"""


@register("captain_counts", with_views(
    CAPTAIN_BODY,
    *WS_VIEWS, extra=WS_CTES), "A1")
def q_captain_counts(spark, sf_dir):
    return captains.captain_counts(ws_of(tables(spark, sf_dir)))


@register("weekly_scores", with_views(
    f"SELECT {', '.join(WS_COLS)} FROM ws", *WS_VIEWS, extra=WS_CTES), "F4 J3 W1")
def q_weekly_scores(spark, sf_dir):
    return ws_of(tables(spark, sf_dir), rank=True, points=True).select(*WS_COLS)


@register("weekly_rank_position", with_views(
    "SELECT league_id, gameweek, entry_id, total_points, rank FROM ws",
    *WS_VIEWS, extra=WS_CTES), "W1")
def q_rank_position(spark, sf_dir):
    return picks.rank_position(ws_of(tables(spark, sf_dir), rank=True))


@register("weekly_rank_avg", with_views(
    """SELECT league_id, gameweek, entry_id, total_points,
              CAST(floor(rank() OVER w + (count(*) OVER (PARTITION BY league_id, gameweek, total_points) - 1) / 2) AS INTEGER) AS rank
       FROM ws WINDOW w AS (PARTITION BY league_id, gameweek ORDER BY total_points DESC)""",
    *WS_VIEWS, extra=WS_CTES), "W2")
def q_rank_avg(spark, sf_dir):
    return picks.rank_average(ws_of(tables(spark, sf_dir)))


@register("points_breakdown", with_views(
    """SELECT p.entry_id, p.gw AS gameweek,
              list(p.player_id ORDER BY p.position) AS players,
              list(CAST(coalesce(s.total_points, 0) AS INTEGER) ORDER BY p.position) AS points_breakdown,
              CAST(count(CASE WHEN s.player_id IS NULL THEN 1 END) AS INTEGER) AS missing_players
       FROM pick p LEFT JOIN score s ON s.player_id = p.player_id AND s.gameweek = p.gw
       WHERE p.multiplier > 0 GROUP BY p.entry_id, p.gw
       UNION ALL
       SELECT entry_id, gw, [], [], 0 FROM pick GROUP BY entry_id, gw HAVING max(multiplier) = 0""",
    "pick", "score"), "J2 H1 H2", list_cols=('players', 'points_breakdown'))
def q_points_breakdown(spark, sf_dir):
    t = tables(spark, sf_dir)
    return picks.points_breakdown(t.pick, t.score)


@register("captain_vice_points", with_views(
    """SELECT entry_id, gw AS gameweek, captain, vice_captain, captain_points, vice_captain_points
       FROM ws_sq""", "pick", "score", extra=(WS_SQ,)), "J3 H6")
def q_captain_vice(spark, sf_dir):
    t = tables(spark, sf_dir)
    return picks.captain_vice_points(t.pick, t.score)


@register("highest_scoring_player", with_views(
    """SELECT entry_id, gameweek, player_id, points FROM (
         SELECT p.entry_id, p.gw AS gameweek, p.player_id, CAST(coalesce(s.total_points, 0) AS INTEGER) AS points,
                row_number() OVER (PARTITION BY p.entry_id, p.gw ORDER BY coalesce(s.total_points, 0) DESC, p.position) AS rn
         FROM pick p LEFT JOIN score s ON s.player_id = p.player_id AND s.gameweek = p.gw
         WHERE p.multiplier > 0) WHERE rn = 1""", "pick", "score"), "W4 H5")
def q_highest_scoring_player(spark, sf_dir):
    t = tables(spark, sf_dir)
    return picks.highest_scoring_player(t.pick, t.score)


@register("captain_counts_points", with_views(
    """SELECT c.league_id, c.gameweek, c.captain, c.count, CAST(coalesce(s.total_points * 2, 0) AS INTEGER) AS points
       FROM (SELECT league_id, gameweek, captain, count(*) AS count FROM ws
             WHERE captain IS NOT NULL GROUP BY ALL) c
       LEFT JOIN score s ON s.player_id = c.captain AND s.gameweek = c.gameweek""",
    *WS_VIEWS, extra=WS_CTES), "A21")
def q_captain_counts_points(spark, sf_dir):
    t = tables(spark, sf_dir)
    return captains.captain_counts_points(ws_of(t), t.score)


@register("captain_minutes", with_views(
    """SELECT w.league_id, w.gameweek, w.entry_id, w.captain, CAST(coalesce(s.minutes, 0) AS INTEGER) AS cap_minutes
       FROM ws w LEFT JOIN score s ON s.player_id = w.captain AND s.gameweek = w.gameweek""",
    *WS_VIEWS, extra=WS_CTES), "J6")
def q_captain_minutes(spark, sf_dir):
    t = tables(spark, sf_dir)
    return captains.captain_minutes(ws_of(t), t.score).select(
        "league_id", "gameweek", "entry_id", "captain", "cap_minutes")


@register("promoted_vice", with_views(
    """SELECT v.league_id, v.gameweek, v.vice_captain, v.count, CAST(coalesce(s.total_points * 2, 0) AS INTEGER) AS points
       FROM (SELECT w.league_id, w.gameweek, w.vice_captain, count(*) AS count
             FROM ws w LEFT JOIN score c ON c.player_id = w.captain AND c.gameweek = w.gameweek
             WHERE coalesce(c.minutes, 0) = 0 AND w.vice_captain IS NOT NULL GROUP BY ALL) v
       LEFT JOIN score s ON s.player_id = v.vice_captain AND s.gameweek = v.gameweek""",
    *WS_VIEWS, extra=WS_CTES), "A22")
def q_promoted_vice(spark, sf_dir):
    t = tables(spark, sf_dir)
    return captains.promoted_vice(ws_of(t), t.score)
