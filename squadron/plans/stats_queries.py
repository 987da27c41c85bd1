"""Queries for distribution stats, bench / auto-subs and the game view."""

from __future__ import annotations

from squadron.operators import bench, stats
from squadron.operators.picks import G
from squadron.oracle_views import with_views
from squadron.plans.registry import register
from squadron.plans.transfer_queries import J1_CTES, J1_VIEWS, j1_of
from squadron.plans.oracle_common import WS_CTES, WS_VIEWS
from squadron.plans.weekly import ws_of
from squadron.sources.testdata import tables

ST = ("st", """SELECT league_id, gameweek, quantile_cont(total_points, 0.25) AS q1, avg(total_points) AS average,
       quantile_cont(total_points, 0.75) AS q3, max(total_points) AS max_points
  FROM ws GROUP BY league_id, gameweek""")
OUT = ("o", """SELECT w.league_id, w.gameweek, k.kind, w.entry_id, m.entry_name AS team_name,
       w.total_points AS score, st.average AS league_average
  FROM ws w JOIN st ON st.league_id = w.league_id AND st.gameweek = w.gameweek
  CROSS JOIN (VALUES ('exceptional'), ('abysmal')) k(kind)
  LEFT JOIN league m ON m.league_id = w.league_id AND m.entry = w.entry_id
  WHERE (k.kind = 'exceptional' AND w.total_points = st.max_points)
     OR (k.kind = 'abysmal' AND w.total_points < st.q1 - 1.5 * (st.q3 - st.q1))""")
SWD = ("swd", """SELECT s.*, p.team, p.position FROM score s LEFT JOIN player p
  ON p.player_id = s.player_id AND p.half = CASE WHEN s.gameweek <= 18 THEN 1 ELSE 2 END""")
ASP = ("asp", """SELECT a.entry_id, a.gw AS gameweek,
       coalesce(list_sort(list(a.player_id) FILTER (WHERE a.direction = 'in')), CAST([] AS BIGINT[])) AS auto_sub_in,
       coalesce(list_sort(list(a.player_id) FILTER (WHERE a.direction = 'out')), CAST([] AS BIGINT[])) AS auto_sub_out,
       CAST(coalesce(sum(coalesce(s.total_points, 0)) FILTER (WHERE a.direction = 'in'), 0) AS INTEGER) AS auto_sub_in_points,
       CAST(coalesce(sum(coalesce(s.total_points, 0)) FILTER (WHERE a.direction = 'out'), 0) AS INTEGER) AS auto_sub_out_points
  FROM auto_sub a LEFT JOIN score s ON s.player_id = a.player_id AND s.gameweek = a.gw
  GROUP BY a.entry_id, a.gw""")
FIXR = ("fixr", """SELECT f.homedifficulty, f.awaydifficulty, th.name AS home, ta.name AS away, f.homegoals, f.awaygoals,
       f.code - 2444470 AS fixtures, f.gameweek, f.finished, f.date,
       CAST(coalesce(f.homegoals > f.awaygoals, false) AS INTEGER) AS homewin,
       CAST(coalesce(f.homegoals = f.awaygoals, false) AS INTEGER) AS draw,
       CAST(coalesce(f.homegoals < f.awaygoals, false) AS INTEGER) AS awaywin
  FROM fixture f LEFT JOIN team th ON th.id = f.home LEFT JOIN team ta ON ta.id = f.away""")


@register("basic_stats", with_views(
    "SELECT league_id, gameweek, q1, average, q3 FROM st", *WS_VIEWS, extra=(*WS_CTES, ST)), "A5")
def q_basic_stats(spark, sf_dir):
    return stats.basic_stats(ws_of(tables(spark, sf_dir)), G)


@register("outliers", with_views("SELECT * FROM o", *WS_VIEWS, extra=(*WS_CTES, ST, OUT)), "A6 Q10")
def q_outliers(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.outliers(ws_of(t), t.league)


@register("outliers_iqr", with_views("SELECT * FROM o", *WS_VIEWS, extra=(
    *WS_CTES, ST, (OUT[0], OUT[1].replace("w.total_points = st.max_points",
                                          "w.total_points > st.q3 + 1.5 * (st.q3 - st.q1)")))), "A6 Q10")
def q_outliers_iqr(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.outliers(ws_of(t), t.league, rule="iqr")


OUT_REP_BODY = """SELECT g.league_id, g.gameweek, e.entry_id AS exceptional_entry, e.team_name AS exceptional_team,
              e.score AS exceptional_score, a.entry_id AS abysmal_entry, a.team_name AS abysmal_team,
              a.score AS abysmal_score, g.league_average
       FROM (SELECT league_id, gameweek, max(league_average) AS league_average FROM o GROUP BY ALL) g
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league_id, gameweek ORDER BY entry_id DESC) AS rn
                  FROM o WHERE kind = 'exceptional') WHERE rn = 1) e
              ON e.league_id = g.league_id AND e.gameweek = g.gameweek
       LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY league_id, gameweek ORDER BY score, entry_id DESC) AS rn
                  FROM o WHERE kind = 'abysmal') WHERE rn = 1) a
              ON a.league_id = g.league_id AND a.gameweek = g.gameweek"""


@register("outliers_reported", with_views(
    OUT_REP_BODY,
    *WS_VIEWS, extra=(*WS_CTES, ST, OUT)), "A6 Q10")
def q_outliers_reported(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.outliers_reported(ws_of(t), t.league)


@register("stats_with_dims", with_views(
    "SELECT player_id, gameweek, total_points, minutes, goals_scored, assists, team, position FROM swd",
    "score", "player", extra=(SWD,)), "J4 H10 Q9")
def q_stats_with_dims(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.stats_with_dims(t.score, t.player).select(
        "player_id", "gameweek", "total_points", "minutes", "goals_scored", "assists", "team", "position")


@register("gameview_gameweek_position", with_views(
    """SELECT gameweek, position, CAST(sum(goals_scored) AS BIGINT) AS goals_scored,
              CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(assists) AS BIGINT) AS assists
       FROM swd GROUP BY gameweek, position""", "score", "player", extra=(SWD,)), "A7 R3")
def q_gameview(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.gameview(stats.stats_with_dims(t.score, t.player))


@register("gameview_grouping_sets", with_views(
    """SELECT gameweek, position, team, grouping_id(gameweek, position, team) AS level,
              CAST(sum(goals_scored) AS BIGINT) AS goals_scored, CAST(sum(total_points) AS BIGINT) AS total_points,
              CAST(sum(assists) AS BIGINT) AS assists
       FROM swd GROUP BY GROUPING SETS ((gameweek, position), (gameweek, team), (position, team),
                                        (gameweek), (position), (team))""",
    "score", "player", extra=(SWD,)), "A8")
def q_grouping_sets(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.gameview_grouping_sets(stats.stats_with_dims(t.score, t.player))


@register("gameview_ict", with_views(
    """SELECT gameweek, position,
              CAST(sum(creativity) AS DOUBLE) AS creativity_sum, CAST(max(creativity) AS DOUBLE) AS creativity_max,
              CAST(sum(influence) AS DOUBLE) AS influence_sum, CAST(max(influence) AS DOUBLE) AS influence_max,
              CAST(sum(threat) AS DOUBLE) AS threat_sum, CAST(max(threat) AS DOUBLE) AS threat_max
       FROM swd GROUP BY gameweek, position""", "score", "player", extra=(SWD,)), "A17")
def q_ict(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.gameview_ict(stats.stats_with_dims(t.score, t.player))


@register("stat_totals", with_views(
    """SELECT gameweek, CAST(sum(total_points) AS BIGINT) AS total_points, CAST(sum(minutes) AS BIGINT) AS minutes,
              CAST(sum(goals_scored) AS BIGINT) AS goals_scored, CAST(sum(assists) AS BIGINT) AS assists,
              CAST(sum(expected_goals) AS DOUBLE) AS expected_goals,
              CAST(sum(expected_assists) AS DOUBLE) AS expected_assists,
              CAST(sum(expected_goals_conceded) AS DOUBLE) AS expected_goals_conceded,
              CAST(sum(influence) AS DOUBLE) AS influence, CAST(sum(creativity) AS DOUBLE) AS creativity,
              CAST(sum(threat) AS DOUBLE) AS threat
       FROM score GROUP BY gameweek""", "score"), "A18")
def q_stat_totals(spark, sf_dir):
    return stats.stat_totals(tables(spark, sf_dir).score)


@register("fixture_results", with_views("SELECT * FROM fixr", "fixture", "team", extra=(FIXR,)),
          "F1 F2 F3 J5 S12")
def q_fixture_results(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.fixture_results(t.fixture, t.team)


@register("difficulty_outcomes", with_views(
    """SELECT homedifficulty, awaydifficulty, CAST(sum(homewin) AS BIGINT) AS homewin,
              CAST(sum(draw) AS BIGINT) AS draw, CAST(sum(awaywin) AS BIGINT) AS awaywin
       FROM fixr GROUP BY homedifficulty, awaydifficulty""", "fixture", "team", extra=(FIXR,)), "A16")
def q_difficulty(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.difficulty_outcomes(stats.fixture_results(t.fixture, t.team))


@register("season_extremes", with_views(
    """SELECT league_id, entry AS entry_id,
              first(gw ORDER BY event_total DESC, gw) AS highest_gw, max(event_total) AS highest_points,
              first(gw ORDER BY event_total ASC, gw) AS lowest_gw, min(event_total) AS lowest_points,
              first(gw ORDER BY rank ASC, gw) AS best_rank_gw, min(rank) AS best_rank,
              first(gw ORDER BY rank DESC, gw) AS worst_rank_gw, max(rank) AS worst_rank
       FROM standings GROUP BY league_id, entry""", "standings"), "A24")
def q_extremes(spark, sf_dir):
    return stats.season_extremes(tables(spark, sf_dir).standings)


@register("auto_sub_points", with_views("SELECT * FROM asp", "auto_sub", "score", extra=(ASP,)), "A12 Q5", list_cols=('auto_sub_in', 'auto_sub_out'))
def q_auto_sub_points(spark, sf_dir):
    t = tables(spark, sf_dir)
    return bench.auto_sub_points(t.auto_sub, t.score)


JAMMY_BODY = """SELECT x.league_id, x.gameweek, CAST(x.k AS INTEGER) AS k, x.entry_id, m.entry_name AS team_name,
              coalesce(x.auto_sub_in, CAST([] AS BIGINT[])) AS sub_in,
              coalesce(x.auto_sub_out, CAST([] AS BIGINT[])) AS sub_out, x.pts AS points
       FROM (SELECT j.league_id, j.gameweek, j.entry_id, a.auto_sub_in, a.auto_sub_out,
                    coalesce(a.auto_sub_in_points, 0) AS pts,
                    row_number() OVER (PARTITION BY j.league_id, j.gameweek
                                       ORDER BY coalesce(a.auto_sub_in_points, 0) DESC, j.entry_id) AS k
             FROM j1 j LEFT JOIN asp a ON a.entry_id = j.entry_id AND a.gameweek = j.gameweek) x
       LEFT JOIN league m ON m.league_id = x.league_id AND m.entry = x.entry_id
       WHERE x.k <= 3"""


@register("jammy_points", with_views(
    JAMMY_BODY, *J1_VIEWS, "auto_sub", extra=(*J1_CTES, ASP)), "T5", list_cols=('sub_in', 'sub_out'))
def q_jammy(spark, sf_dir):
    t = tables(spark, sf_dir)
    return bench.jammy_points(j1_of(t), t.auto_sub, t.score, t.league)


MPOB_BODY = """SELECT x.league_id, x.gameweek, CAST(x.k AS INTEGER) AS k, x.entry_id, m.entry_name AS team_name,
              coalesce((SELECT list(p.player_id ORDER BY p.position) FROM pick p
                        WHERE p.entry_id = x.entry_id AND p.gw = x.gameweek AND p.multiplier = 0),
                       CAST([] AS BIGINT[])) AS players,
              x.points_on_bench AS point_on_bench
       FROM (SELECT league_id, gameweek, entry_id, points_on_bench,
                    row_number() OVER (PARTITION BY league_id, gameweek ORDER BY points_on_bench DESC NULLS LAST, entry_id) AS k
             FROM j1) x
       LEFT JOIN league m ON m.league_id = x.league_id AND m.entry = x.entry_id
       WHERE x.k <= 3"""


@register("most_points_on_bench", with_views(
    MPOB_BODY, *J1_VIEWS, extra=J1_CTES), "T6", list_cols=('players',))
def q_most_points_on_bench(spark, sf_dir):
    t = tables(spark, sf_dir)
    return bench.most_points_on_bench(j1_of(t), t.pick, t.league)


MOST_BENCHED_BODY = """SELECT c.league_id, c.gameweek, c.player_id, c.count, CAST(coalesce(s.total_points, 0) AS INTEGER) AS points
       FROM (SELECT j.league_id, j.gameweek, p.player_id, count(*) AS count
             FROM j1 j JOIN pick p ON p.entry_id = j.entry_id AND p.gw = j.gameweek AND p.multiplier = 0
             GROUP BY ALL) c
       LEFT JOIN score s ON s.player_id = c.player_id AND s.gameweek = c.gameweek"""


@register("most_benched", with_views(
    MOST_BENCHED_BODY,
    *J1_VIEWS, extra=J1_CTES), "A9")
def q_most_benched(spark, sf_dir):
    t = tables(spark, sf_dir)
    return bench.most_benched(j1_of(t), t.pick, t.score)
