"""Queries for players, gameweek lookups, participants and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from squadron.functions.lists import csv_ids, list_size, list_sum, valid_gameweek
from squadron.operators import lookups, participants, players, season, stats
from squadron.oracle_views import with_views
from squadron.plans.oracle_common import WS_CTES, WS_VIEWS
from squadron.plans.registry import register
from squadron.plans.transfer_queries import SPAN, current_week
from squadron.plans.weekly import ws_of
from squadron.session import stage_table
from squadron.sources.testdata import tables

HALF = "CASE WHEN {g} <= 18 THEN 1 ELSE 2 END"
DEC_COLS = ["expected_goals", "expected_assists", "expected_goals_conceded", "influence",
            "creativity", "threat"]
SCORE_SQL_COLS = ("player_id, gameweek, total_points, minutes, goals_scored, assists, "
                  + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DEC_COLS) + ", in_dreamteam")


def score_cols():
    return ["player_id", "gameweek", "total_points", "minutes", "goals_scored", "assists",
            *[F.col(c).cast("double").alias(c) for c in DEC_COLS], "in_dreamteam"]


# ---- players ---------------------------------------------------------------
@register("player_payload", with_views(
    f"""SELECT s.player_id, s.gameweek, p.player_name, p.team, p.position, s.total_points, s.minutes,
               s.goals_scored, s.assists, CAST(s.expected_goals AS DOUBLE) AS expected_goals, s.in_dreamteam
        FROM score s JOIN player p ON p.player_id = s.player_id AND p.half = {HALF.format(g='s.gameweek')}""",
    "score", "player"), "J7 R4 F13")
def q_player_payload(spark, sf_dir):
    t = tables(spark, sf_dir)
    return players.player_payload(t.score, t.player).select(
        "player_id", "gameweek", "player_name", "team", "position", "total_points", "minutes",
        "goals_scored", "assists", F.col("expected_goals").cast("double").alias("expected_goals"),
        "in_dreamteam")


PLAYER_IDS = [1, 2, 3, 10, 17, 26, 42, 77]


@register("player_payload_by_ids", with_views(
    f"""SELECT s.player_id, s.gameweek, p.half, p.player_name, p.team, p.position, s.total_points
        FROM score s JOIN player p ON p.player_id = s.player_id AND p.half = {HALF.format(g='s.gameweek')}
        WHERE s.gameweek = 20 AND s.player_id IN (1, 2, 3, 10, 17, 26, 42, 77)""", "score", "player"), "J7 R4")
def q_player_payload_by_ids(spark, sf_dir):
    t = tables(spark, sf_dir)
    return players.player_payload(t.score, t.player, ids=PLAYER_IDS, gameweek=20).select(
        "player_id", "gameweek", "half", "player_name", "team", "position", "total_points")


@register("player_names", with_views(
    f"""SELECT p.entry_id, p.gw AS gameweek, list(pl.player_name ORDER BY p.position) AS player_names
        FROM pick p LEFT JOIN player pl ON pl.player_id = p.player_id AND pl.half = {HALF.format(g='p.gw')}
        WHERE p.multiplier > 0 GROUP BY p.entry_id, p.gw""", "pick", "player"), "J8", list_cols=('player_names',))
def q_player_names(spark, sf_dir):
    t = tables(spark, sf_dir)
    return players.squad_names(t.pick, t.player)


@register("dream_team", with_views(
    f"""SELECT s.gameweek, s.player_id, p.player_name, p.team, s.total_points
        FROM score s JOIN player p ON p.player_id = s.player_id AND p.half = {HALF.format(g='s.gameweek')}
        WHERE s.in_dreamteam""", "score", "player"), "F9")
def q_dream_team(spark, sf_dir):
    t = tables(spark, sf_dir)
    return players.dream_team(t.score, t.player)


@register("gameweek_leaders", with_views(
    f"""SELECT l.gameweek, l.metric, l.player_id, l.value, p.player_name, p.team FROM (
          SELECT *, row_number() OVER (PARTITION BY gameweek, metric ORDER BY value DESC, player_id) AS rn FROM (
            SELECT player_id, gameweek, 'total_points' AS metric, CAST(total_points AS DOUBLE) AS value FROM score
            UNION ALL SELECT player_id, gameweek, 'expected_goals', CAST(expected_goals AS DOUBLE) FROM score
            UNION ALL SELECT player_id, gameweek, 'expected_goals_conceded', CAST(expected_goals_conceded AS DOUBLE) FROM score
            UNION ALL SELECT player_id, gameweek, 'expected_assists', CAST(expected_assists AS DOUBLE) FROM score)) l
        LEFT JOIN player p ON p.player_id = l.player_id AND p.half = {HALF.format(g='l.gameweek')}
        WHERE l.rn = 1""", "score", "player"), "T7 Q15")
def q_leaders(spark, sf_dir):
    t = tables(spark, sf_dir)
    return players.gameweek_leaders(t.score, t.player)


@register("player_by_half", with_views(
    "SELECT player_id, half, player_name, position, team FROM player", "player"), "F12")
def q_player_by_half(spark, sf_dir):
    return players.player_by_half(tables(spark, sf_dir).player)


@register("points_by_gameweek", with_views(
    "SELECT player_id, gameweek, total_points FROM score", "score"), "S9")
def q_points_by_gameweek(spark, sf_dir):
    return players.points_by_gameweek(tables(spark, sf_dir).score)


@register("gameweek_stats", with_views(
    f"SELECT {SCORE_SQL_COLS} FROM score WHERE gameweek = (SELECT max(gameweek) FROM score)", "score"),
    "S10 R5")
def q_gameweek_stats(spark, sf_dir):
    s = tables(spark, sf_dir).score_store
    return players.player_week_score(s, gameweek=s.select(F.max("gameweek")).scalar()).select(*score_cols())


@register("points_of_current_week", with_views(
    "SELECT player_id, gameweek, total_points FROM score WHERE gameweek = (SELECT max(gw) FROM entry)",
    "score", "entry"), "S9 F10")
def q_points_of_current_week(spark, sf_dir):
    """S9 for the current week: one partition of the score store is read."""
    t = tables(spark, sf_dir)
    return players.points_by_gameweek(t.score_store, gameweek=current_week(t))


@register("season_stats", with_views(
    f"SELECT {SCORE_SQL_COLS} FROM score ORDER BY gameweek DESC, player_id", "score"), "S11 R5")
def q_season_stats(spark, sf_dir):
    return players.season_stats(tables(spark, sf_dir).score).select(*score_cols())


# ---- gameweek lookups ------------------------------------------------------
def _status_sql(current: str = "(SELECT max(gw) FROM entry)") -> str:
    return f"""SELECT s.*, coalesce(p.chip_plays, CAST([] AS VARCHAR[])) AS chip_plays FROM (
  SELECT gw AS gameweek, gw = c.cur AS is_current, gw < c.cur AS finished, gw < c.cur AS data_checked,
       CASE WHEN gw = c.cur THEN 'current' WHEN NOT (gw < c.cur) THEN 'not yet played' ELSE 'summary' END AS status,
       first(entry_id ORDER BY total_points DESC, entry_id) AS highest_scoring_entry,
       max(total_points) AS highest_score,
       CAST(floor(sum(total_points) / count(total_points)) AS INTEGER) AS average_entry_score
  FROM entry CROSS JOIN (SELECT {current} AS cur) c GROUP BY gw, c.cur) s
  LEFT JOIN (SELECT gameweek, list(chip || ':' || plays ORDER BY chip) AS chip_plays FROM ({CHIPS_SQL})
             GROUP BY gameweek) p ON p.gameweek = s.gameweek"""


CHIPS_SQL = """SELECT gw AS gameweek, active_chip AS chip, count(*) AS plays FROM entry
    WHERE active_chip IS NOT NULL GROUP BY gw, active_chip"""
STATUS_SQL = _status_sql()


@register("gameweek_status", with_views(STATUS_SQL, "entry"), "F11 Q16", list_cols=("chip_plays",))
def q_gameweek_status(spark, sf_dir):
    return lookups.gameweek_status(tables(spark, sf_dir).entry)


@register("gameweek_status_midseason", with_views(_status_sql("20"), "entry"), "F11", list_cols=("chip_plays",))
def q_gameweek_status_midseason(spark, sf_dir):
    return lookups.gameweek_status(tables(spark, sf_dir).entry, current=20)


@register("chip_plays", with_views(CHIPS_SQL, "entry"), "F11")
def q_chip_plays(spark, sf_dir):
    return lookups.chip_plays(tables(spark, sf_dir).entry)


@register("current_gameweek", with_views(
    "SELECT gameweek, finished, data_checked FROM st WHERE is_current", "entry",
    extra=(("st", STATUS_SQL),)), "F10")
def q_current(spark, sf_dir):
    return lookups.current_gameweek(lookups.gameweek_status(tables(spark, sf_dir).entry))


@register("valid_gameweeks", with_views(
    """SELECT gameweek, gameweek BETWEEN 1 AND 38 AS valid FROM (
         SELECT gw AS gameweek FROM entry UNION SELECT event FROM transfer
         UNION SELECT gameweek FROM score UNION SELECT gameweek FROM fixture)""",
    "entry", "transfer", "score", "fixture"), "F6")
def q_valid(spark, sf_dir):
    t = tables(spark, sf_dir)
    return lookups.valid_gameweeks(t.entry.select("gw"), t.transfer.select("event"),
                                   t.score.select("gameweek"), t.fixture.select("gameweek"))


@register("requested_gameweeks", with_views(
    """SELECT entry_id, string_agg(w, ',' ORDER BY n) AS weeks, CAST(count(*) FILTER (WHERE w <> '') AS INTEGER) AS n_weeks,
              CAST(sum(coalesce(TRY_CAST(w AS BIGINT), 0)) AS BIGINT) AS week_sum,
              bool_and(coalesce(TRY_CAST(w AS BIGINT), 1) BETWEEN 1 AND 38) AS valid
       FROM (SELECT entry_id, gw AS n, CASE WHEN gw % 7 = 0 THEN '' ELSE CAST(gw * 2 - 9 AS VARCHAR) END AS w FROM entry)
       GROUP BY entry_id""", "entry"), "F6 H1 H3 H4")
def q_requested_gameweeks(spark, sf_dir):
    """Requested weeks as the comma-separated text in which they come: blanks
    dropped, counted and summed, valid only where every week is one of 1..38."""
    w = F.when(F.col("gw") % 7 == 0, "").otherwise((F.col("gw") * 2 - 9).cast("string"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gw", w.alias("w")))), lambda x: x["w"]), ",")
    asked = tables(spark, sf_dir).entry.groupBy("entry_id").agg(text.alias("weeks"))
    ids = csv_ids("weeks")
    return asked.select("entry_id", "weeks", list_size(ids).alias("n_weeks"), list_sum(ids).alias("week_sum"),
                        F.forall(ids, valid_gameweek).alias("valid"))


@register("gameweek_row_counts", with_views(
    "SELECT gameweek, count(*) AS rows FROM score GROUP BY gameweek", "score"), "A13")
def q_row_counts(spark, sf_dir):
    return lookups.gameweek_row_counts(tables(spark, sf_dir).score)


@register("distinct_gameweeks", with_views("SELECT DISTINCT gameweek FROM score", "score"), "A14")
def q_distinct_gw(spark, sf_dir):
    return lookups.distinct_values(tables(spark, sf_dir).score, "gameweek")


@register("distinct_teams", with_views("SELECT DISTINCT team FROM player", "player"), "A14")
def q_distinct_teams(spark, sf_dir):
    return lookups.distinct_values(tables(spark, sf_dir).player, "team")


@register("league_count", with_views(
    "SELECT league_id, league_name, count(*) AS n_entries FROM league GROUP BY ALL", "league"), "A15 Q16")
def q_league_count(spark, sf_dir):
    return lookups.league_count(tables(spark, sf_dir).league)


@register("league_entry_ids", with_views(
    "SELECT league_id, entry, count(*) OVER (PARTITION BY league_id) AS n_entries FROM league", "league"),
    "S13")
def q_league_entry_ids(spark, sf_dir):
    return lookups.league_entry_ids(tables(spark, sf_dir).league)


@register("league_participants", with_views(
    "SELECT league_id, league_name, entry, entry_name, player_name FROM league", "league"), "S7 S8 J9")
def q_league_participants(spark, sf_dir):
    return tables(spark, sf_dir).league


# ---- participants ----------------------------------------------------------
@register("entries_span", with_views(
    """SELECT entry_id, gw AS gameweek, active_chip, total_points, points_on_bench, event_transfers_cost
       FROM entry WHERE gw <= (SELECT max(gw) FROM entry)""", "entry"), "F8 Q18")
def q_entries_span(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.entries_span(t.entry, upto=current_week(t)).select(
        "entry_id", F.col("gw").alias("gameweek"), "active_chip", "total_points", "points_on_bench",
        "event_transfers_cost")


@register("entries_span_upto", with_views(
    "SELECT entry_id, gw AS gameweek, total_points FROM entry WHERE gw <= 17", "entry"), "F8")
def q_entries_span_upto(spark, sf_dir):
    return participants.entries_span(tables(spark, sf_dir).entry, upto=17).select(
        "entry_id", F.col("gw").alias("gameweek"), "total_points")


@register("entries_span_weeks", with_views(
    "SELECT entry_id, gw AS gameweek, total_points FROM entry WHERE gw IN (8, 10, 3)", "entry"), "F8")
def q_entries_span_weeks(spark, sf_dir):
    return participants.entries_span(tables(spark, sf_dir).entry, weeks=SPAN).select(
        "entry_id", F.col("gw").alias("gameweek"), "total_points")


SQP = ("sqp", """SELECT p.entry_id, p.gw, p.position, p.player_id, p.multiplier, p.is_captain, p.is_vice_captain,
       CAST(coalesce(s.total_points, 0) AS INTEGER) AS pts
  FROM pick p LEFT JOIN score s ON s.player_id = p.player_id AND s.gameweek = p.gw""")
R2 = ("r2", """SELECT entry_id, gw,
       list(player_id ORDER BY position) FILTER (WHERE multiplier > 0) AS players,
       list(pts ORDER BY position) FILTER (WHERE multiplier > 0) AS points_breakdown,
       first(player_id ORDER BY pts DESC, position) FILTER (WHERE multiplier > 0) AS highest_scoring_player,
       max(pts) FILTER (WHERE multiplier > 0) AS highest_scoring_player_points,
       max(CASE WHEN is_captain THEN player_id END) AS captain,
       CAST(coalesce(max(CASE WHEN is_captain THEN pts * 2 END), 0) AS INTEGER) AS captain_points,
       max(CASE WHEN is_vice_captain THEN player_id END) AS vice_captain,
       CAST(coalesce(max(CASE WHEN is_vice_captain THEN pts END), 0) AS INTEGER) AS vice_captain_points
  FROM sqp GROUP BY entry_id, gw HAVING count(*) FILTER (WHERE multiplier > 0) > 0""")


REPORT_COLS = ["entry_id", "gameweek", "total_points", "active_chip", "players", "points_breakdown",
               "highest_scoring_player_points", "captain_points", "vice_captain_points"]


@register("participant_report", with_views(
    f"""SELECT r.entry_id, r.gw AS gameweek, e.total_points, e.active_chip, r.players, r.points_breakdown,
               r.highest_scoring_player, r.highest_scoring_player_points, r.captain, r.captain_points,
               r.vice_captain, r.vice_captain_points, pc.player_name AS captain_name,
               pv.player_name AS vice_captain_name, ph.player_name AS highest_scoring_player_name
        FROM entry e JOIN r2 r ON r.entry_id = e.entry_id AND r.gw = e.gw
        LEFT JOIN player pc ON pc.player_id = r.captain AND pc.half = {HALF.format(g='r.gw')}
        LEFT JOIN player pv ON pv.player_id = r.vice_captain AND pv.half = {HALF.format(g='r.gw')}
        LEFT JOIN player ph ON ph.player_id = r.highest_scoring_player AND ph.half = {HALF.format(g='r.gw')}
        WHERE e.gw <= (SELECT max(gw) FROM entry)""",
    "entry", "pick", "score", "player", extra=(SQP, R2)), "R2 W4 J3 J7 F8", list_cols=('players', 'points_breakdown'))
def q_participant_report(spark, sf_dir):
    t = tables(spark, sf_dir)
    r = participants.participant_report(t.entry, t.pick, t.score, t.player, t.auto_sub, upto=current_week(t))
    return r.select(*REPORT_COLS, *[F.col(f"{role}.player_id").alias(role) for role in participants.ROLES],
                    *[F.col(f"{role}.info.player_name").alias(f"{role}_name") for role in participants.ROLES])


INFO_COLS = ["player_name", "position", "team", "half"]
STAT_COLS = ["total_points", "minutes", "goals_scored", "assists", "in_dreamteam"]


def _payload_sql():
    sel, joins = [], []
    for i, role in enumerate(participants.ROLES):
        sel += [f"r.{role} AS {role}_id", *[f"p{i}.{c} AS {role}_{c}" for c in INFO_COLS],
                *[f"s{i}.{c} AS {role}_score_{c}" for c in STAT_COLS],
                *[f"CAST(s{i}.{c} AS DOUBLE) AS {role}_score_{c}" for c in DEC_COLS]]
        joins.append(f"""LEFT JOIN player p{i} ON p{i}.player_id = r.{role} AND p{i}.half = {HALF.format(g='r.gw')}
                         LEFT JOIN score s{i} ON s{i}.player_id = r.{role} AND s{i}.gameweek = r.gw""")
    none = "CAST([] AS BIGINT[])"
    return with_views(f"""SELECT r.entry_id, r.gw AS gameweek, e.active_chip, e.total_points, e.points_on_bench,
            e.event_transfers_cost, r.players, coalesce(b.bench, {none}) AS bench,
            coalesce(a.ins, {none}) AS auto_sub_in, coalesce(a.outs, {none}) AS auto_sub_out, r.points_breakdown,
            r.captain_points, r.vice_captain_points, r.highest_scoring_player_points, {', '.join(sel)}
        FROM entry e JOIN r2 r ON r.entry_id = e.entry_id AND r.gw = e.gw
        LEFT JOIN (SELECT entry_id, gw, list(player_id ORDER BY position) AS bench FROM pick WHERE multiplier = 0
                   GROUP BY entry_id, gw) b ON b.entry_id = e.entry_id AND b.gw = e.gw
        LEFT JOIN (SELECT entry_id, gw, coalesce(list(player_id ORDER BY player_id) FILTER (WHERE direction = 'in'), {none}) AS ins,
                          coalesce(list(player_id ORDER BY player_id) FILTER (WHERE direction = 'out'), {none}) AS outs
                   FROM auto_sub GROUP BY entry_id, gw) a ON a.entry_id = e.entry_id AND a.gw = e.gw
        {' '.join(joins)} WHERE e.gw <= (SELECT max(gw) FROM entry)""",
                      "entry", "pick", "score", "player", "auto_sub", extra=(SQP, R2))


@register("participant_report_payloads", _payload_sql(), "R2",
          list_cols=("players", "bench", "auto_sub_in", "auto_sub_out", "points_breakdown"))
def q_participant_report_payloads(spark, sf_dir):
    """R2 whole, the three players' structs flattened."""
    t = tables(spark, sf_dir)
    r = participants.participant_report(t.entry, t.pick, t.score, t.player, t.auto_sub, upto=current_week(t))
    flat = []
    for role in participants.ROLES:
        flat += [F.col(f"{role}.player_id").alias(f"{role}_id"),
                 *[F.col(f"{role}.info.{c}").alias(f"{role}_{c}") for c in INFO_COLS],
                 *[F.col(f"{role}.score.{c}").alias(f"{role}_score_{c}") for c in STAT_COLS],
                 *[F.col(f"{role}.score.{c}").cast("double").alias(f"{role}_score_{c}") for c in DEC_COLS]]
    return r.select(*[c for c in r.columns if c not in participants.ROLES], *flat)


@register("player_frequency", with_views(
    """SELECT entry_id, CASE WHEN multiplier > 0 THEN 'players' ELSE 'bench' END AS metric, player_id,
              count(*) AS count FROM pick GROUP BY ALL""", "pick"), "A19")
def q_player_frequency(spark, sf_dir):
    return participants.player_frequency(tables(spark, sf_dir).pick)


@register("season_wrap", with_views(
    """SELECT e.entry_id, e.season_average, e.highest_gw, e.highest_points, e.lowest_gw, e.lowest_points,
              e.chips_used, t.most_captained, t.most_captained_count, coalesce(v.promoted_vice, 0) AS promoted_vice
       FROM (SELECT entry_id, avg(total_points) AS season_average,
                    first(gw ORDER BY total_points DESC, gw) AS highest_gw, max(total_points) AS highest_points,
                    first(gw ORDER BY total_points ASC, gw) AS lowest_gw, min(total_points) AS lowest_points,
                    coalesce(list_sort(list(DISTINCT active_chip) FILTER (WHERE active_chip IS NOT NULL)),
                             CAST([] AS VARCHAR[])) AS chips_used
             FROM entry GROUP BY entry_id) e
       LEFT JOIN (SELECT entry_id, first(player_id ORDER BY n DESC, player_id) AS most_captained,
                         max(n) AS most_captained_count
                  FROM (SELECT entry_id, player_id, count(*) AS n FROM pick WHERE is_captain GROUP BY ALL)
                  GROUP BY entry_id) t ON t.entry_id = e.entry_id
       LEFT JOIN (SELECT x.entry_id, count(*) AS promoted_vice
                  FROM (SELECT entry_id, gw, max(CASE WHEN is_captain THEN player_id END) AS cap,
                               max(CASE WHEN is_vice_captain THEN 1 END) AS has_vice
                        FROM pick GROUP BY entry_id, gw) x
                  LEFT JOIN score s ON s.player_id = x.cap AND s.gameweek = x.gw
                  WHERE x.cap IS NOT NULL AND x.has_vice IS NOT NULL AND coalesce(s.minutes, 0) = 0
                  GROUP BY x.entry_id) v ON v.entry_id = e.entry_id""",
    "entry", "pick", "score"), "A23", list_cols=('chips_used',))
def q_season_wrap(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.season_wrap(t.entry, t.pick, t.score)


@register("history_named", with_views(
    """SELECT m.league_id, e.gw AS gameweek, e.entry_id, m.entry_name, m.player_name, e.points_on_bench,
              e.total_points FROM entry e JOIN league m ON m.entry = e.entry_id""", "entry", "league"), "J11")
def q_history_named(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.history_named(t.entry, t.league)


PH_BODY = """SELECT s.entry AS entry_id, s.gw AS gameweek, s.league_id, ov.event_total AS points, ov.total AS total_points,
              s.rank, ov.overall_rank, e.points_on_bench, e.event_transfers_cost
       FROM standings s
       JOIN (SELECT entry, gw, event_total, total,
                    CAST(row_number() OVER (PARTITION BY gw ORDER BY total DESC, entry) AS INTEGER) AS overall_rank
             FROM (SELECT DISTINCT entry, gw, event_total, total FROM standings)) ov
         ON ov.entry = s.entry AND ov.gw = s.gw
       LEFT JOIN entry e ON e.entry_id = s.entry AND e.gw = s.gw"""


@register("participant_history", with_views(PH_BODY, "standings", "entry"), "S14 D8")
def q_participant_history(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.participant_history(t.standings, t.entry)


@register("league_shield", with_views(
    """SELECT o.league_id, o.gameweek, o.player_id, sz.n_entries
       FROM (SELECT w.league_id, w.gameweek, p.player_id, count(*) AS owners
             FROM ws w JOIN pick p ON p.entry_id = w.entry_id AND p.gw = w.gameweek GROUP BY ALL) o
       JOIN (SELECT league_id, gameweek, count(*) AS n_entries FROM ws GROUP BY ALL) sz
         ON sz.league_id = o.league_id AND sz.gameweek = o.gameweek
       WHERE o.owners = sz.n_entries""", *WS_VIEWS, extra=WS_CTES), "U4")
def q_league_shield(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.league_shield(ws_of(t), t.pick)


@register("common_players", with_views(
    """SELECT o.league_id, o.gameweek, o.player_id, sz.n_squads
       FROM (SELECT l.league_id, l.gameweek, p.player_id, count(*) AS n
             FROM ld l JOIN pick p ON p.entry_id = l.entry_id AND p.gw = l.gameweek GROUP BY ALL) o
       JOIN (SELECT league_id, gameweek, count(*) AS n_squads FROM ld GROUP BY ALL) sz
         ON sz.league_id = o.league_id AND sz.gameweek = o.gameweek
       WHERE o.n = sz.n_squads""", *WS_VIEWS,
    extra=(*WS_CTES, ("ld", """SELECT league_id, gameweek, entry_id FROM (
        SELECT *, row_number() OVER (PARTITION BY league_id, gameweek ORDER BY total_points DESC, entry_id) AS k
        FROM ws) WHERE k <= 3"""))), "U3")
def q_common_players(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.common_players(ws_of(t), t.pick)


@register("common_players_by_captain", with_views(
    """SELECT o.league_id, o.gameweek, o.captain, o.player_id, sz.n_squads
       FROM (SELECT w.league_id, w.gameweek, w.captain, p.player_id, count(*) AS n
             FROM ws w JOIN pick p ON p.entry_id = w.entry_id AND p.gw = w.gameweek GROUP BY ALL) o
       JOIN (SELECT league_id, gameweek, captain, count(*) AS n_squads FROM ws GROUP BY ALL HAVING count(*) > 1) sz
         ON sz.league_id = o.league_id AND sz.gameweek = o.gameweek AND sz.captain = o.captain
       WHERE o.n = sz.n_squads""", *WS_VIEWS, extra=WS_CTES), "U3")
def q_common_players_by_captain(spark, sf_dir):
    """The chosen squads are those that share a captain."""
    t = tables(spark, sf_dir)
    keys = ["league_id", "gameweek", "captain"]
    chosen = stage_table(ws_of(t).where(F.col("captain").isNotNull()).select(*keys, "entry_id"), "captained")
    return participants.common_to(chosen, t.pick, keys, least=2)


@register("owned_counts", with_views(
    """SELECT w.league_id, w.gameweek, p.player_id, count(*) AS owners
       FROM ws w JOIN pick p ON p.entry_id = w.entry_id AND p.gw = w.gameweek
       GROUP BY w.league_id, w.gameweek, p.player_id""", *WS_VIEWS, extra=WS_CTES), "A19")
def q_owned_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.most_owned(ws_of(t), t.pick)


@register("season_extreme_weeks", with_views(
    """SELECT entry_id, gameweek, kind, value FROM (
         SELECT h.entry_id, h.gameweek, k.kind,
                CAST(CASE WHEN k.kind LIKE '%points' THEN h.points ELSE h.overall_rank END AS BIGINT) AS value,
                CASE k.kind WHEN 'highest_points' THEN h.points = x.hi WHEN 'lowest_points' THEN h.points = x.lo
                     WHEN 'best_rank' THEN h.overall_rank = x.best ELSE h.overall_rank = x.worst END AS hit
         FROM h JOIN (SELECT entry_id, max(points) AS hi, min(points) AS lo, min(overall_rank) AS best,
                             max(overall_rank) AS worst FROM h GROUP BY entry_id) x ON x.entry_id = h.entry_id
         CROSS JOIN (VALUES ('highest_points'), ('lowest_points'), ('best_rank'), ('worst_rank')) k(kind)) WHERE hit""",
    "standings", "entry", extra=(("h", f"SELECT DISTINCT entry_id, gameweek, points, overall_rank FROM ({PH_BODY})"),)),
    "A24")
def q_season_extreme_weeks(spark, sf_dir):
    t = tables(spark, sf_dir)
    return stats.season_extreme_weeks(participants.participant_history(t.standings, t.entry))


# ---- A23 season wrap, all sections ----------------------------------------
def _season_sql(section: str, body: str, **cols) -> str:
    from squadron.operators.season import SEASON_SCHEMA
    from squadron.plans.report_queries import DUCK_TYPES
    sel = []
    for name, typ in SEASON_SCHEMA:
        if name == "section":
            sel.append(f"'{section}' AS section")
        elif name in cols:
            sel.append(f"CAST({cols[name]} AS {DUCK_TYPES[typ]}) AS {name}")
        elif name == "entry_id":
            sel.append("CAST(entry_id AS BIGINT) AS entry_id")
        else:
            sel.append(f"CAST(NULL AS {DUCK_TYPES[typ]}) AS {name}")
    return f"SELECT {', '.join(sel)} FROM ({body})"


def _season_parts():
    parts = [
        _season_sql("captain", "SELECT entry_id, player_id, count(*) AS n FROM pick WHERE is_captain GROUP BY ALL",
                    player_id="player_id", value="n"),
        _season_sql("promoted_vice", """SELECT r.entry_id, r.vice, count(*) AS n, sum(coalesce(s.total_points * 2, 0)) AS p
            FROM (SELECT entry_id, gw, max(CASE WHEN is_captain THEN player_id END) AS cap,
                         max(CASE WHEN is_vice_captain THEN player_id END) AS vice FROM pick GROUP BY entry_id, gw) r
            LEFT JOIN score c ON c.player_id = r.cap AND c.gameweek = r.gw
            LEFT JOIN score s ON s.player_id = r.vice AND s.gameweek = r.gw
            WHERE r.cap IS NOT NULL AND r.vice IS NOT NULL AND coalesce(c.minutes, 0) = 0
            GROUP BY r.entry_id, r.vice""", player_id="vice", value="p", value2="n"),
        _season_sql("used_chips", "SELECT DISTINCT entry_id, active_chip FROM e WHERE active_chip IS NOT NULL",
                    label="active_chip"),
        _season_sql("exceptional", "SELECT e.* FROM e JOIN est USING (entry_id) WHERE total_points = mx",
                    gameweek="gameweek", value="total_points"),
        _season_sql("abysmal", "SELECT e.* FROM e JOIN est USING (entry_id) WHERE total_points < q1 - 1.5 * (q3 - q1)",
                    gameweek="gameweek", value="total_points"),
        _season_sql("season_average", "SELECT * FROM est", average="avg"),
    ]
    for col, tag in (("element_out", "transferred_out"), ("element_in", "transferred_in")):
        for least in (False, True):
            order = "ASC" if least else "DESC"
            parts.append(_season_sql(("least_" if least else "most_") + tag, f"""SELECT * FROM (
                SELECT entry_id, {col}, count(*) AS n,
                       row_number() OVER (PARTITION BY entry_id ORDER BY count(*) {order}, {col}) AS k
                FROM w GROUP BY entry_id, {col}) WHERE k <= 3""", k="k", detail=col, value="n"))
    for best in (True, False):
        order, kk = ("delta DESC", 3) if best else ("delta ASC", 2)
        parts.append(_season_sql("best_transfer_in" if best else "worst_transfer_in", f"""SELECT * FROM (
            SELECT nc.*, row_number() OVER (PARTITION BY entry_id ORDER BY {order}, gameweek) AS k FROM nc
            WHERE (SELECT count(*) FROM nc c WHERE c.entry_id = nc.entry_id) > 2) WHERE k <= {kk}""",
            k="k", gameweek="gameweek", detail="element_in", detail2="element_out", value="delta"))
    parts.append(_season_sql("most_points_on_bench", """SELECT x.*, coalesce((SELECT list(p.player_id ORDER BY p.position)
            FROM pick p WHERE p.entry_id = x.entry_id AND p.gw = x.gameweek AND p.multiplier = 0),
            CAST([] AS BIGINT[])) AS players FROM (
            SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY points_on_bench DESC, gameweek) AS k
            FROM e WHERE points_on_bench IS NOT NULL) x WHERE k <= 3""",
            k="k", gameweek="gameweek", detail="players", value="points_on_bench"))
    parts.append(_season_sql("lucky_week", """SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY auto_sub_in_points DESC, gameweek) AS k
            FROM asp WHERE gameweek <= (SELECT max(gw) FROM entry)) WHERE k <= 3""",
            k="k", gameweek="gameweek", detail="auto_sub_in", detail2="auto_sub_out", value="auto_sub_in_points"))
    ext = """SELECT entry_id, first(gameweek ORDER BY total_points DESC, gameweek) AS hg, max(total_points) AS hv,
                    first(gameweek ORDER BY total_points ASC, gameweek) AS lg, min(total_points) AS lv
             FROM e GROUP BY entry_id"""
    parts.append(_season_sql("highest_point", ext, gameweek="hg", value="hv"))
    parts.append(_season_sql("lowest_point", ext, gameweek="lg", value="lv"))
    return parts


def _season_report_sql():
    from squadron.plans.stats_queries import ASP
    from squadron.plans.transfer_queries import MEMBERS, SPINE, TA, TA_LONG
    e = ("e", """SELECT entry_id, gw AS gameweek, active_chip, total_points, points_on_bench FROM entry
                 WHERE gw <= (SELECT max(gw) FROM entry)""")
    est = ("est", """SELECT entry_id, quantile_cont(total_points, 0.25) AS q1, quantile_cont(total_points, 0.75) AS q3,
                     max(total_points) AS mx, avg(total_points) AS avg FROM e GROUP BY entry_id""")
    pw = ("pw", """SELECT s.entry_id, s.gameweek,
              coalesce(ta.element_in, CAST([] AS BIGINT[])) AS element_in,
              coalesce(ta.element_out, CAST([] AS BIGINT[])) AS element_out,
              coalesce(ta.transfers, 0) AS transfers, coalesce(ta.delta, 0) AS delta
       FROM spine s LEFT JOIN ta ON ta.entry_id = s.entry_id AND ta.gameweek = s.gameweek""")
    w = ("w", "SELECT pw.*, e.active_chip, e.total_points, e.points_on_bench FROM pw LEFT JOIN e USING (entry_id, gameweek)")
    nc = ("nc", "SELECT * FROM w WHERE active_chip IS NULL AND transfers > 0")
    return with_views("\nUNION ALL\n".join(_season_parts()), "entry", "pick", "score", "transfer",
                      "auto_sub", "league",
                      extra=(TA_LONG, TA, MEMBERS, SPINE, e, est, pw, w, nc, ASP))


@register("season_wrap_report", _season_report_sql(), "A23 A6 A3 A4 T8 T3 T4 T6 T5 A24", list_cols=('detail', 'detail2'))
def q_season_wrap_report(spark, sf_dir):
    from squadron.plans.transfer_queries import members_of
    t = tables(spark, sf_dir)
    return season.season_wrap_report(t.entry, t.pick, t.score, t.transfer, t.auto_sub, members_of(t), current_week(t))


@register("most_owned", with_views(
    """SELECT league_id, gameweek, CAST(k AS INTEGER) AS k, player_id, owners FROM (
         SELECT w.league_id, w.gameweek, p.player_id, count(*) AS owners,
                row_number() OVER (PARTITION BY w.league_id, w.gameweek ORDER BY count(*) DESC, p.player_id) AS k
         FROM ws w JOIN pick p ON p.entry_id = w.entry_id AND p.gw = w.gameweek
         GROUP BY w.league_id, w.gameweek, p.player_id) WHERE k <= 3""", *WS_VIEWS, extra=WS_CTES), "A19")
def q_most_owned(spark, sf_dir):
    t = tables(spark, sf_dir)
    return participants.most_owned(ws_of(t), t.pick, k=3)


@register("src_participant_history", with_views(
    f"""SELECT entry_id, gameweek, points, CAST(total_points AS INTEGER) AS total_points, rank, overall_rank,
               points_on_bench, CAST(rank % 50 AS DOUBLE) / 10 AS bank, CAST(1000 + overall_rank % 77 AS DOUBLE) / 10 AS value,
               CAST(event_transfers_cost // 4 AS INTEGER) AS event_transfers
        FROM ({PH_BODY})""", "standings", "entry"), "S14 H11")
def q_src_participant_history(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = landing.landing_path(spark, "history")
    money = {"bank": F.col("rank") % 50, "value": 1000 + F.col("overall_rank") % 77,
             "event_transfers": F.expr("event_transfers_cost div 4")}
    landing.land_history_docs(participants.participant_history(t.standings, t.entry).withColumns(
        {c: v.cast("int") for c, v in money.items()}), path)
    return documents.participant_history(spark, path, multi_line=False, entry_in_doc=True).select(
        "entry_id", "gameweek", "points", "total_points", "rank", "overall_rank", "points_on_bench",
        F.col("bank").cast("double").alias("bank"), F.col("value").cast("double").alias("value"), "event_transfers")
