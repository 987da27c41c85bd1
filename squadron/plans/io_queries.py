"""Queries for the schema contract (C1) and the gameweek refresh (K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from squadron import schemas
from squadron.operators import contract
from squadron.oracle_views import with_views
from squadron.plans.registry import register
from squadron.sources import sinks
from squadron.sources.testdata import tables

# fixed value: the key set expected in each events.props document
EXPECTED_PROPS_KEYS = ["k"]
# fixed values: the refresh feed re-delivers the last weeks with a +1 correction
REFRESH_FROM_WEEK = 34


@register("schema_contract", """
WITH obs AS (SELECT 'events.props' AS source, field, count(*) AS docs
             FROM (SELECT unnest(json_keys(props)) AS field FROM events) GROUP BY field),
     exp AS (SELECT 'events.props' AS source, f AS field FROM (VALUES ('k')) v(f))
SELECT coalesce(o.source, e.source) AS source, coalesce(o.field, e.field) AS field,
       coalesce(o.docs, 0) AS docs,
       CASE WHEN e.field IS NOT NULL AND coalesce(o.docs, 0) > 0 THEN 'present'
            WHEN e.field IS NOT NULL THEN 'missing' ELSE 'unexpected' END AS status
FROM obs o FULL OUTER JOIN exp e ON o.source = e.source AND o.field = e.field""", "C1")
def q_schema_contract(spark, sf_dir):
    ev = tables(spark, sf_dir).table("events")
    obs = contract.key_counts(ev, "props", "events.props")
    return contract.schema_contract(obs, {"events.props": EXPECTED_PROPS_KEYS})


@register("refresh_gameweek", with_views(
    f"""SELECT player_id, gameweek, total_points, minutes FROM score
        WHERE gameweek NOT IN (SELECT DISTINCT gameweek FROM score WHERE gameweek >= {REFRESH_FROM_WEEK})
        UNION ALL
        SELECT player_id, gameweek, total_points + 1, minutes FROM score WHERE gameweek >= {REFRESH_FROM_WEEK}""",
    "score"), "K3 Q17")
def q_refresh(spark, sf_dir):
    s = tables(spark, sf_dir).score.select("player_id", "gameweek", "total_points", "minutes")
    feed = s.where(F.col("gameweek") >= REFRESH_FROM_WEEK).withColumn(
        "total_points", F.col("total_points") + 1)
    return sinks.refreshed(s, feed)


# Stored rows are of version 10; re-deliveries are newer (12) or older (8), in some
# weeks both, so a merge that trusts the order of arrival gives other rows.
_FEEDS = """SELECT player_id, gameweek, total_points + 1 AS total_points, minutes, 12 AS version FROM score
            WHERE gameweek % 4 = 0
            UNION ALL SELECT player_id, gameweek, total_points - 5, minutes, 8 FROM score
            WHERE gameweek % 4 IN (0, 1) AND player_id % 3 = 0"""


@register("refresh_newest", with_views(
    f"""SELECT player_id, gameweek, total_points, minutes, version FROM (
          SELECT *, row_number() OVER (PARTITION BY player_id, gameweek ORDER BY version DESC) AS rn FROM (
            SELECT player_id, gameweek, total_points, minutes, 10 AS version FROM score
            UNION ALL {_FEEDS})) WHERE rn = 1""", "score"), "K3 Q17")
def q_refresh_newest(spark, sf_dir):
    s = tables(spark, sf_dir).score.select("player_id", "gameweek", "total_points", "minutes")
    newer = s.where("gameweek % 4 = 0").withColumn("total_points", F.col("total_points") + 1)
    older = s.where("gameweek % 4 IN (0, 1) AND player_id % 3 = 0").withColumn("total_points", F.col("total_points") - 5)
    rows = [df.withColumn("version", F.lit(v)) for df, v in ((s, 10), (newer, 12), (older, 8))]
    return sinks.newest_rows(rows[0].unionByName(rows[1]).unionByName(rows[2]), ["player_id", "gameweek"], ["version"])


# ---- document sources over landed documents ---------------------------------
# Each query lands bounded API-shaped documents derived from the domain tables
# (one Spark job) and reads them back with the production reader.
def _landed(t, name, writer, *args):
    from squadron.sources.landing import landing_path
    path = landing_path(t.spark, name)
    writer(*args, path)
    return path


@register("src_gameweek_scores", with_views(
    """SELECT player_id, gameweek, total_points, minutes, goals_scored, assists,
              CAST(expected_goals AS DOUBLE) AS expected_goals, CAST(influence AS DOUBLE) AS influence,
              in_dreamteam FROM score""", "score"), "S1 S15 F14")
def q_src_gameweek_scores(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = _landed(t, "gameweek", landing.land_gameweek_docs, t.score)
    s = documents.gameweek_scores(spark, path, multi_line=False)
    return s.select("player_id", "gameweek", "total_points", "minutes", "goals_scored", "assists",
                    F.col("expected_goals").cast("double").alias("expected_goals"),
                    F.col("influence").cast("double").alias("influence"), "in_dreamteam")


@register("src_gameweek_explain", with_views(
    """SELECT player_id, gameweek, total_points, minutes AS value,
              CAST(gameweek * 100 + player_id % 10 AS INTEGER) AS fixture FROM score""", "score"), "S2")
def q_src_gameweek_explain(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    played = t.score.withColumn("fixture", F.col("gameweek") * 100 + F.col("player_id") % 10)
    path = _landed(t, "gameweek", landing.land_gameweek_docs, played)
    return documents.gameweek_explain(spark, path, multi_line=False)


@register("src_fixtures", with_views(
    """SELECT homedifficulty, awaydifficulty, home, away, CAST(homegoals AS INTEGER) AS homegoals,
              CAST(awaygoals AS INTEGER) AS awaygoals, code, gameweek, finished, date FROM fixture""",
    "fixture"), "S4 S12")
def q_src_fixtures(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = _landed(t, "fixtures", landing.land_fixture_docs, t.fixture)
    return documents.fixtures(spark, path, multi_line=False).withColumn(
        "date", F.col("date").cast("timestamp_ntz"))


@register("src_transfers", with_views(
    "SELECT entry, event, time, element_in, element_out FROM transfer", "transfer"), "S6")
def q_src_transfers(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = _landed(t, "transfers", landing.land_transfer_docs, t.transfer)
    return documents.transfers(spark, path, multi_line=False).select(
        "entry", "event", F.col("time").cast("timestamp_ntz").alias("time"), "element_in", "element_out")


@register("src_league_pages", with_views(
    """SELECT CAST(s.league_id AS BIGINT) AS league_id, s.entry, m.league_name, s.entry_name, s.player_name,
              s.rank, s.last_rank, CAST(s.total AS INTEGER) AS total, s.event_total
       FROM standings s JOIN (SELECT DISTINCT league_id, league_name FROM league) m ON m.league_id = s.league_id
       WHERE s.gw = (SELECT max(gw) FROM entry)""", "standings", "league", "entry"), "S7 S8 U2")
def q_src_league_pages(spark, sf_dir):
    from squadron.plans.transfer_queries import current_week
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = landing.landing_path(spark, "leagues")
    landing.land_league_pages(t.standings, t.league, current_week(t), path)
    return documents.league_participants(spark, path, multi_line=False)


@register("src_entry_picks", with_views(
    """SELECT e.entry_id, e.gw, e.active_chip, e.total_points, e.points_on_bench, e.event_transfers_cost,
              p.players, p.bench, p.captain, p.vice_captain,
              coalesce(a.ins, '') AS auto_sub_in, coalesce(a.outs, '') AS auto_sub_out
       FROM entry e
       JOIN (SELECT entry_id, gw,
                    coalesce(string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY position)
                             FILTER (WHERE multiplier <> 0), '') AS players,
                    coalesce(string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY position)
                             FILTER (WHERE multiplier = 0), '') AS bench,
                    max(CASE WHEN is_captain THEN player_id END) AS captain,
                    max(CASE WHEN is_vice_captain THEN player_id END) AS vice_captain
             FROM pick GROUP BY entry_id, gw) p ON p.entry_id = e.entry_id AND p.gw = e.gw
       LEFT JOIN (SELECT entry_id, gw,
                         string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) FILTER (WHERE direction = 'in') AS ins,
                         string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) FILTER (WHERE direction = 'out') AS outs
                  FROM auto_sub GROUP BY entry_id, gw) a ON a.entry_id = e.entry_id AND a.gw = e.gw""",
    "entry", "pick", "auto_sub"), "S5 H1 H2")
def q_src_entry_picks(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = landing.landing_path(spark, "picks")
    landing.land_picks_docs(t.pick, t.entry, t.auto_sub, path)
    return documents.entry_rows(spark, path, multi_line=False, entry_in_doc=True)


@register("src_player_info", with_views(
    "SELECT player_id, half, player_name, position, team FROM player", "player"), "S3 H7")
def q_src_player_info(spark, sf_dir):
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    halves = []
    for half in (1, 2):
        path = landing.landing_path(spark, f"bootstrap-{half}")
        landing.land_bootstrap(t.player, half, path)
        halves.append(documents.player_info(spark, path, half, multi_line=False))
    return halves[0].unionByName(halves[1]).select("player_id", "half", "player_name", "position", "team")


# Keys that the landed picks documents hold: those of fields that are not null.
_PICKS_SEEN = """
  SELECT 'active_chip' AS field, count(active_chip) AS docs FROM d
  UNION ALL SELECT 'automatic_subs', count(*) FILTER (WHERE n_sub > 0) FROM d
  UNION ALL SELECT 'automatic_subs[].element_in', count(*) FILTER (WHERE n_in > 0) FROM d
  UNION ALL SELECT 'automatic_subs[].element_out', count(*) FILTER (WHERE n_sub > n_in) FROM d
  UNION ALL SELECT f, (SELECT count(*) FROM d) FROM (VALUES ('entry_id'), ('entry_history'), ('entry_history.event'),
    ('entry_history.points'), ('entry_history.points_on_bench'), ('entry_history.event_transfers_cost'), ('picks'),
    ('picks[].element'), ('picks[].position'), ('picks[].multiplier'), ('picks[].is_captain'),
    ('picks[].is_vice_captain')) v(f)"""
_PICKS_EXPECTED = ", ".join(f"('{p}')" for p in contract.expected_paths(schemas.PICKS_DOC))


@register("document_contract", with_views(
    f"""SELECT 'picks' AS source, coalesce(o.field, e.field) AS field, coalesce(o.docs, 0) AS docs,
               CASE WHEN e.field IS NULL THEN 'unexpected' WHEN coalesce(o.docs, 0) > 0 THEN 'present'
                    ELSE 'missing' END AS status
        FROM (SELECT * FROM ({_PICKS_SEEN}) WHERE docs > 0) o
        FULL OUTER JOIN (SELECT * FROM (VALUES {_PICKS_EXPECTED}) v(field)) e ON o.field = e.field""",
    "entry", "pick", "auto_sub", extra=(("d", """SELECT e.active_chip, coalesce(a.n_sub, 0) AS n_sub, coalesce(a.n_in, 0) AS n_in
        FROM entry e SEMI JOIN pick p ON p.entry_id = e.entry_id AND p.gw = e.gw
        LEFT JOIN (SELECT entry_id, gw, count(*) AS n_sub, count(*) FILTER (WHERE direction = 'in') AS n_in
                   FROM auto_sub GROUP BY entry_id, gw) a ON a.entry_id = e.entry_id AND a.gw = e.gw"""),)), "C1")
def q_document_contract(spark, sf_dir):
    """Key paths of whole picks documents: the request's entry id is unexpected,
    fields that the landing leaves out are missing."""
    from squadron.sources import landing
    t = tables(spark, sf_dir)
    path = _landed(t, "picks", landing.land_picks_docs, t.pick, t.entry, t.auto_sub)
    seen = contract.key_paths(spark.read.text(path), "value", "picks")
    return contract.schema_contract(seen, {"picks": contract.expected_paths(schemas.PICKS_DOC)})


@register("league_page_gaps", with_views(
    """SELECT league_id, page, problem FROM (
         SELECT CAST(p.league_id AS BIGINT) AS league_id, p.page, max(q.page) AS last,
                CASE WHEN p.page < max(q.page) THEN 'missing' ELSE 'unfinished' END AS problem,
                p.page < max(q.page) OR p.page = max(q.page) + 1 AS shown
         FROM pages p JOIN pages q ON q.league_id = p.league_id AND q.landed
         WHERE NOT p.landed GROUP BY p.league_id, p.page) WHERE shown""", "standings", "entry", extra=(("pages", """
       SELECT league_id, page, (page * 7 + league_id) % 3 <> 0 AS landed FROM (
         SELECT DISTINCT league_id, CAST((rank - 1) // 50 + 1 AS INTEGER) AS page FROM standings
         WHERE gw = (SELECT max(gw) FROM entry))"""),)), "S7")
def q_league_page_gaps(spark, sf_dir):
    """Standings pages of which a third never landed, so that leagues lack pages
    in the middle and at the end."""
    from squadron.plans.transfer_queries import current_week
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = landing.landing_path(spark, "leagues")
    landing.land_league_pages(t.standings, t.league, current_week(t), path,
                              landed=(F.col("page") * 7 + F.col("league_id")) % 3 != 0)
    return documents.league_page_gaps(spark, path, multi_line=False)


_YEAR_ORDER = "date_trunc('year', time) DESC, transfer_id DESC"


@register("src_transfers_order", with_views(
    f"""SELECT entry AS entry_id, event AS gameweek, list(element_in ORDER BY {_YEAR_ORDER}) AS element_in,
               list(element_out ORDER BY {_YEAR_ORDER}) AS element_out,
               arg_min(element_in, (date_trunc('year', time), transfer_id)) AS first_in,
               arg_min(element_out, (date_trunc('year', time), transfer_id)) AS first_out
        FROM transfer GROUP BY entry, event""", "transfer"), "S6 W5 A10", list_cols=("element_in", "element_out"))
def q_src_transfers_order(spark, sf_dir):
    """Transfers whose times are equal within a year: the order in the document
    decides, through A10's lists and W5's earliest."""
    from squadron.operators import transfers
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = _landed(t, "transfers", landing.land_transfer_docs, t.transfer.withColumn("time", F.date_trunc("year", "time")))
    read = documents.transfers(spark, path, multi_line=False)
    one = transfers.single_transfers(read).select("entry_id", "gameweek", F.col("element_in")[0].alias("first_in"),
                                                  F.col("element_out")[0].alias("first_out"))
    return transfers.collected_transfers(read).join(one, ["entry_id", "gameweek"])


@register("src_picks_quarantine", with_views(
    """SELECT entry_id, gw, reason, count(*) AS docs FROM (
         SELECT e.entry_id, e.gw, CASE WHEN e.entry_id % 11 = 0 THEN 'malformed' WHEN e.entry_id % 11 = 1 THEN 'error'
                  WHEN e.entry_id % 11 = 2 THEN 'absent' END AS reason
         FROM entry e SEMI JOIN pick p ON p.entry_id = e.entry_id AND p.gw = e.gw)
       WHERE reason IS NOT NULL GROUP BY ALL""", "entry", "pick"), "S5 Q6")
def q_src_picks_quarantine(spark, sf_dir):
    """Picks documents of which some are cut short, some are error messages and
    some never landed, as the quarantine table names them."""
    from squadron.sources import documents, landing
    t = tables(spark, sf_dir)
    path = _landed(t, "picks", landing.land_picks_docs, t.pick, t.entry, t.auto_sub)
    kind = F.get_json_object("value", "$.entry_id").cast("bigint") % 11
    damaged = F.when(kind == 0, F.expr("left(value, length(value) - 9)")).when(
        kind == 1, F.concat(F.lit('{"detail": "Not found.", "entry_id": '), F.get_json_object("value", "$.entry_id"), F.lit("}"))) \
        .otherwise(F.col("value"))
    raw = spark.read.text(path).select("gw", "value", kind.alias("kind"))
    bad = landing.landing_path(spark, "picks-damaged")
    raw.where("kind <> 2").select("gw", damaged.alias("value")).write.partitionBy("gw").text(bad)
    table = landing.landing_path(spark, "quarantine")
    requested = t.entry.select("entry_id", "gw").join(t.pick.select("entry_id", "gw").distinct(), ["entry_id", "gw"])
    documents.quarantine(documents.checked_picks(spark, bad, multi_line=False), table, requested)
    return (spark.read.parquet(table).groupBy("entry_id", F.col("gw").cast("int").alias("gw"), "reason")
            .agg(F.count(F.lit(1)).alias("docs")))


_BUCKET_KEYS = {"entry": ("entry_id", "gw"), "pick": ("entry_id", "gw"), "transfer": ("entry", "event")}


@register("entry_store_weeks", with_views(
    """SELECT e.entry_id, e.gw, e.total_points, p.n_players, p.captain, p.vice_captain, coalesce(t.n, 0) AS transfers,
              t.first_in
       FROM entry e
       JOIN (SELECT entry_id, gw, CAST(count(*) FILTER (WHERE multiplier > 0) AS INTEGER) AS n_players,
                    max(player_id) FILTER (WHERE is_captain) AS captain,
                    max(player_id) FILTER (WHERE is_vice_captain) AS vice_captain
             FROM pick GROUP BY entry_id, gw) p ON p.entry_id = e.entry_id AND p.gw = e.gw
       LEFT JOIN (SELECT entry, event, count(*) AS n, arg_min(element_in, (time, transfer_id)) AS first_in
                  FROM transfer GROUP BY entry, event) t ON t.entry = e.entry_id AND t.event = e.gw""",
    "entry", "pick", "transfer"), "K4 K6 J1 J10")
def q_entry_store_weeks(spark, sf_dir):
    """An entry's week beside its squad and its transfers, from tables bucketed
    by (entry, week): squads and transfers are gathered and joined where they are."""
    from squadron.operators import picks, transfers
    t = tables(spark, sf_dir)
    e, p, moved = (t.entry_store(name, key) for name, key in _BUCKET_KEYS.items())
    squads = picks.squad_roles(p)
    made = (moved.groupBy(F.col("entry").alias("entry_id"), F.col("event").alias("gw"))
            .agg(F.count(F.lit(1)).alias("n"), F.min_by("element_in", F.struct("time", "transfer_id")).alias("first_in")))
    return (e.join(squads.hint("merge"), ["entry_id", "gw"]).join(made.hint("merge"), ["entry_id", "gw"], "left")
            .select("entry_id", "gw", "total_points", "n_players", "captain", "vice_captain",
                    F.coalesce("n", F.lit(0)).alias("transfers"), "first_in"))
