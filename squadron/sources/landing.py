"""Landing writers: domain tables out to the API's document shapes.

The inverse of ``sources.documents``: each writer is one distributed job
that groups rows into bounded documents (a chunk of one gameweek's players,
one entry's transfers, one standings page of 50) and writes them as JSON
Lines under ``key=value`` folders.  They build landing folders from derived
data, so the readers can be run -- and checked -- at any scale.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadron import schemas
from squadron.session import checkpoint_dir

# fixed values: players per gameweek document, fixtures per document,
# entries per standings page
PLAYERS_PER_DOC = 1000
FIXTURES_PER_DOC = 500
PAGE_SIZE = 50


def landing_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/landing/{name}-{uuid.uuid4().hex}"


def gameweek_docs(score: DataFrame, chunk: int = PLAYERS_PER_DOC) -> DataFrame:
    """score rows -> live documents (gameweek, elements) of at most ``chunk``
    players each; text decimals as the API sends them.

    The rows are dealt by document as they are, into all of the session's shuffle
    partitions, and take the API's nested shape behind that exchange: the shape,
    stats that no row has and partly filled lists are never exchanged, and AQE
    does not merge partitions by bytes that grow many times once nested."""
    sent = [c for c in (*schemas.STAT_INT, *schemas.STAT_DECIMAL_TEXT, "in_dreamteam", "fixture") if c in score.columns]
    rows = score.select("gameweek", F.floor(F.col("player_id") / chunk).alias("__chunk"), "player_id", *sent)
    rows = rows.repartition(int(score.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gameweek", "__chunk")
    stats = []
    for c in schemas.STAT_INT:
        stats.append((F.col(c) if c in sent else F.lit(None)).cast("int").alias(c))
    for c in schemas.STAT_DECIMAL_TEXT:
        stats.append((F.col(c).cast("string") if c in sent else F.lit(None).cast("string")).alias(c))
    stats.append(F.col("in_dreamteam").alias("in_dreamteam"))
    fixture = F.col("fixture") if "fixture" in sent else F.lit(None)
    explain = F.array(F.struct(fixture.cast("int").alias("fixture"), F.array(F.struct(
        F.lit("minutes").alias("identifier"), F.lit(None).cast("int").alias("points"),
        F.col("minutes").alias("value"))).alias("stats")))
    el = rows.select("gameweek", "__chunk",
                     F.struct(F.col("player_id").alias("id"), F.struct(*stats).alias("stats"),
                              explain.alias("explain")).alias("e"))
    docs = el.groupBy("gameweek", "__chunk").agg(F.collect_list("e").alias("elements"))
    return docs.select("gameweek", "elements")


def land_gameweek_docs(score: DataFrame, path: str, chunk: int = PLAYERS_PER_DOC) -> None:
    """score rows -> ``gameweek=<n>/`` live documents (``gameweek_docs``).

    A document repeats its keys with every player, so the files are compressed:
    each holds the documents of one task and week, which bounds what a reader,
    who cannot split it, takes at once."""
    gameweek_docs(score, chunk).write.partitionBy("gameweek").json(path, compression="gzip")


def land_fixture_docs(fixture: DataFrame, path: str, chunk: int = FIXTURES_PER_DOC) -> None:
    """fixture rows -> JSON arrays of at most ``chunk`` fixtures per line."""
    f = fixture.select(F.floor(F.col("code") / chunk).alias("__chunk"), F.struct(
        F.col("code"), F.col("gameweek").alias("event"), "finished",
        F.col("date").alias("kickoff_time"), F.col("away").alias("team_a"),
        F.col("awaygoals").cast("int").alias("team_a_score"), F.col("home").alias("team_h"),
        F.col("homegoals").cast("int").alias("team_h_score"),
        F.col("homedifficulty").alias("team_h_difficulty"),
        F.col("awaydifficulty").alias("team_a_difficulty")).alias("f"))
    docs = f.groupBy("__chunk").agg(F.to_json(F.collect_list("f")).alias("value"))
    docs.select("value").write.text(path)


def land_transfer_docs(transfer: DataFrame, path: str) -> None:
    """transfer rows -> one JSON array per entry (its season's transfers,
    newest first as the source lists them)."""
    t = transfer.select("entry", F.struct(
        "element_in", "element_out", "entry", "event",
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time"),
        F.col("transfer_id").alias("__id")).alias("t"))
    docs = t.groupBy("entry").agg(F.sort_array(F.collect_list(
        F.struct(F.col("t.time").alias("k"), F.col("t.__id").alias("i"), F.col("t").alias("t"))),
        asc=False).alias("__l"))
    out = docs.select(F.to_json(F.transform("__l", lambda x: x["t"].dropFields("__id"))).alias("value"))
    out.write.text(path)


def land_league_pages(standings: DataFrame, league: DataFrame, week, path: str,
                      page_size: int = PAGE_SIZE, landed=None) -> None:
    """One week's standings -> ``league_id=<l>/`` pages of ``page_size``
    entries in rank order, with the league name and ``has_next``.  ``landed``
    (a condition on league_id and page) leaves pages out, as failed requests do."""
    names = league.select("league_id", "league_name").distinct()
    s = standings.where(F.col("gw") == week).withColumn(
        "page", (F.floor((F.col("rank") - 1) / page_size) + 1).cast("int"))
    last = s.groupBy("league_id").agg(F.max("page").alias("__last"))
    row = F.struct(F.col("entry").alias("id"), "event_total", "player_name", "rank", "last_rank",
                   F.col("rank").alias("rank_sort"), F.col("total").cast("int").alias("total"),
                   "entry", "entry_name")
    pages = (s.groupBy("league_id", "page").agg(F.collect_list(row).alias("results"))
             .join(last, "league_id").join(names, "league_id"))
    if landed is not None:
        pages = pages.where(landed)
    pages.select(
        "league_id",
        F.struct(F.col("league_id").cast("long").alias("id"), F.col("league_name").alias("name")).alias("league"),
        F.struct((F.col("page") < F.col("__last")).alias("has_next"), "page",
                 "results").alias("standings")).write.partitionBy("league_id").json(path)


def land_picks_docs(pick: DataFrame, entry: DataFrame, auto_sub: DataFrame, path: str) -> None:
    """One picks document per (entry, week) -- a squad, bounded -- under
    ``gw=<n>/``, keeping the request's entry id in the document.  Auto-subs
    are paired in/out in ascending id order, as the API lists pairs.

    A document repeats its keys with every pick, so the files are compressed, by a
    codec that takes no longer than writing the text; each holds the documents of
    one task and week, which bounds what a reader, who cannot split it, takes at once."""
    picks = pick.groupBy("entry_id", "gw").agg(F.collect_list(F.struct(
        F.col("player_id").alias("element"), "position", "multiplier", "is_captain",
        "is_vice_captain")).alias("picks"))
    is_in = F.col("direction") == "in"
    subs = auto_sub.groupBy("entry_id", "gw").agg(
        F.array_sort(F.collect_list(F.when(is_in, F.col("player_id")))).alias("ins"),
        F.array_sort(F.collect_list(F.when(~is_in, F.col("player_id")))).alias("outs"))
    subs = subs.select("entry_id", "gw", F.transform(
        F.arrays_zip("ins", "outs"),
        lambda z: F.struct(z["ins"].alias("element_in"), z["outs"].alias("element_out"))).alias("automatic_subs"))
    history = F.struct(F.col("gw").alias("event"), F.col("total_points").alias("points"),
                       "points_on_bench", "event_transfers_cost")
    docs = (entry.select("entry_id", "gw", "active_chip", history.alias("entry_history"))
            .join(picks, ["entry_id", "gw"], "inner")
            .join(subs, ["entry_id", "gw"], "left"))
    docs.select("entry_id", "gw", "active_chip", "automatic_subs", "entry_history", "picks") \
        .write.partitionBy("gw").json(path, compression="lz4")


def land_bootstrap(player: DataFrame, half: int, path: str, chunk: int = PLAYERS_PER_DOC) -> None:
    """One season half's bootstrap, landed in bounded parts: the team list,
    the position list, and player chunks of at most ``chunk``.  Team and
    position ids are dense ranks of their names; a team's code is its id
    plus 100."""
    from pyspark.sql import Window

    p = player.where(F.col("half") == half)
    teams = p.select("team").distinct().withColumn(
        "id", F.dense_rank().over(Window.orderBy("team")).cast("int"))
    types = p.select("position").distinct().withColumn(
        "id", F.dense_rank().over(Window.orderBy("position")).cast("int"))
    team_doc = teams.groupBy().agg(F.collect_list(F.struct(
        "id", (F.col("id") + 100).alias("code"), F.col("team").alias("name"))).alias("teams"))
    type_doc = types.groupBy().agg(F.collect_list(F.struct(
        "id", F.col("position").alias("singular_name"))).alias("element_types"))
    first = F.regexp_extract("player_name", r"^(\S+)", 1)
    second = F.nullif(F.regexp_extract("player_name", r"^\S+\s(.*)$", 1), F.lit(""))
    el = (p.join(teams.withColumnRenamed("id", "team_id"), "team")
          .join(types.withColumnRenamed("id", "element_type"), "position")
          .select(F.floor(F.col("player_id") / chunk).alias("__chunk"), F.struct(
              F.col("player_id").alias("id"), (F.col("team_id") + 100).alias("team_code"),
              "element_type", first.alias("first_name"), second.alias("second_name")).alias("e")))
    el_doc = el.groupBy("__chunk").agg(F.collect_list("e").alias("elements")).drop("__chunk")
    parts = (team_doc.select(F.to_json(F.struct("teams")).alias("value"))
             .unionByName(type_doc.select(F.to_json(F.struct("element_types")).alias("value")))
             .unionByName(el_doc.select(F.to_json(F.struct("elements")).alias("value"))))
    parts.write.text(path)


def land_history_docs(history: DataFrame, path: str) -> None:
    """One history document per entry (its season: at most 38 weeks),
    keeping the request's entry id in the document."""
    row = F.struct(F.col("gameweek").alias("event"), "points",
                   F.col("total_points").cast("int").alias("total_points"), "rank",
                   "overall_rank", "event_transfers_cost", "points_on_bench",
                   *[c for c in ("bank", "value", "event_transfers") if c in history.columns])
    docs = history.groupBy("entry_id").agg(F.collect_list(row).alias("current"))
    docs.write.json(path)
