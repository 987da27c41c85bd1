"""Readers for landed API documents.

The reference fetches these over HTTP one entry or page at a time; here they
are files in a landing folder, read in one distributed scan with an explicit
schema.  Path parameters (gameweek, entry, league, page) come from
``key=value`` directories via Spark's partition discovery, so one read
covers any number of gameweeks, entries or pages (S15, U2).

``multi_line=True`` reads one pretty-printed document per file (as the API
returns it); ``False`` reads JSON Lines (one document per line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squadron import schemas
from squadron.functions.dims import bounded_broadcast
from squadron.functions.lists import ids_csv, tenths
from squadron.sources.sinks import append

DEC = "decimal(8,2)"


def _read(spark: SparkSession, path: str, schema: T.StructType, partitions: dict[str, T.DataType],
          multi_line: bool) -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(k, v) for k, v in partitions.items()])
    r = spark.read.schema(full).option("multiLine", multi_line)
    if partitions:
        r = r.option("basePath", path)
    return r.json(path)


def gameweek_scores(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``<path>/gameweek=<n>/*.json`` live documents -> one row
    per (player, gameweek) with every stat; text decimals cast at ingest (F14)."""
    return score_rows(_read(spark, path, schemas.GAMEWEEK_DOC, {"gameweek": T.IntegerType()}, multi_line))


def score_rows(doc: DataFrame, *keep: str) -> DataFrame:
    """The players' rows of live documents (gameweek, elements); the document's
    ``keep`` columns stay beside them."""
    e = doc.select("gameweek", *keep, F.explode("elements").alias("e"))
    cols = [F.col("e.id").alias("player_id"), "gameweek"]
    cols += [F.col(f"e.stats.{c}").alias(c) for c in schemas.STAT_INT]
    cols += [F.col(f"e.stats.{c}").cast(DEC).alias(c) for c in schemas.STAT_DECIMAL_TEXT]
    cols.append(F.col("e.stats.in_dreamteam").alias("in_dreamteam"))
    return e.select(*cols, *keep)


def gameweek_explain(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S1 plus the first explain block's fixture and first stat value."""
    doc = _read(spark, path, schemas.GAMEWEEK_DOC, {"gameweek": T.IntegerType()}, multi_line)
    e = doc.select("gameweek", F.explode("elements").alias("e"))
    first = F.try_element_at(F.col("e.explain"), F.lit(1))
    return e.select(F.col("e.id").alias("player_id"), "gameweek",
                    F.col("e.stats.total_points").alias("total_points"),
                    F.try_element_at(first["stats"], F.lit(1))["value"].alias("value"),
                    first["fixture"].alias("fixture"))


def player_info(spark: SparkSession, path: str, half: int, multi_line: bool = True) -> DataFrame:
    """S3: bootstrap elements joined to teams (by code) and element types,
    first and second name concatenated (H7), stamped with the season half.
    Teams and element types are small lists (20 and 4), broadcast after a
    size check."""
    doc = _read(spark, path, schemas.BOOTSTRAP_DOC, {}, multi_line)
    # a landing may split one bootstrap into several parts; the small lists
    # are de-duplicated so joins never multiply player rows
    teams = doc.select(F.explode("teams").alias("t")).select(
        F.col("t.code").alias("team_code"), F.col("t.name").alias("team"),
        F.col("t.id").alias("team_id")).distinct()
    types = doc.select(F.explode("element_types").alias("t")).select(
        F.col("t.id").alias("element_type"), F.col("t.singular_name").alias("position")).distinct()
    el = doc.select(F.explode("elements").alias("e")).select(
        F.col("e.id").alias("player_id"), F.col("e.team_code").alias("team_code"),
        F.col("e.element_type").alias("element_type"),
        F.concat_ws(" ", "e.first_name", "e.second_name").alias("player_name"))
    return (el.join(bounded_broadcast(teams), "team_code", "left")
            .join(bounded_broadcast(types), "element_type", "left")
            .select("player_id", "team", "team_code", "team_id", "position", "player_name",
                    F.lit(half).alias("half")))


def gameweek_events(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Bootstrap events -> gameweek status rows (input of F10 / F11)."""
    doc = _read(spark, path, schemas.BOOTSTRAP_DOC, {}, multi_line)
    return doc.select(F.explode("events").alias("e")).select("e.*").withColumnRenamed("id", "gameweek")


def fixtures(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Fixtures list renamed to the game-view columns (F1 input)."""
    doc = spark.read.schema(schemas.FIXTURE_DOC).option("multiLine", multi_line).json(path)
    return doc.select(
        F.col("team_h_difficulty").alias("homedifficulty"), F.col("team_a_difficulty").alias("awaydifficulty"),
        F.col("team_h").alias("home"), F.col("team_a").alias("away"),
        F.col("team_h_score").alias("homegoals"), F.col("team_a_score").alias("awaygoals"),
        "code", F.col("event").alias("gameweek"), "finished", F.col("kickoff_time").alias("date"))


def _picks_docs(spark, path, multi_line, entry_in_doc=False):
    """Picks documents under ``entry_id=<e>/gw=<n>/``; with ``entry_in_doc``
    the landing kept the request's entry id in each document and only the
    gameweek is a folder (``gw=<n>/``)."""
    if entry_in_doc:
        body = T.StructType(schemas.PICKS_DOC.fields + [T.StructField("entry_id", T.LongType())])
        return _read(spark, path, body, {"gw": T.IntegerType()}, multi_line)
    return _read(spark, path, schemas.PICKS_DOC,
                 {"entry_id": T.LongType(), "gw": T.IntegerType()}, multi_line)


def picks_long(spark: SparkSession, path: str, multi_line: bool = True,
               entry_in_doc: bool = False) -> DataFrame:
    """S5 (long): ``<path>/entry_id=<e>/gw=<n>/*.json`` picks documents ->
    the ``pick`` domain table, one row per (entry, week, player)."""
    d = _picks_docs(spark, path, multi_line, entry_in_doc)
    return d.select("entry_id", "gw", F.explode("picks").alias("p")).select(
        "entry_id", "gw", F.col("p.element").alias("player_id"), F.col("p.position").alias("position"),
        F.col("p.multiplier").alias("multiplier"), F.col("p.is_captain").alias("is_captain"),
        F.col("p.is_vice_captain").alias("is_vice_captain"))


def entry_rows(spark: SparkSession, path: str, multi_line: bool = True,
               entry_in_doc: bool = False) -> DataFrame:
    """S5 (entry row, as the reference builds it): chip, points, bench points,
    transfer cost, starters / bench as CSV in pick order, captain, vice and
    auto-subs as CSV.  Lists come from the document's own array, so no
    shuffle is needed."""
    return entry_rows_of(_picks_docs(spark, path, multi_line, entry_in_doc))


def entry_rows_of(d: DataFrame) -> DataFrame:
    """``entry_rows`` of picks documents that are read already."""
    srt = F.array_sort(F.col("picks"), lambda a, b: a["position"] - b["position"])
    starters = F.transform(F.filter(srt, lambda p: p["multiplier"] != 0), lambda p: p["element"])
    bench = F.transform(F.filter(srt, lambda p: p["multiplier"] == 0), lambda p: p["element"])
    cap = F.filter("picks", lambda p: p["is_captain"])
    vice = F.filter("picks", lambda p: p["is_vice_captain"])
    subs = F.coalesce(F.col("automatic_subs"), F.array())
    return d.select(
        "entry_id", "gw", "active_chip",
        F.col("entry_history.points").alias("total_points"),
        F.col("entry_history.points_on_bench").alias("points_on_bench"),
        F.col("entry_history.event_transfers_cost").alias("event_transfers_cost"),
        ids_csv(starters).alias("players"), ids_csv(bench).alias("bench"),
        F.try_element_at(cap, F.lit(1))["element"].alias("captain"),
        F.try_element_at(vice, F.lit(1))["element"].alias("vice_captain"),
        ids_csv(F.transform(subs, lambda s: s["element_in"])).alias("auto_sub_in"),
        ids_csv(F.transform(subs, lambda s: s["element_out"])).alias("auto_sub_out"))


def entry_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S5 -> the ``entry`` domain table."""
    return entry_rows(spark, path, multi_line).select(
        "entry_id", "gw", "active_chip", "total_points", "points_on_bench", "event_transfers_cost")


def auto_subs(spark: SparkSession, path: str, multi_line: bool = True,
              entry_in_doc: bool = False) -> DataFrame:
    """S5 -> the ``auto_sub`` domain table (one row per player in / out)."""
    d = _picks_docs(spark, path, multi_line, entry_in_doc)
    s = d.select("entry_id", "gw", F.explode("automatic_subs").alias("s"))
    both = F.explode(F.array(F.struct(F.col("s.element_in").alias("player_id"), F.lit("in").alias("direction")),
                             F.struct(F.col("s.element_out").alias("player_id"), F.lit("out").alias("direction"))))
    return (s.select("entry_id", "gw", both.alias("x"))
            .select("entry_id", "gw", "x.player_id", "x.direction")
            .where(F.col("player_id").isNotNull()))


def transfers(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Transfers lists (one JSON array per file, or per line without
    ``multi_line``) -> the ``transfer`` domain table.

    The source carries no id but lists newest first, so ``transfer_id`` counts
    from the end of its list: of two transfers at the same time the one listed
    later is the earlier (W5), and lists sorted by (time, id) descending keep
    the document's order (A10).  Ids are unique within a document."""
    rows = (spark.read.text(path, wholetext=multi_line)
            .select(F.from_json("value", T.ArrayType(schemas.TRANSFER_DOC)).alias("l"))
            .select(F.size("l").alias("n"), F.posexplode("l").alias("at", "t")))
    return rows.select((F.col("n") - 1 - F.col("at")).cast("bigint").alias("transfer_id"),
                       *[f"t.{c}" for c in ("entry", "event", "time", "element_in", "element_out",
                                            "element_in_cost", "element_out_cost")])


def league_participants(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every standings page of every league
    (``<path>/league_id=<l>/page=<p>.json``) as one union, deduplicated on
    (league, entry) keeping the latest page."""
    doc = _read(spark, path, schemas.LEAGUE_DOC, {"league_id": T.LongType()}, multi_line)
    rows = doc.select("league_id", F.col("league.name").alias("league_name"),
                      F.col("standings.page").alias("page"),
                      F.explode("standings.results").alias("r"))
    flat = rows.select("league_id", "league_name", "page", F.col("r.entry").alias("entry"),
                       F.col("r.entry_name").alias("entry_name"), F.col("r.player_name").alias("player_name"),
                       F.col("r.rank").alias("rank"), F.col("r.last_rank").alias("last_rank"),
                       F.col("r.total").alias("total"), F.col("r.event_total").alias("event_total"))
    latest = F.max_by(F.struct("league_name", "entry_name", "player_name", "rank", "last_rank",
                               "total", "event_total"), F.col("page"))
    return flat.groupBy("league_id", "entry").agg(latest.alias("x")).select("league_id", "entry", "x.*")


def league_page_gaps(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S7, completeness: (league_id, page, problem) for every page that a
    league's landed pages show to be lacking.  ``missing``: a page below the
    last one landed; ``unfinished``: the page behind the last one landed, where
    that one says that there is a next."""
    doc = _read(spark, path, schemas.LEAGUE_DOC, {"league_id": T.LongType()}, multi_line)
    # A page may have landed several times; its last word on a next page is unknown, so any yes counts.
    pages = (doc.select("league_id", F.col("standings.page").alias("page"), F.col("standings.has_next").alias("has_next"))
             .where("page is not null").groupBy("league_id", "page").agg(F.bool_or("has_next").alias("has_next")))
    by = Window.partitionBy("league_id").orderBy("page")
    seen = pages.select("league_id", "page", "has_next", F.coalesce(F.lag("page").over(by), F.lit(0)).alias("before"),
                        F.lead("page").over(by).isNull().alias("last"))
    gap = F.when(F.col("page") - F.col("before") > 1, F.sequence(F.col("before") + 1, F.col("page") - 1))
    missing = seen.select("league_id", F.explode(gap).alias("page"), F.lit("missing").alias("problem"))
    unfinished = seen.where(F.col("last") & F.col("has_next")).select(
        "league_id", (F.col("page") + 1).alias("page"), F.lit("unfinished").alias("problem"))
    return missing.union(unfinished)


def checked_picks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Every picks document that has landed, with its text, its file
    and ``reason``: why it cannot be used, or null.

    ``empty``: no text; ``malformed``: no JSON object, or cut short; ``error``:
    an object without picks, such as the API's error message; ``no squad``: an
    empty list of picks (Q6); ``wrong type``: a field that the schema cannot
    hold.  A document with a reason never becomes a row of nulls.  The entry is
    that of the document, else of the folder, else what a damaged text still names."""
    body = T.StructType([*schemas.PICKS_DOC.fields, T.StructField("entry_id", T.LongType()),
                         T.StructField("_corrupt", T.StringType())])
    text = F.trim(F.col("value"), F.lit(" \t\r\n"))
    keys = F.json_object_keys(text)
    reason = (F.when(text == "", "empty").when(keys.isNull(), "malformed")
              .when(~F.array_contains(keys, "picks"), "error").when(F.col("d._corrupt").isNotNull(), "wrong type")
              .when(F.coalesce(F.size("d.picks"), F.lit(0)) < 1, "no squad"))
    raw = spark.read.text(path, wholetext=multi_line).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("d", F.from_json("value", body, {"columnNameOfCorruptRecord": "_corrupt"}))
    key = lambda name: F.nullif(F.regexp_extract("file", name + r"=(\d+)", 1), F.lit("")).cast("bigint")
    named = F.nullif(F.regexp_extract("value", r'"entry_id"\s*:\s*(\d+)', 1), F.lit("")).try_cast("bigint")
    return parsed.select(F.coalesce("d.entry_id", key("entry_id"), named).alias("entry_id"), key("gw").cast("int").alias("gw"),
                         "file", "value", F.col("d").dropFields("_corrupt", "entry_id").alias("doc"), reason.alias("reason"))


def quarantine(checked: DataFrame, path: str, requested: DataFrame | None = None) -> DataFrame:
    """Append the documents that cannot be used, with file, text and reason, to
    the quarantine table, and those ``requested`` (entry_id, gw) that never
    landed as ``absent``; returns the usable ones."""
    bad = checked.where("reason is not null").select("entry_id", "gw", "file", F.col("value").alias("text"), "reason")
    if requested is not None:
        lacking = requested.select("entry_id", "gw").join(checked.select("entry_id", "gw"), ["entry_id", "gw"], "left_anti")
        bad = bad.unionByName(lacking.withColumn("reason", F.lit("absent")), allowMissingColumns=True)
    append(bad, path, partition_by="reason")
    return checked.where("reason is null").select("entry_id", "gw", "doc.*")


def participant_history(spark: SparkSession, path: str, multi_line: bool = True,
                        entry_in_doc: bool = False) -> DataFrame:
    """``<path>/entry_id=<e>/*.json`` history documents -> weekly rows;
    bank and value are held in tenths (H11).  With ``entry_in_doc`` the
    landing kept the request's entry id in each document instead."""
    if entry_in_doc:
        body = T.StructType(schemas.HISTORY_DOC.fields + [T.StructField("entry_id", T.LongType())])
        doc = _read(spark, path, body, {}, multi_line)
    else:
        doc = _read(spark, path, schemas.HISTORY_DOC, {"entry_id": T.LongType()}, multi_line)
    c = doc.select("entry_id", F.explode("current").alias("c"))
    return c.select("entry_id", F.col("c.event").alias("gameweek"), F.col("c.points").alias("points"),
                    F.col("c.total_points").alias("total_points"), F.col("c.rank").alias("rank"),
                    F.col("c.overall_rank").alias("overall_rank"),
                    tenths("c.bank").alias("bank"), tenths("c.value").alias("value"),
                    F.col("c.event_transfers").alias("event_transfers"),
                    F.col("c.points_on_bench").alias("points_on_bench"))
