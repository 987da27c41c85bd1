"""What the league queries exchange, sort and recompute, read from their plans,
and the rows that the rewritten steps must keep."""

import datetime
import glob
import json
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from squadron.operators import contract, participants, picks, players, ranking
from squadron.plans import reports
from squadron.sources import documents, landing
from squadron.sources.testdata import TestTables, tables


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def formatted(df):
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(
        jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def exchanges(df):
    """(columns, arguments) of every exchange of the plan."""
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*?)\n", formatted(df))


def test_squads_take_one_exchange_behind_the_join(spark, sf_small, no_broadcast):
    # lines, orders, then the lines once by squad
    found = exchanges(TestTables(spark, sf_small).pick)
    assert len(found) == 3 and sum("entry_id" in a and "gw" in a for _, a in found) == 1


def test_points_are_looked_up_for_captains_and_vices_only(spark, no_broadcast):
    # F2
    pick = spark.createDataFrame([(1, 1, 10, 1, 2, True, False), (1, 1, 11, 2, 1, False, True), (1, 1, 12, 3, 1, None, False),
                                  (2, 1, 10, 1, 0, False, False), (3, 1, 13, 1, 2, True, None), (3, 1, 14, 2, 2, True, False)],
                                 "entry_id bigint, gw int, player_id bigint, position int, multiplier int, "
                                 "is_captain boolean, is_vice_captain boolean")
    score = spark.createDataFrame([(10, 1, 6), (11, 1, -2), (13, 1, 5), (14, 1, 3)],
                                  "player_id bigint, gameweek int, total_points int")
    df = picks.captain_vice_points(pick, score)
    assert sorted(map(tuple, df.collect())) == [(1, 1, 10, 11, 12, -2), (2, 1, None, None, 0, 0), (3, 1, 14, None, 10, 0)]
    plan = formatted(df)
    below = [c for c in re.findall(r"Condition : (.*)", plan) if "is_captain" in c and "is_vice_captain" in c]
    assert below, "the picks are not filtered by role"


def test_scores_are_not_aggregated_before_the_exchange(spark, sf_small, no_broadcast):
    # F11, F12, F13
    found = exchanges(TestTables(spark, sf_small).score)
    by_player = [cols for cols, a in found if "player_id" in a and "gameweek" in a]
    assert len(by_player) == 1 and "sum#" not in by_player[0]


def test_names_are_not_ranked(spark, sf_small, no_broadcast):
    # a member's names are exchanged once, not a week
    found = exchanges(TestTables(spark, sf_small).standings)
    assert [a for c, a in found if "total" in c]
    assert not [a for c, a in found if "entry_name" in c and "gw" in c]


def test_memberships_listed_twice_keep_both_names(spark, tmp_path):
    day = datetime.datetime(1995, 1, 5)
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "c", 0)],
                          "c_custkey bigint, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 1, 50000.0, day, "3"), (2, None, 5000.0, day, "3"), (3, 2, 10000.0, None, "3")],
                          "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp, "
                          "o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    s = TestTables(spark, str(tmp_path)).standings
    assert s.count() == 3 * 38
    first = s.where("gw = 1").orderBy("rank")
    assert [tuple(r) for r in first.select("entry", "event_total", "total", "rank").collect()] == [
        (1, 10, 20, 1), (1, 10, 10, 2), (2, 0, 0, 3)]
    assert sorted(r.entry_name for r in first.collect()) == ["a", "b", "c"]


def test_numbering_precedes_the_merge_of_offsets(spark, no_broadcast):
    # the rows are sorted once, for the numbering and the merge
    df = spark.createDataFrame([(k % 2, k % 5, k) for k in range(40)], "g int, score int, entry bigint")
    ranked = ranking.position_rank(df, ["g"], "score", "entry", out="r")
    top = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert top.index("Join") < top.index("row_number()")


def test_report_documents_share_the_week_frame(spark, sf_small, monkeypatch):
    # one weekly frame, and no second copy of the items
    t = tables(spark, sf_small).materialize_all()
    staged = []
    real = reports.stage_table
    monkeypatch.setattr(reports, "stage_table", lambda df, name="stage": staged.append(name) or real(df, name))
    import squadron.session as session
    ranks = []
    monkeypatch.setattr(session, "stage_table", lambda df, name="stage": ranks.append(name) or real(df, name))
    docs = reports.league_report_documents(t)
    assert staged == ["weekly_scores", "entry_transfer_join", "report-items"] and "rank_input" not in ranks
    assert not [f for f in docs.inputFiles() if "/pick0" in f]


def test_season_counts_captains_in_one_exchange(spark, sf_small, no_broadcast):
    # F3
    t = tables(spark, sf_small)
    found = [c for c, a in exchanges(participants.season_wrap(t.entry, t.pick, t.score)) if a.startswith("hashpartitioning(entry_id")]
    assert not [c for c in found if "min#" in c or "collect" in c or "buf#" in c]


def test_overall_rank_is_staged(spark, sf_small):
    # the distinct weeks are computed once, for both passes of the rank
    t = tables(spark, sf_small)
    df = participants.participant_history(t.standings, t.entry)
    assert [f for f in df.inputFiles() if "/stage/rank_input" in f]


def test_small_groups_are_left_out_before_picks_are_read(spark):
    # F9
    squads = spark.createDataFrame([(1, 1, 7, 1), (1, 1, 7, 2), (1, 1, 8, 3), (1, 1, None, 4), (1, 1, None, 5)],
                                   "league_id int, gameweek int, captain bigint, entry_id bigint")
    pick = spark.createDataFrame([(1, 1, 7), (1, 1, 9), (2, 1, 7), (3, 1, 8)], "entry_id bigint, gw int, player_id bigint")
    df = participants.common_to(squads, pick, ["league_id", "gameweek", "captain"], least=2)
    assert [tuple(r) for r in df.collect()] == [(1, 1, 7, 7, 2)]


def test_report_takes_payloads_of_starters_only(spark, sf_small, no_broadcast):
    # no partly filled lists are exchanged
    t = tables(spark, sf_small)
    df = participants.participant_report(t.entry, t.pick, t.score, t.player, t.auto_sub)
    by_squad = [c for c, a in exchanges(df) if a.startswith("hashpartitioning(entry_id") and "position" in c]
    assert len(by_squad) == 1 and "payload" in by_squad[0]


def test_key_paths_exchange_counts_only(spark):
    # one parse of a document, and no (document, path) pairs exchanged
    docs = spark.createDataFrame([('{"a": 1, "b": {"c": null, "d": [{"e": 1}, {"e": 2, "f": [[{"g": 1}]]}]}}',), ("nope",), (None,),
                                  ('[{"a": 1}]',), ('{"a": "{\\"z\\": 1}", "k[]": {"z": 1}}',)], "value string")
    df = contract.key_paths(docs, "value", "s")
    assert len(exchanges(df)) == 1
    assert {r.field: r.docs for r in df.collect()} == {
        "a": 2, "b": 1, "b.c": 1, "b.d": 1, "b.d[].e": 1, "b.d[].f": 1, "b.d[].f[][].g": 1, "[].a": 1, "k[].z": 1}


def test_key_paths_parse_a_document_once(spark, monkeypatch):
    # F1 of r04: a filter inferred from the explode opened every level again, from the text
    monkeypatch.setattr(contract, "stage_table", lambda df, name: df, raising=False)
    docs = spark.createDataFrame([('{"a": {"b": 1}}',)], "value string")
    assert len(re.findall(r"parseJson\(", formatted(contract.key_paths(docs, "value", "s")))) == 1


def test_key_paths_of_odd_documents(spark):
    # F1 of r04: against a plain walk; lists of mixed kinds, names that a schema's text must quote, the depth's limit
    docs = [{"k": [{"a": 1}, {"a": "x"}]}, {"k": [{"a": [1]}, {"a": {"b": 2}}], "z": [1, {"c": [{"d": None}]}]}, [[{"a": 1}], [], {"b": {}}],
            {"a b": 1, "c`d": {"e>, f: OBJECT<": [1.5, 2]}, "": {"": 0, "a": 1}, "9": [], "``": {"x:": 1}, "`": 2, ":": {"::": 3}},
            {"k[]": {"z": 1}, "k": [{"z": 1}]}, {"VARIANT": {"a": [{"b": 1}]}, "ARRAY": {"OBJECT": 1}}, {"A": 1, "a": {"x": None}},
            {"k": [None, {"a": None}, {"a": {"b": 1}}]}, {"q\"\n\t": {"\\": 1}, "\u00e9": {"\u00e9": 1}}, 3, None, "s", [], {}, [[[[{"deep": 1}]]]],
            [[[{"deep": {"er": 1}}, 2]]], {"a": {"b": {"c": {"d": {"e": 1}}}}}, {"n": 10**40, "m": 1.25, "o": [10**25, 1.5, True]}]

    def walk(v, path, depth):
        if depth and isinstance(v, dict):
            for k, x in v.items():
                here = k if path == "" else f"{path}.{k}"
                yield here
                yield from walk(x, here, depth - 1)
        elif depth and isinstance(v, list):
            for x in v:
                yield from walk(x, f"{path}[]", depth - 1)

    texts = [json.dumps(d) for d in docs] * 2 + ["no json", "", None, '{"a": 1, "a": 2}', '{"a": 1']
    rows = spark.createDataFrame([(t,) for t in texts], "value string").repartition(3)
    for depth in (1, 4, 8):
        want = Counter(p for d in docs * 2 for p in set(walk(d, "", depth)) if not p.endswith("[]"))
        got = [tuple(r) for r in contract.key_paths(rows, "value", "s", depth).select("field", "docs").collect()]
        assert len(got) == len(want) and dict(got) == want



def test_leaders_sort_values_not_rows(spark):
    # F11
    score = spark.createDataFrame([(2, 1, 5, 1.0), (1, 1, 5, 0.5), (3, 1, None, None), (None, 2, 4, 2.0), (6, 2, 4, 2.0)],
                                  "player_id bigint, gameweek int, total_points int, expected_goals double")
    player = spark.createDataFrame([(1, 1, "x", "t")], "player_id bigint, half int, player_name string, team string")
    df = players.gameweek_leaders(score, player, metrics=["total_points", "expected_goals"])
    got = {(r.gameweek, r.metric): (r.player_id, r.value) for r in df.collect()}
    assert got == {(1, "total_points"): (1, 5.0), (1, "expected_goals"): (2, 1.0),
                   (2, "total_points"): (None, 4.0), (2, "expected_goals"): (None, 2.0)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"WindowGroupLimit.*\n.*Aggregate", plan)


def live_rows(spark):
    return spark.range(4000).select(
        (F.col("id") % 1000).alias("player_id"), (F.col("id") / 1000).cast("int").alias("gameweek"),
        (F.col("id") * 7 % 23 - 3).cast("int").alias("total_points"), (F.col("id") * 13 % 91).cast("int").alias("minutes"),
        (F.col("id") * 31 % 997 / 10).cast("decimal(8,1)").alias("influence"), (F.col("id") % 3 == 0).alias("in_dreamteam"),
        (F.col("id") % 380).alias("fixture"))


def test_landed_weeks_are_compressed(spark, tmp_path):
    # a document's keys repeat with every player
    path = str(tmp_path / "weeks")
    landing.land_gameweek_docs(live_rows(spark), path)
    kept = sum(os.path.getsize(f) for f in glob.glob(f"{path}/gameweek=*/part-*"))
    plain = spark.read.text(path).agg(F.sum(F.octet_length("value"))).first()[0]
    assert kept * 5 < plain
    for multi_line in (False, True):
        e = documents.gameweek_explain(spark, path, multi_line)
        assert e.exceptAll(live_rows(spark).select("player_id", "gameweek", "total_points", F.col("minutes").alias("value"),
                                                   F.col("fixture").cast("int"))).count() == 0
        assert e.count() == 4000


def test_landed_picks_are_compressed(spark, tmp_path):
    # F1 of r04: a document's keys repeat with every pick
    pick = spark.range(4500).select(
        (F.col("id") / 15 % 100).cast("bigint").alias("entry_id"), (F.col("id") / 1500).cast("int").alias("gw"),
        (F.col("id") * 7 % 700).alias("player_id"), (F.col("id") % 15 + 1).cast("int").alias("position"),
        F.when(F.col("id") % 15 < 11, 1).otherwise(0).alias("multiplier"), (F.col("id") % 15 == 0).alias("is_captain"),
        (F.col("id") % 15 == 1).alias("is_vice_captain"))
    entry = pick.groupBy("entry_id", "gw").agg(F.lit(None).cast("string").alias("active_chip"), F.sum("player_id").cast("int").alias("total_points"),
                                               F.lit(0).alias("points_on_bench"), F.lit(0).alias("event_transfers_cost"))
    subs = spark.createDataFrame([(3, 1, 10, "in"), (3, 1, 11, "out"), (4, 2, 12, "in")],
                                 "entry_id bigint, gw int, player_id bigint, direction string")
    path = str(tmp_path / "picks")
    landing.land_picks_docs(pick, entry, subs, path)
    kept = sum(os.path.getsize(f) for f in glob.glob(f"{path}/gw=*/part-*"))
    assert kept * 4 < spark.read.text(path).agg(F.sum(F.octet_length("value"))).first()[0]
    got = documents.picks_long(spark, path, multi_line=False, entry_in_doc=True)
    assert got.select(*pick.columns).exceptAll(pick).count() == 0 and got.count() == 4500
    assert documents.auto_subs(spark, path, multi_line=False, entry_in_doc=True).select(*subs.columns).exceptAll(subs).count() == 0
    seen = {r.field: r.docs for r in contract.key_paths(spark.read.text(path), "value", "picks").collect()}
    assert seen["picks[].element"] == 300 and seen["automatic_subs[].element_in"] == 2 and seen["automatic_subs[].element_out"] == 1


def test_live_rows_are_nested_behind_the_exchange(spark, no_broadcast):
    # flat rows are exchanged once, and no partly filled lists
    score = live_rows(spark).select("*", F.col("player_id").cast("string").alias("ict_index"), F.col("minutes").alias("unknown"))
    docs = landing.gameweek_docs(score, chunk=300)
    (cols, dealt), = exchanges(docs)
    assert dealt.startswith("hashpartitioning(gameweek") and "REPARTITION_BY_NUM" in dealt
    assert re.sub(r"#\d+L?", "", cols).split(", ") == [
        "gameweek", "__chunk", "player_id", "minutes", "total_points", "influence", "ict_index", "in_dreamteam", "fixture"]
    assert docs.count() == 4 * 4 and docs.where(F.size("elements") > 300).count() == 0


def test_live_rows_keep_nulls_and_repeats(spark, tmp_path):
    # F13
    rows = [(1, 1, 5, 90, True), (1, 1, 5, 90, True), (None, 1, 2, None, None), (2, None, None, 0, False), (None, None, 1, 1, True)]
    score = spark.createDataFrame(rows, "player_id bigint, gameweek int, total_points int, minutes int, in_dreamteam boolean")
    path = str(tmp_path / "weeks")
    landing.land_gameweek_docs(score, path)
    s = documents.gameweek_scores(spark, path, multi_line=False)
    assert s.select(*score.columns).exceptAll(score).count() == 0 and s.count() == 5
    e = documents.gameweek_explain(spark, path, multi_line=False)
    assert e.where("fixture IS NOT NULL").count() == 0 and e.count() == 5
