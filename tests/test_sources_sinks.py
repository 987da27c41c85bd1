"""JSON document sources (S1-S8, S14, S15), sinks (K1-K6), the refresh
stream and the schema contract (C1) on small synthetic documents."""

import json
import os

import pytest
from pyspark.sql import functions as F

from squadron.operators import contract
from squadron.sources import documents, sinks
from squadron.streaming.refresh import start_gameweek_refresh
from squadron import schemas


def _stats(points, minutes=90, xg="0.35"):
    s = {k: 0 for k in schemas.STAT_INT}
    s.update({k: "0.0" for k in schemas.STAT_DECIMAL_TEXT})
    s.update(total_points=points, minutes=minutes, expected_goals=xg, in_dreamteam=points > 10)
    return s


def _write(path, doc):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)


def _live(root, gw, players, name="live.json"):
    _write(f"{root}/gameweek={gw}/{name}", {"elements": [
        {"id": pid, "stats": _stats(pts), "explain": [{"fixture": 100 + gw, "stats": [
            {"identifier": "minutes", "points": 2, "value": 90}]}]} for pid, pts in players]})


def test_gameweek_documents(spark, tmp_path):
    root = str(tmp_path / "live")
    _live(root, 1, [(1, 6), (2, 12)])
    _live(root, 2, [(1, 3)])
    s = documents.gameweek_scores(spark, root)
    got = sorted((r.player_id, r.gameweek, r.total_points, float(r.expected_goals)) for r in s.collect())
    assert got == [(1, 1, 6, 0.35), (1, 2, 3, 0.35), (2, 1, 12, 0.35)]
    e = documents.gameweek_explain(spark, root).where("gameweek = 1 AND player_id = 1").collect()[0]
    assert (e.value, e.fixture) == (90, 101)


def test_bootstrap_player_info_and_events(spark, tmp_path):
    p = str(tmp_path / "boot.json")
    _write(p, {"events": [{"id": 1, "is_current": False, "finished": True, "data_checked": True,
                           "chip_plays": [{"chip_name": "wildcard", "num_played": 4}],
                           "highest_scoring_entry": 9, "average_entry_score": 50},
                          {"id": 2, "is_current": True, "finished": False, "data_checked": False,
                           "chip_plays": [], "highest_scoring_entry": None, "average_entry_score": 0}],
               "teams": [{"id": 1, "code": 3, "name": "Alpha", "short_name": "ALP"}],
               "element_types": [{"id": 1, "singular_name": "Goalkeeper"}],
               "elements": [{"id": 5, "team_code": 3, "element_type": 1, "first_name": "Ann",
                             "second_name": "Lee"}]})
    r = documents.player_info(spark, p, half=2).collect()[0]
    assert (r.player_id, r.team, r.team_id, r.position, r.player_name, r.half) == (
        5, "Alpha", 1, "Goalkeeper", "Ann Lee", 2)
    cur = documents.gameweek_events(spark, p).where("is_current").collect()[0]
    assert cur.gameweek == 2


def test_picks_transfers_standings_history(spark, tmp_path):
    picks_root = str(tmp_path / "picks")
    _write(f"{picks_root}/entry_id=7/gw=3/picks.json", {
        "active_chip": None, "automatic_subs": [{"element_in": 14, "element_out": 2}],
        "entry_history": {"event": 3, "points": 55, "total_points": 150, "rank": 1, "rank_sort": 1,
                          "overall_rank": 10, "percentile_rank": 1, "bank": 5, "value": 1000,
                          "event_transfers": 1, "event_transfers_cost": 0, "points_on_bench": 4},
        "picks": [{"element": e, "position": i, "multiplier": 0 if i > 11 else (2 if i == 1 else 1),
                   "is_captain": i == 1, "is_vice_captain": i == 2, "element_type": 1}
                  for i, e in enumerate(range(1, 16), 1)]})
    row = documents.entry_rows(spark, picks_root).collect()[0]
    assert row.players == ",".join(map(str, range(1, 12))) and row.bench == "12,13,14,15"
    assert (row.captain, row.vice_captain, row.auto_sub_in, row.total_points) == (1, 2, "14", 55)
    assert documents.picks_long(spark, picks_root).count() == 15
    assert {r.direction for r in documents.auto_subs(spark, picks_root).collect()} == {"in", "out"}

    tr = str(tmp_path / "transfers" / "entry_7.json")
    _write(tr, [{"element_in": 3, "element_in_cost": 50, "element_out": 4, "element_out_cost": 45,
                 "entry": 7, "event": 3, "time": "2024-01-02T10:00:00Z"},
                {"element_in": 5, "element_in_cost": 60, "element_out": 6, "element_out_cost": 55,
                 "entry": 7, "event": 2, "time": "2024-01-01T10:00:00Z"}])
    t = documents.transfers(spark, str(tmp_path / "transfers"))
    assert sorted((r.event, r.element_in) for r in t.collect()) == [(2, 5), (3, 3)]

    lg = str(tmp_path / "leagues")
    for page, entries in ((1, [7, 8]), (2, [8, 9])):
        _write(f"{lg}/league_id=42/page{page}.json", {
            "league": {"id": 42, "name": "Office"},
            "standings": {"has_next": page == 1, "page": page, "results": [
                {"id": e, "event_total": 50, "player_name": f"m{e}", "rank": e, "last_rank": e + 1,
                 "rank_sort": e, "total": 100, "entry": e, "entry_name": f"t{e}"} for e in entries]}})
    parts = documents.league_participants(spark, lg)
    assert sorted(r.entry for r in parts.collect()) == [7, 8, 9]  # pages unioned, deduplicated

    hist = str(tmp_path / "history")
    _write(f"{hist}/entry_id=7/history.json", {"current": [
        {"event": 1, "points": 60, "total_points": 60, "rank": 1, "rank_sort": 1, "overall_rank": 5,
         "percentile_rank": 1, "bank": 15, "value": 1002, "event_transfers": 0,
         "event_transfers_cost": 0, "points_on_bench": 3}], "past": [], "chips": []})
    h = documents.participant_history(spark, hist).collect()[0]
    assert (h.gameweek, h.bank, h.value) == (1, 1.5, 100.2)


def test_refresh_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "scores")
    base = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (1, 2, 7)], "player_id long, gameweek int, total_points int")
    sinks.refresh_gameweeks(base, path)
    new = spark.createDataFrame([(1, 2, 9), (3, 2, 1)], "player_id long, gameweek int, total_points int")
    sinks.refresh_gameweeks(new, path)
    once = sorted(map(tuple, spark.read.parquet(path).select("player_id", "gameweek", "total_points").collect()))
    sinks.refresh_gameweeks(new, path)
    twice = sorted(map(tuple, spark.read.parquet(path).select("player_id", "gameweek", "total_points").collect()))
    assert once == twice == [(1, 1, 5), (1, 2, 9), (2, 1, 6), (3, 2, 1)]
    sql_form = sorted(map(tuple, sinks.refreshed(base, new).collect()))
    assert sql_form == once


def test_append_replace_ensure_and_json(spark, tmp_path):
    df = spark.range(5).withColumn("gameweek", (F.col("id") % 2).cast("int"))
    p = str(tmp_path / "t")
    sinks.append(df, p, partition_by="gameweek", max_records_per_file=2)
    sinks.append(df, p, partition_by="gameweek")
    assert spark.read.parquet(p).count() == 10
    sinks.replace(df, p + "_r")
    sinks.replace(df, p + "_r")
    assert spark.read.parquet(p + "_r").count() == 5
    empty = sinks.ensure_table(spark, p + "_e", df.schema)
    assert empty.count() == 0 and empty.columns == df.columns
    sinks.write_json(df.select(F.to_json(F.struct("*")).alias("j")), p + "_j", column="j")
    assert spark.read.json(p + "_j").count() == 5


def test_refresh_stream(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    _live(landing, 1, [(1, 6), (2, 12)])
    q = start_gameweek_refresh(spark, landing, table, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    # a full re-delivery of week 1 (new file) and week 2 land later
    _live(landing, 1, [(1, 8), (2, 12)], name="live-v2.json")
    _live(landing, 2, [(1, 3)])
    q = start_gameweek_refresh(spark, landing, table, str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = sorted((r.player_id, r.gameweek, r.total_points)
                 for r in spark.read.parquet(table).collect())
    assert got == [(1, 1, 8), (1, 2, 3), (2, 1, 12)]


def test_refresh_stream_keeps_newest_row_of_each_player(spark, tmp_path):
    import os

    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")

    def run():
        start_gameweek_refresh(spark, landing, table, str(tmp_path / "ckpt")).awaitTermination(120)
        return sorted((r.player_id, r.gameweek, r.total_points) for r in spark.read.parquet(table).collect())

    _live(landing, 1, [(1, 5)], name="a.json")
    assert run() == [(1, 1, 5)]
    # the rest of the gameweek lands in a later batch
    _live(landing, 1, [(2, 7)], name="b.json")
    assert run() == [(1, 1, 5), (2, 1, 7)]
    # two versions of one document in a batch: the one changed last counts
    _live(landing, 1, [(1, 9)], name="c.json")
    _live(landing, 1, [(1, 6)], name="d.json")
    found = {f: os.path.join(d, f) for d, _, fs in os.walk(landing) for f in fs}
    os.utime(found["d.json"], (1_700_000_000, 1_700_000_000))
    assert run() == [(1, 1, 9), (2, 1, 7)]
    # a replay changes nothing
    _live(landing, 1, [(1, 9), (2, 7)], name="e.json")
    assert run() == [(1, 1, 9), (2, 1, 7)]


def _refresh(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")

    def run():
        start_gameweek_refresh(spark, landing, table, str(tmp_path / "ckpt")).awaitTermination(120)
        return sorted((r.player_id, r.gameweek, r.total_points) for r in spark.read.parquet(table).collect())

    def land(name, rows, changed, week=1):
        _live(landing, week, rows, name=name)
        os.utime(os.path.join(landing, f"gameweek={week}", name), (changed, changed))

    return land, run, table


def test_an_older_document_that_lands_later_changes_nothing(spark, tmp_path):
    land, run, _ = _refresh(spark, tmp_path)
    land("new.json", [(1, 9), (2, 4)], 1_700_000_500)
    assert run() == [(1, 1, 9), (2, 1, 4)]
    # Late, and changed earlier: only the player it alone knows is added.
    land("old.json", [(1, 5), (3, 2)], 1_700_000_100)
    assert run() == [(1, 1, 9), (2, 1, 4), (3, 1, 2)]
    land("newest.json", [(1, 10)], 1_700_000_900)
    land("week2.json", [(1, 1)], 1_700_000_100, week=2)
    assert run() == [(1, 1, 10), (1, 2, 1), (2, 1, 4), (3, 1, 2)]


def test_a_crash_while_partitions_are_replaced_loses_nothing(spark, tmp_path, monkeypatch):
    import shutil

    from squadron.streaming import refresh

    land, run, table = _refresh(spark, tmp_path)
    land("a.json", [(1, 5), (2, 7)], 1_700_000_100)
    assert run() == [(1, 1, 5), (2, 1, 7)]
    land("b.json", [(1, 6)], 1_700_000_200)

    def crash(df, path):
        shutil.rmtree(os.path.join(path, "gameweek=1"))  # the old partition is gone, the new one not there
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(refresh, "refresh_gameweeks", crash)
        with pytest.raises(Exception):
            run()
    assert not os.path.exists(os.path.join(table, "gameweek=1"))
    # The restarted stream replays the batch; player 2 comes from the log.
    assert run() == [(1, 1, 6), (2, 1, 7)]


def test_schema_contract(spark):
    docs = spark.createDataFrame([('{"k": 1}',), ('{"k": 2, "x": 1}',)], "props string")
    obs = contract.key_counts(docs, "props", "events.props")
    res = {r.field: (r.docs, r.status) for r in
           contract.schema_contract(obs, {"events.props": ["k", "y"]}).collect()}
    assert res == {"k": (2, "present"), "x": (1, "unexpected"), "y": (0, "missing")}


def test_contract_sees_keys_at_any_depth(spark):
    doc = {"elements": [{"id": 1, "stats": {"minutes": 90, "new_stat": 1}, "explain": []},
                        {"id": 2, "stats": {"minutes": 0}, "explain": [{"fixture": 7, "stats": [{"identifier": "x"}]}]}],
           "extra": None}
    docs = spark.createDataFrame([(json.dumps(doc),), ('{"elements": []}',), ("no json",), (None,)], "body string")
    seen = contract.key_paths(docs, "body", "gameweek")
    got = {r.field: (r.docs, r.status) for r in contract.schema_contract(
        seen, {"gameweek": contract.expected_paths(schemas.DOCUMENTS["gameweek"])}).collect()}
    assert got["elements"] == (2, "present") and got["elements[].stats.minutes"] == (1, "present")
    assert got["elements[].explain[].stats[].identifier"] == (1, "present")
    assert got["elements[].stats.new_stat"] == (1, "unexpected") and got["extra"] == (1, "unexpected")
    assert got["elements[].stats.saves"] == (0, "missing") and got["elements[].explain[].stats[].value"] == (0, "missing")


@pytest.mark.parametrize("source", sorted(schemas.DOCUMENTS))
def test_contract_of_every_source(spark, source):
    """A document made from the schema has all its keys; one key less is missing."""
    kind = schemas.DOCUMENTS[source]

    def example(t):
        if hasattr(t, "elementType"):
            return [example(t.elementType)]
        return {f.name: example(f.dataType) for f in t.fields} if hasattr(t, "fields") else 1

    expected = contract.expected_paths(kind)
    whole, less = example(kind), example(kind)
    dropped = next(iter(less[0] if isinstance(less, list) else less))
    (less[0] if isinstance(less, list) else less).pop(dropped)
    for doc, lacking in ((whole, set()), (less, {p for p in expected if p.removeprefix("[].").split(".")[0].removesuffix("[]") == dropped})):
        docs = spark.createDataFrame([(json.dumps(doc),)], "body string")
        rows = contract.schema_contract(contract.key_paths(docs, "body", source, depth=7), {source: expected}).collect()
        assert {r.field for r in rows if r.status == "missing"} == lacking
        assert not [r for r in rows if r.status == "unexpected"]


def test_page_gaps(spark, tmp_path):
    root = str(tmp_path / "leagues")

    def page(league, n, more):
        _write(f"{root}/league_id={league}/page={n}.json", {"league": {"id": league, "name": "L"}, "standings": {
            "has_next": more, "page": n, "results": []}})

    page(1, 1, True), page(1, 2, False)  # whole
    page(2, 2, True), page(2, 5, True)  # 1, 3 and 4 lack, and 5 says that there is a next
    page(3, 1, True)
    got = sorted(map(tuple, documents.league_page_gaps(spark, root).collect()))
    assert got == [(2, 1, "missing"), (2, 3, "missing"), (2, 4, "missing"), (2, 6, "unfinished"), (3, 2, "unfinished")]


def test_damaged_picks_are_quarantined_with_their_reason(spark, tmp_path):
    root = str(tmp_path / "picks")
    good = {"active_chip": None, "automatic_subs": [], "entry_history": {"event": 1, "points": 50}, "picks": [
        {"element": 7, "position": 1, "multiplier": 2, "is_captain": True, "is_vice_captain": False}]}
    whole = json.dumps(good)
    texts = {1: whole, 2: whole[:-12], 3: "", 4: '{"detail": "Not found."}', 5: whole.replace("[{", "[], \"x\": [{"),
             6: "<html>503</html>", 7: whole.replace('"position": 1', '"position": "first"'), 8: "  \n"}
    for entry, text in texts.items():
        os.makedirs(f"{root}/entry_id={entry}/gw=3")
        with open(f"{root}/entry_id={entry}/gw=3/picks.json", "w") as f:
            f.write(text)
    checked = documents.checked_picks(spark, root)
    reasons = {r.entry_id: r.reason for r in checked.collect()}
    empty = {3} & set(reasons)  # Spark may list a file without bytes, or not
    assert {k: v for k, v in reasons.items() if k not in empty} == {
        1: None, 2: "malformed", 4: "error", 5: "no squad", 6: "malformed", 7: "wrong type", 8: "empty"}
    requested = spark.createDataFrame([(e, 3) for e in range(1, 10)], "entry_id bigint, gw int")
    table = str(tmp_path / "quarantine")
    usable = documents.quarantine(checked, table, requested)
    rows = documents.entry_rows_of(usable).collect()
    assert [(r.entry_id, r.gw, r.total_points, r.captain) for r in rows] == [(1, 3, 50, 7)]
    bad = {r.entry_id: (r.reason, r.text) for r in spark.read.parquet(table).collect()}
    assert set(bad) == {2, 3, 4, 5, 6, 7, 8, 9} and bad[9] == ("absent", None) and bad[4][1] == texts[4]


def test_equal_times_are_resolved_by_the_place_in_the_list(spark, tmp_path):
    from squadron.operators import transfers

    at = "2024-09-01T10:00:00Z"
    rows = [(30, 40, at), (31, 41, at), (32, 42, "2024-08-30T10:00:00Z"), (33, 43, "2024-08-30T10:00:00Z")]
    _write(str(tmp_path / "t" / "9.json"), [
        {"element_in": i, "element_out": o, "entry": 9, "event": 4, "time": t} for i, o, t in rows])
    t = documents.transfers(spark, str(tmp_path / "t"))
    listed = transfers.collected_transfers(t).first()
    assert listed.element_in == [30, 31, 32, 33] and listed.element_out == [40, 41, 42, 43]
    first = transfers.single_transfers(t).first()
    assert (first.element_in, first.element_out) == ([33], [43])  # newest first: the last listed is the earliest


def test_stage_table_restores_the_session(spark):
    from squadron import session

    key = session._SHUFFLE_CLEANUP
    before = spark.conf.get(key, None)
    table = session.stage_table(spark.range(100).repartition(3, "id"), "restored")
    assert spark.conf.get(key, None) == before
    assert table.count() == 100 and table.selectExpr("sum(id)").first()[0] == 4950
