"""Operators on tiny hand-made frames, including the behaviour decisions
(Q-rows of the survey)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from squadron.functions.lists import GameweekError, check_gameweeks, csv_ids, list_sum
from squadron.operators import bench, captains, picks, stats, transfers
from squadron.operators.picks import weekly_scores

PICK = ("entry_id long, gw int, player_id long, position int, multiplier int, "
        "is_captain boolean, is_vice_captain boolean")
SCORE = "player_id long, gameweek int, total_points int, minutes int"
ENTRY = ("entry_id long, gw int, active_chip string, total_points int, points_on_bench int, "
         "event_transfers_cost int")
LEAGUE = "league_id int, league_name string, entry long, entry_name string, player_name string"
TRANSFER = "transfer_id long, entry long, event int, time timestamp, element_in long, element_out long"


def squad(entry, gw, starters, bench_players=()):
    rows = []
    for i, p in enumerate(starters, 1):
        rows.append((entry, gw, p, i, 2 if i == 1 else 1, i == 1, i == 2))
    for j, p in enumerate(bench_players, len(starters) + 1):
        rows.append((entry, gw, p, j, 0, False, False))
    return rows


@pytest.fixture
def world(spark):
    pick = spark.createDataFrame(
        squad(1, 1, [10, 11, 12], [13]) + squad(2, 1, [11, 12, 99], [10])
        + squad(3, 1, [12, 10, 11]) + squad(4, 1, [], [10, 11]), PICK)
    score = spark.createDataFrame(
        [(10, 1, 5, 90), (11, 1, 2, 0), (12, 1, 7, 90), (13, 1, 3, 90)], SCORE)
    entry = spark.createDataFrame(
        [(1, 1, None, 60, 3, 0), (2, 1, "wildcard", 40, 5, 0), (3, 1, None, 50, 0, 4),
         (4, 1, None, 10, 0, 0)], ENTRY)
    league = spark.createDataFrame(
        [(7, "L7", e, f"team{e}", f"mgr{e}") for e in (1, 2, 3, 4)], LEAGUE)
    return pick, score, entry, league


def test_points_breakdown_and_missing_player(spark, world):
    pick, score, *_ = world
    rows = {r.entry_id: r for r in picks.points_breakdown(pick, score).collect()}
    assert rows[1].points_breakdown == [5, 2, 7] and rows[1].players == [10, 11, 12]
    # Q7: unknown player 99 scores 0 and is counted as missing
    assert rows[2].points_breakdown == [2, 7, 0] and rows[2].missing_players == 1


def test_captain_double_and_empty_squad_dropped(spark, world):
    pick, score, entry, league = world
    ws = {r.entry_id: r for r in weekly_scores(entry, pick, score, league).collect()}
    assert set(ws) == {1, 2, 3}  # Q6: entry 4 fielded no starter
    assert ws[1].captain_points == 10 and ws[1].vice_captain_points == 2
    assert [ws[e].rank for e in (1, 3, 2)] == [1, 2, 3]


def test_rank_ties_by_entry_and_average_rank(spark):
    df = spark.createDataFrame([(1, 1, e, p) for e, p in [(5, 10), (3, 10), (9, 7), (1, 12)]],
                               "league_id int, gameweek int, entry_id long, total_points int")
    from squadron.operators.ranking import average_rank, position_rank
    pos = {r.entry_id: r.rank for r in position_rank(df, ["league_id", "gameweek"], "total_points",
                                                     "entry_id", bucket_size=2).collect()}
    assert pos == {1: 1, 3: 2, 5: 3, 9: 4}
    avg = {r.entry_id: r.rank for r in average_rank(df, ["league_id", "gameweek"], "total_points").collect()}
    assert avg == {1: 1, 3: 2, 5: 2, 9: 4}  # floor(2 + 1/2) = 2


def test_captain_counts_drop_null_and_promoted_vice(spark, world):
    pick, score, entry, league = world
    ws = weekly_scores(entry, pick, score, league)
    cc = {r.captain: r["count"] for r in captains.captain_counts(ws).collect()}
    assert cc == {10: 1, 11: 1, 12: 1}
    pv = {r.vice_captain: (r["count"], r.points) for r in captains.promoted_vice(ws, score).collect()}
    # entry 2's captain 11 played 0 minutes: vice 12 promoted, points doubled
    assert pv == {12: (1, 14)}


def test_single_transfer_keeps_earliest_and_fallback(spark, world):
    pick, score, entry, league = world
    t0 = dt.datetime(2024, 1, 1, 10)
    tr = spark.createDataFrame(
        [(1, 1, 1, t0 + dt.timedelta(hours=2), 13, 11), (2, 1, 1, t0, 10, 12),
         (3, 3, 1, t0, 12, 13)], TRANSFER)
    single = {r.entry_id: (r.element_in, r.element_out) for r in transfers.single_transfers(tr).collect()}
    assert single[1] == ([10], [12])  # Q1: the earliest survives
    ws = weekly_scores(entry, pick, score, league)
    j1 = transfers.entry_transfer_join(ws, tr, score, league)
    got = {r.entry_id: r.delta for r in j1.collect()}
    assert got == {1: 5 - 7, 3: 7 - 3}  # right join: only entries that transferred
    # no transfers at all -> every entry with delta 0
    empty = tr.where(F.lit(False))
    fb = transfers.entry_transfer_join(ws, empty, score, league).collect()
    assert sorted(r.entry_id for r in fb) == [1, 2, 3] and {r.delta for r in fb} == {0}


def test_best_needs_more_than_two_chip_free_and_worst_has_two(spark, world):
    pick, score, entry, league = world
    t0 = dt.datetime(2024, 1, 1)
    tr = spark.createDataFrame([(1, 1, 1, t0, 10, 11), (2, 3, 1, t0, 12, 13)], TRANSFER)
    ws = weekly_scores(entry, pick, score, league)
    j1 = transfers.entry_transfer_join(ws, tr, score, league)
    assert transfers.transfer_leaders(j1, league, True).count() == 0
    more = spark.createDataFrame([(i, e, 1, t0, 10 + i % 4, 13) for i, e in enumerate([1, 3, 5, 6, 7])],
                                 TRANSFER)
    lg = league.unionByName(spark.createDataFrame([(7, "L7", e, f"t{e}", f"m{e}") for e in (5, 6, 7)], LEAGUE))
    j1 = transfers.entry_transfer_join(ws, more, score, lg)
    assert transfers.transfer_leaders(j1, lg, True).count() == 3
    assert transfers.transfer_leaders(j1, lg, False).count() == 2


def test_most_transferred_fewer_than_three_lists(spark, world):
    pick, score, entry, league = world
    tr = spark.createDataFrame([(1, 1, 1, dt.datetime(2024, 1, 1), 10, 11)], TRANSFER)
    j1 = transfers.entry_transfer_join(weekly_scores(entry, pick, score, league), tr, score, league)
    out = transfers.most_transferred(j1, "out").collect()  # Q11: no error with 1 list
    assert [(r.player, r["count"]) for r in out] == [(11, 1)]


def test_auto_sub_single_sub_counts(spark):
    a = spark.createDataFrame([(1, 1, 10, "in"), (1, 1, 11, "out")],
                              "entry_id long, gw int, player_id long, direction string")
    s = spark.createDataFrame([(10, 1, 6, 90), (11, 1, 0, 0)], SCORE)
    r = bench.auto_sub_points(a, s).collect()[0]
    assert (r.auto_sub_in, r.auto_sub_out, r.auto_sub_in_points) == ([10], [11], 6)  # Q5


def test_outliers_all_rows_and_reported(spark):
    pts = [(1, 50), (2, 50), (3, 48), (4, 47), (5, 49), (6, 46), (7, 0), (8, 1)]
    ws = spark.createDataFrame([(1, 1, e, p) for e, p in pts],
                               "league_id int, gameweek int, entry_id long, total_points int")
    names = spark.createDataFrame([(1, "L", e, f"t{e}", f"m{e}") for e in range(1, 9)], LEAGUE)
    # Q1 = 34.75, Q3 = 49.25 (linear interpolation): abysmal below 13
    o = stats.outliers(ws, names).collect()
    assert sorted((r.kind, r.entry_id) for r in o) == [("abysmal", 7), ("abysmal", 8),
                                                        ("exceptional", 1), ("exceptional", 2)]
    rep = stats.outliers_reported(ws, names).collect()[0]
    assert (rep.exceptional_entry, rep.abysmal_entry, rep.abysmal_score) == (2, 7, 0)


def test_gameweek_checks():
    assert check_gameweeks(1) == [1] and check_gameweeks([8, 10, 3]) == [8, 10, 3]
    for bad in (40, [1, 10, 39], [], "1", True):
        with pytest.raises(GameweekError):
            check_gameweeks(bad)


def test_csv_and_list_helpers(spark):
    r = spark.createDataFrame([("10, 11,,12 ",)], "s string").select(
        csv_ids("s").alias("ids"), list_sum(csv_ids("s")).alias("t")).collect()[0]
    assert r.ids == [10, 11, 12] and r.t == 33


def test_per_player_counts_and_single_best(spark, world):
    pick, score, entry, league = world
    t0 = dt.datetime(2024, 1, 1)
    tr = spark.createDataFrame([(i, e, 1, t0, 10, 11 + i % 2) for i, e in enumerate([1, 3, 5, 6])], TRANSFER)
    lg = league.unionByName(spark.createDataFrame([(7, "L7", e, f"t{e}", f"m{e}") for e in (5, 6)], LEAGUE))
    j1 = transfers.entry_transfer_join(weekly_scores(entry, pick, score, lg), tr, score, lg)
    per = {r.player: r["count"] for r in transfers.most_transferred(j1, "out", per_player=True).collect()}
    assert per == {11: 2, 12: 2}
    assert transfers.transfer_leaders(j1, lg, True, k=1).count() == 1


def test_invalid_spans_raise_before_any_job(spark, world):
    from squadron.operators.participants import entries_span
    _, _, entry, _ = world
    tr = spark.createDataFrame([], TRANSFER)
    with pytest.raises(GameweekError):
        transfers.transfers_in_weeks(tr, [1, 10, 39])
    with pytest.raises(GameweekError):
        entries_span(entry, weeks=[40])
    assert entries_span(entry, upto=1).count() == 4


def test_scale_conf_sizes_partitions():
    from squadron.session import scale_conf
    small = scale_conf(10, 4, 1 << 30)
    assert small["spark.sql.shuffle.partitions"] == "120"  # 3 waves of 40 cores
    big = scale_conf(1000, 8, 100 << 40)
    assert int(big["spark.sql.shuffle.partitions"]) == 10 * 1000 * 8  # ten waves at most
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
