"""The season wrap's week arrays: one shuffle, no window, each table read once
(the entries twice, for the current week), and edge cases by hand."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from squadron.operators import season
from squadron.plans.transfer_queries import current_week, members_of
from squadron.sources.testdata import tables


def test_plan_has_one_shuffle_of_the_facts_and_no_window(spark, sf_small):
    t = tables(spark, sf_small).materialize_all()
    df = season.season_wrap_report(t.entry, t.pick, t.score, t.transfer, t.auto_sub, members_of(t), current_week(t))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert plan.count("hashpartitioning(entry_id") <= 2  # the facts, and the distinct members
    assert "SortAggregate" not in plan


def frames(spark):
    entry = spark.createDataFrame(
        [(1, 1, None, 50, 3), (1, 2, "wildcard", 50, None), (1, 3, None, 10, 9), (2, 1, None, -4, 0)],
        "entry_id bigint, gw int, active_chip string, total_points int, points_on_bench int")
    pick = spark.createDataFrame(
        [(1, 1, 7, 1, 2, True, False), (1, 1, 8, 2, 1, False, True), (1, 1, 9, 3, 0, False, False),
         (1, 2, 7, 1, 2, True, False), (1, 2, 8, 2, 1, False, True), (1, 3, 10, 1, 0, False, False)],
        "entry_id bigint, gw int, player_id bigint, position int, multiplier int, is_captain boolean, is_vice_captain boolean")
    score = spark.createDataFrame([(7, 1, 0, 0), (8, 1, 6, 90), (7, 2, 5, 90), (20, 1, 11, 90)],
                                  "player_id bigint, gameweek int, total_points int, minutes int")
    transfer = spark.createDataFrame(
        [(1, 1, 1, "2024-01-01 00:00:00", 20, 21), (2, 1, 1, "2024-01-02 00:00:00", 22, 23), (3, 1, 9, "2024-01-02 00:00:00", 1, 2)],
        "transfer_id bigint, entry bigint, event int, time string, element_in bigint, element_out bigint") \
        .withColumn("time", F.col("time").cast("timestamp"))
    subs = spark.createDataFrame([(1, 1, 8, "in"), (1, 1, 9, "out")],
                                 "entry_id bigint, gw int, player_id bigint, direction string")
    members = spark.createDataFrame([(1,), (3,)], "entry_id bigint")
    return entry, pick, score, transfer, subs, members


def items(spark, section, last_week=3):
    got = season.season_wrap_report(*frames(spark), last_week).where(F.col("section") == section)
    return sorted((tuple(r) for r in got.drop("section").collect()), key=str)


def test_sections_by_hand(spark):
    none = (None,) * 3
    assert items(spark, "captain") == [(1, None, None, 7, None, 2, None, *none)]
    # The captain of week 1 played 0 minutes: the vice's 6 points count twice.
    assert items(spark, "promoted_vice") == [(1, None, None, 8, None, 12, 1, *none)]
    assert items(spark, "used_chips") == [(1, None, None, None, "wildcard", None, None, *none)]
    assert [r[2] for r in items(spark, "exceptional") if r[0] == 1] == [1, 2]
    assert items(spark, "highest_point")[0][2] == 1 and items(spark, "lowest_point")[0][2] == 3
    assert [(r[0], r[-1]) for r in items(spark, "season_average")] == [(1, 110 / 3), (2, -4.0)]
    # Newest first; the transfer of week 9 is past the last week; weeks 2 and 3 made none.
    most = items(spark, "most_transferred_in")
    assert [(r[1], r[5], r[7]) for r in most if r[0] == 1] == [(1, 2, []), (2, 1, [22, 20])]
    # A member of whom nothing else is known has three weeks without transfers; entry 2 is no member.
    assert [(r[1], r[5], r[7]) for r in most if r[0] == 3] == [(1, 3, [])]
    assert not [r for r in most if r[0] == 2]
    assert items(spark, "best_transfer_in") == []  # one week is not more than two
    assert [(r[2], r[5], r[7]) for r in items(spark, "most_points_on_bench") if r[0] == 1] == [(3, 9, [10]), (1, 3, [9])]
    assert [(r[2], r[5], r[7], r[8]) for r in items(spark, "lucky_week")] == [(1, 6, [8], [9])]


def test_best_and_worst_transfers_need_three_free_weeks(spark):
    entry, pick, score, transfer, subs, members = frames(spark)
    more = spark.createDataFrame([(9 + k, 1, k, "2024-02-01 00:00:00", 20, 7) for k in (2, 3, 4)],
                                 "transfer_id bigint, entry bigint, event int, time string, element_in bigint, element_out bigint") \
        .withColumn("time", F.col("time").cast("timestamp"))
    got = season.season_wrap_report(entry, pick, score, transfer.union(more), subs, members, 4)
    best = {(r.k, r.gameweek, r.value) for r in got.where("section = 'best_transfer_in'").collect()}
    worst = {(r.k, r.gameweek, r.value) for r in got.where("section = 'worst_transfer_in'").collect()}
    # Week 2 was a wildcard; week 1 brought 11 points, weeks 3 and 4 nothing (unknown players score 0).
    assert best == {(1, 1, 11), (2, 3, 0), (3, 4, 0)} and worst == {(1, 3, 0), (2, 4, 0)}


def test_empty_tables(spark):
    empty = [f.limit(0) for f in frames(spark)]
    assert season.season_wrap_report(*empty, 38).collect() == []


def test_registered(spark, sf_small):
    assert not E.queries()["season_wrap_report"](spark, sf_small).isEmpty()
