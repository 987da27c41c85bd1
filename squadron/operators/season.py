"""The season wrap, from one array of weeks per entry.

An entry's season has at most 38 weeks, so it is one row.  ``season_weeks``
gathers it: picks, transfers and automatic substitutions are one long table of
(entry, week, player, role), which meets the scores in a single join; two
aggregates, by week and then by entry, make the array.  Every section of the
wrap is then an expression over that array.  No table is read again, nothing is
sorted or shuffled per section, and the row of an entry is bounded by the
squad's and the season's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadron.functions.lists import MAX_GW

#: Column and type of a wrap row, which is one item of a section.
SEASON_SCHEMA = [("entry_id", "bigint"), ("section", "string"), ("k", "int"), ("gameweek", "int"),
                 ("player_id", "bigint"), ("label", "string"), ("value", "bigint"),
                 ("value2", "bigint"), ("detail", "array<bigint>"), ("detail2", "array<bigint>"),
                 ("average", "double")]


def _facts(pick: DataFrame, transfer: DataFrame, auto_sub: DataFrame) -> DataFrame:
    """(entry_id, gw, player_id, role, at, id): every player an entry had to do
    with in a week.  ``at`` and ``id`` order the players of a role."""
    role = (F.when(F.col("is_captain"), "captain").when(F.col("is_vice_captain"), "vice")
            .when(F.col("multiplier") == 0, "bench").otherwise("starter"))
    picks = (pick.select("entry_id", "gw", "player_id", role.alias("role"), F.lit(None).cast("timestamp").alias("at"),
                         F.col("position").cast("bigint").alias("id")).where("role <> 'starter'"))
    moves = F.inline(F.array(*[F.struct(F.col(f"element_{way}").cast("bigint").alias("player_id"),
                                        F.lit(way).alias("role")) for way in ("in", "out")]))
    moved = transfer.select(F.col("entry").alias("entry_id"), F.col("event").alias("gw"), moves,
                            F.col("time").cast("timestamp").alias("at"), F.col("transfer_id").cast("bigint").alias("id"))
    subs = auto_sub.select("entry_id", "gw", "player_id", F.concat(F.lit("sub_"), "direction").alias("role"),
                           F.lit(None).cast("timestamp").alias("at"), F.col("player_id").alias("id"))
    return picks.unionByName(moved).unionByName(subs)


def season_weeks(entry: DataFrame, pick: DataFrame, score: DataFrame, transfer: DataFrame, auto_sub: DataFrame,
                 members: DataFrame, last_week) -> DataFrame:
    """One row per entry: entry_id, is_member, last_week and ``weeks``, an array
    of the weeks up to ``last_week`` in which anything is known of the entry."""
    lookup = score.select("player_id", F.col("gameweek").alias("gw"), F.col("total_points").alias("points"), "minutes")
    facts = (_facts(pick, transfer, auto_sub).where(F.col("gw") <= last_week)
             .join(lookup, ["player_id", "gw"], "left"))
    own = entry.where(F.col("gw") <= last_week).select(
        "entry_id", "gw", F.lit("entry").alias("role"), "active_chip", "total_points", "points_on_bench")
    # A member without any other row still has weeks without transfers.
    belongs = members.select("entry_id", F.lit("member").alias("role"))
    # Dealt by entry once: both aggregates find their groups where they are.
    every = (facts.unionByName(own, allowMissingColumns=True).unionByName(belongs, allowMissingColumns=True)
             .repartition("entry_id"))

    def is_(*roles: str) -> Column:
        return F.col("role").isin(*roles)

    def points(role: str) -> Column:
        return F.coalesce(F.sum(F.when(is_(role), F.coalesce("points", F.lit(0)))), F.lit(0))

    def players(role: str, newest_first: bool = False) -> Column:
        listed = F.collect_list(F.when(is_(role), F.struct("at", "id", "player_id")))
        return F.transform(F.sort_array(listed, asc=not newest_first), lambda s: s["player_id"])

    weeks = every.groupBy("entry_id", "gw").agg(
        F.count(F.when(is_("entry"), 1)).alias("played"),
        F.count(F.when(is_("member"), 1)).alias("member"),
        F.max("active_chip").alias("active_chip"), F.max("total_points").alias("total_points"),
        F.max("points_on_bench").alias("points_on_bench"),
        F.max(F.when(is_("captain"), F.col("player_id"))).alias("captain"),
        F.max(F.when(is_("vice"), F.col("player_id"))).alias("vice"),
        F.coalesce(F.max(F.when(is_("captain"), F.col("minutes"))), F.lit(0)).alias("captain_minutes"),
        points("vice").alias("vice_points"), players("bench").alias("bench"),
        players("in", newest_first=True).alias("element_in"), players("out", newest_first=True).alias("element_out"),
        (points("in") - points("out")).alias("delta"),
        players("sub_in").alias("sub_in"), players("sub_out").alias("sub_out"), points("sub_in").alias("sub_points"))
    week = F.struct(F.col("gw").alias("gameweek"), *[c for c in weeks.columns if c not in ("entry_id", "gw", "member")])
    season = weeks.groupBy("entry_id").agg(
        (F.max("member") > 0).alias("is_member"),
        F.sort_array(F.collect_list(F.when(F.col("gw").isNotNull(), week))).alias("weeks"))
    return season.withColumn("last_week", last_week if isinstance(last_week, Column) else F.lit(last_week))


def _items(section: str, rows: Column, **fields) -> Column:
    """A section's items in the long schema; ``fields`` are functions of a row
    and its place from 0."""
    def item(row: Column, place: Column) -> Column:
        made = {"section": F.lit(section), **{name: get(row, place) for name, get in fields.items()}}
        return F.struct(*[made.get(name, F.lit(None)).cast(kind).alias(name)
                          for name, kind in SEASON_SCHEMA if name != "entry_id"])
    return F.transform(rows, item)


def _first(rows: Column, k: int, *order) -> Column:
    """The k first of the rows; ``order`` are functions of a row, ascending."""
    keyed = F.transform(rows, lambda r: F.struct(*[o(r).alias(f"o{i}") for i, o in enumerate(order)], r.alias("row")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["row"])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _counted(values: Column) -> Column:
    """(value, n) for each distinct value of an array."""
    return _let(values, lambda all_: F.transform(F.array_distinct(all_), lambda v: F.struct(
        v.alias("value"), F.size(F.filter(all_, lambda x: x == v)).alias("n"))))


def _quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array, interpolated between neighbours."""
    place = (F.size(values) - 1) * q
    low, high = (F.get(values, f(place).cast("int")) for f in (F.floor, F.ceil))
    return low + (place - F.floor(place)) * (high - low)


def _transfer_sections(weeks: Column) -> Column:
    place = lambda r, i: i + 1
    week = lambda r, i: r["gameweek"]

    def ranked(counted: Column, name: str) -> Column:
        return F.concat(*[
            _items(f"{rank}_transferred_{name}", _first(counted, 3, lambda c: sign * c["n"], lambda c: c["value"]),
                   k=place, detail=lambda c, i: c["value"], value=lambda c, i: c["n"])
            for rank, sign in (("most", -1), ("least", 1))])

    def leaders(free: Column) -> Column:
        return F.concat(*[
            _items(f"{name}_transfer_in", _first(free, k, lambda w: sign * w["delta"], lambda w: w["gameweek"]),
                   k=place, gameweek=week, value=lambda w, i: w["delta"],
                   detail=lambda w, i: w["element_in"], detail2=lambda w, i: w["element_out"])
            for name, k, sign in (("best", 3, -1), ("worst", 2, 1))])

    def sections(made: Column) -> Column:
        # Weeks that made none count as one more list, the empty one.
        none = F.array_repeat(F.array().cast("array<bigint>"), F.col("last_week") - F.size(made))
        moves = [_let(_counted(F.concat(F.transform(made, lambda w: w[f"element_{name}"]), none)),
                      lambda counted: ranked(counted, name)) for name in ("out", "in")]
        free = F.filter(made, lambda w: w["active_chip"].isNull())
        enough = _let(free, lambda f: F.slice(f, 1, F.when(F.size(f) > 2, F.size(f)).otherwise(0)))
        return F.concat(*moves, _let(enough, leaders))

    every = _let(F.filter(weeks, lambda w: F.size(w["element_in"]) > 0), sections)
    return F.slice(every, 1, F.when(F.col("is_member"), F.size(every)).otherwise(0))


def _squad_sections(weeks: Column) -> Column:
    place = lambda r, i: i + 1
    week = lambda r, i: r["gameweek"]

    def stand_ins(stood_in: Column) -> Column:
        twice = lambda v, i: F.aggregate(
            F.filter(stood_in, lambda w: w["vice"] == v["value"]), F.lit(0).cast("bigint"),
            lambda got, w: got + 2 * w["vice_points"])
        return _items("promoted_vice", _counted(F.transform(stood_in, lambda w: w["vice"])),
                      player_id=lambda v, i: v["value"], value=twice, value2=lambda v, i: v["n"])

    captains = F.transform(F.filter(weeks, lambda w: w["captain"].isNotNull()), lambda w: w["captain"])
    unplayed = F.filter(weeks, lambda w: w["captain"].isNotNull() & w["vice"].isNotNull() & (w["captain_minutes"] == 0))
    benched = _first(F.filter(weeks, lambda w: w["points_on_bench"].isNotNull()), 3,
                     lambda w: -w["points_on_bench"], lambda w: w["gameweek"])
    subbed = F.filter(weeks, lambda w: F.size(w["sub_in"]) + F.size(w["sub_out"]) > 0)
    lucky = _first(subbed, 3, lambda w: -w["sub_points"], lambda w: w["gameweek"])
    return F.concat(
        _items("captain", _counted(captains), player_id=lambda c, i: c["value"], value=lambda c, i: c["n"]),
        _let(unplayed, stand_ins),
        _items("most_points_on_bench", benched, k=place, gameweek=week, value=lambda w, i: w["points_on_bench"],
               detail=lambda w, i: w["bench"]),
        _items("lucky_week", lucky, k=place, gameweek=week, value=lambda w, i: w["sub_points"],
               detail=lambda w, i: w["sub_in"], detail2=lambda w, i: w["sub_out"]))


def _points_sections(weeks: Column) -> Column:
    week = lambda r, i: r["gameweek"]
    points = lambda w, i: w["total_points"]

    def sections(played: Column) -> Column:
        chips = F.array_distinct(F.transform(F.filter(played, lambda w: w["active_chip"].isNotNull()),
                                             lambda w: w["active_chip"]))

        def spread(values: Column) -> Column:
            low = lambda q: q["q1"] - 1.5 * (q["q3"] - q["q1"])
            total = F.aggregate(values, F.lit(0).cast("bigint"), lambda got, v: got + v)
            mean = F.struct(F.try_divide(total, F.size(values)).alias("mean"))
            quartiles = F.struct(_quantile(values, 0.25).alias("q1"), _quantile(values, 0.75).alias("q3"))
            return F.concat(
                _items("exceptional", F.filter(played, lambda w: w["total_points"] == F.array_max(values)),
                       gameweek=week, value=points),
                _let(quartiles, lambda q: _items("abysmal", F.filter(played, lambda w: w["total_points"] < low(q)),
                                                 gameweek=week, value=points)),
                _items("season_average", F.slice(F.array(mean), 1, F.least(F.size(values), F.lit(1))),
                       average=lambda r, i: r["mean"]))

        ends = [_items(name, _first(played, 1, lambda w: sign * w["total_points"], lambda w: w["gameweek"]),
                       gameweek=week, value=points) for name, sign in (("highest_point", -1), ("lowest_point", 1))]
        values = F.array_sort(F.transform(played, lambda w: w["total_points"]))
        return F.concat(_items("used_chips", chips, label=lambda c, i: c), _let(values, spread), *ends)

    return _let(F.filter(weeks, lambda w: w["played"] > 0), sections)


def season_sections(season: DataFrame) -> DataFrame:
    """The tidy wrap: one row per item of every section, from the week arrays."""
    weeks = F.col("weeks")
    items = F.concat(_squad_sections(weeks), _points_sections(weeks), _transfer_sections(weeks))
    return season.select(F.col("entry_id").cast("bigint"), F.inline(items))


def season_wrap_report(entry: DataFrame, pick: DataFrame, score: DataFrame, transfer: DataFrame,
                       auto_sub: DataFrame, members: DataFrame, last_week=MAX_GW) -> DataFrame:
    """A23 in full (inferred from saved season reports): an entry's captains,
    stand-in captains, chips, exceptional and abysmal weeks, average, most and
    least transferred, best and worst transfers, bench and lucky weeks, highest
    and lowest week."""
    return season_sections(season_weeks(entry, pick, score, transfer, auto_sub, members, last_week))
