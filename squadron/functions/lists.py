"""Scalar helpers (H1-H12).  All are built-in Spark expressions, so they stay
inside whole-stage codegen; there are no Python UDFs in the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: gameweeks 1..18 are the first half of the season
FIRST_HALF_LAST_GW = 18
MIN_GW, MAX_GW = 1, 38


def csv_ids(c: Column | str) -> Column:
    """H1: split a comma-separated id list, drop blanks, cast to bigint."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda v: F.trim(v) != "")
    return F.transform(parts, lambda v: F.trim(v).cast("bigint"))


def ordered_ids(cond: Column, pos: Column | str, ident: Column | str) -> Column:
    """H2 (aggregate): ids where ``cond`` holds, in ``pos`` order.  Sorting
    the collected structs makes the order independent of shuffle order."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    ident = F.col(ident) if isinstance(ident, str) else ident
    picked = F.collect_list(F.when(cond, F.struct(pos.alias("p"), ident.alias("i"))))
    return F.transform(F.array_sort(picked), lambda s: s["i"])


def ids_csv(arr: Column | str) -> Column:
    """H2 (output form): array of ids back to the CSV string."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.transform(arr, lambda v: v.cast("string")), ",")


def list_size(arr: Column | str) -> Column:
    """H3."""
    return F.size(F.col(arr) if isinstance(arr, str) else arr)


def list_sum(arr: Column | str) -> Column:
    """H4: sum of a list, nulls ignored, empty list -> 0."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.aggregate(F.coalesce(arr, F.array()), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + F.coalesce(x.cast("bigint"), F.lit(0)))


def first_argmax(arr: Column | str) -> Column:
    """H5: 1-based position of the first maximum (0 when empty)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.array_position(arr, F.array_max(arr))


def first_item(arr: Column | str) -> Column:
    """H9: first element of a list (null when empty)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.try_element_at(arr, F.lit(1))


def season_half(gw: Column | str) -> Column:
    """Gameweek -> season half (1 or 2)."""
    gw = F.col(gw) if isinstance(gw, str) else gw
    return F.when(gw <= FIRST_HALF_LAST_GW, 1).otherwise(2)


def tenths(c: Column | str) -> Column:
    """Money held in tenths -> units."""
    c = F.col(c) if isinstance(c, str) else c
    return c / 10


def valid_gameweek(gw: Column | str) -> Column:
    """F6 as a column predicate."""
    gw = F.col(gw) if isinstance(gw, str) else gw
    return gw.between(MIN_GW, MAX_GW)


class GameweekError(ValueError):
    """Raised at plan time when a requested gameweek span is invalid."""


def check_gameweeks(gw) -> list[int]:
    """F6 for parameters: an int or a list is valid only if every member is
    an int in 1..38.  Returns the weeks as a list; raises GameweekError."""
    weeks = [gw] if isinstance(gw, int) and not isinstance(gw, bool) else gw
    if not isinstance(weeks, (list, tuple)) or not weeks:
        raise GameweekError(f"gameweek must be an int or a list of ints, got {gw!r}")
    for w in weeks:
        if not isinstance(w, int) or isinstance(w, bool) or not MIN_GW <= w <= MAX_GW:
            raise GameweekError(f"gameweek {w!r} is not in {MIN_GW}..{MAX_GW}")
    return list(weeks)
