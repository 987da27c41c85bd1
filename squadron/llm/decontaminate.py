"""Benchmark decontamination.

Windows of ``WINDOW`` normalised words of every benchmark item (its only
window is the whole item where it has fewer) make one Aho-Corasick automaton.
Each task normalises a slice of whole texts into one string (a space between
words, a mark between texts), scans it once, and maps the matches back to
words and to code points of the original.

The automaton is built in each worker from the window strings, whose total
size is checked: beyond ``AUTOMATON_BYTES`` the windows are dealt by hash over
several automata, and the same rows pass through one after the other.  The
windows are a stage table; the driver holds and sends those of one automaton at
a time, whose rows are written before the next one's are read.

Defined results: null texts and items have no words; a null item id is
reported as the string ``null`` by the query; an empty benchmark hits nothing; repeated
rows are judged alike; other columns are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from squadron.llm import textkit as T
from squadron.llm.rows import annotate
from squadron.session import stage_table

WINDOW = 10
#: Window text in one automaton; about 60 bytes of memory a byte.
AUTOMATON_BYTES = 4 << 20

# The bytes that separate words (ASCII but for digits and letters).
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_NORMAL = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))
_BYTE_TABLE = T.table(_SEPARATORS)

SPANS = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start: bigint, stop: bigint>>"


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = (text or "").encode().translate(_NORMAL).split()
            some = {b" ".join(words[i:i + WINDOW]) for i in range(max(1, len(words) - WINDOW + 1))} if words else ()
            ids += [item] * len(some)
            found += some
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.binary())], ["item", "win"])


def windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple]]:
    """(window, its item ids) in groups of at most AUTOMATON_BYTES each (a
    little more, as a hash deals them), one after the other."""
    rows = stage_table(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                         F.col(text_col).cast("string").alias("text"))
        .mapInArrow(_item_windows, "item string, win binary")
        .groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")), "leak-windows")
    size = rows.agg(F.sum(F.length("win"))).first()[0] or 0
    groups = -(-size // AUTOMATON_BYTES)
    for g in range(groups):
        found = rows.filter(F.pmod(F.xxhash64("win"), F.lit(groups)) == g)
        yield [(bytes(r["win"]), tuple(r["items"])) for r in found.toLocalIterator()]


_built: dict[str, object] = {}


def _automaton(key: str, group: list[tuple]):
    """The worker's automaton of a broadcast group; the last few are kept."""
    import ahocorasick

    if key not in _built:
        if len(_built) > 3:
            _built.clear()
        machine = ahocorasick.Automaton()
        for win, items in group:
            machine.add_word(f" {win.decode('latin-1')} ", (win.count(b" ") + 1, items))
        machine.make_automaton()
        _built[key] = machine
    return _built[key]


def scan(machine, column: pa.Array) -> list[pa.Array]:
    """n_words, n_hit, items and spans (code points) of each text of a slice."""
    data, offsets = T.utf8(column)
    n = len(column)
    plain = data.tobytes().translate(_NORMAL)
    joined = b" \x00 ".join([plain[a:b] for a, b in zip(offsets[:-1], offsets[1:])])
    line = np.frombuffer(b" " + joined + b" ", dtype=np.uint8)
    gap = line == 32
    keep = np.ones(len(line), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    line = line[keep]
    gap, mark = line == 32, np.flatnonzero(line == 0)
    ends = np.flatnonzero(gap[1:] & ~gap[:-1] & (line[:-1] != 0)) + 1  # the space after each word
    first = np.concatenate(([0], np.searchsorted(ends, mark), [len(ends)]))  # first word of each row
    n_words = np.diff(first)

    hits: list[tuple[int, int]] = []
    items: dict[int, set[str]] = {}
    if machine is not None and len(ends):
        for end, (length, names) in machine.iter(line.tobytes().decode("latin-1")):
            last = int(np.searchsorted(ends, end))
            hits.append((last - length + 1, last + 1))
            items.setdefault(int(np.searchsorted(first, last, side="right")) - 1, set()).update(names)
    step = np.zeros(len(ends) + 1, dtype=np.int64)
    for a, b in hits:
        step[a] += 1
        step[b] -= 1
    hit = np.cumsum(step)[:-1] > 0
    n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
    spans: list[list[dict]] = [[] for _ in range(n)]
    for row in items:
        words = T.Words(column[row:row + 1], _BYTE_TABLE)
        point = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))  # code points before each byte
        own = np.concatenate(([False], hit[first[row]:first[row + 1]], [False]))
        turn = np.flatnonzero(own[1:] != own[:-1])
        spans[row] = [{"start": int(point[words.start[a]]), "stop": int(point[words.stop[b - 1]])}
                      for a, b in zip(turn[::2], turn[1::2])]
    return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string())),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), n_words, n_hit, items (ids as sorted
    strings) and spans (hit runs of words, code points, stop exclusive)."""
    context, groups = docs.sparkSession.sparkContext, windows(benchmark, item_col, item_text_col)

    def work(group):
        held, key = context.broadcast(group), uuid.uuid4().hex

        def start():
            machine = _automaton(key, held.value) if held.value else None
            return lambda column: scan(machine, column)
        return held, start

    group = next(groups, [])
    held, start = work(group)
    out = annotate(docs, text_col, SPANS, start)
    for group in groups:
        out = stage_table(out, "leak-hits")  # read from here on, so that the last group may go
        held.unpersist()
        held, start = work(group)
        out = _merged(out, text_col, start)
    return out


def _merged(found: DataFrame, text_col: str, work) -> DataFrame:
    """Another automaton over the same rows, its hits joined to those before."""
    beside = found.select("row", F.struct("n_words", "n_hit", "items", "spans").alias("before"),
                          F.col("row").getField(text_col).cast("string").alias("text"))
    more = annotate(beside, "text", SPANS, work)
    before = F.col("row.before")
    both = F.array_sort(F.concat(before["spans"], F.col("spans")))
    return more.select(
        F.col("row.row").alias("row"), "n_words",
        F.array_sort(F.array_union(before["items"], F.col("items"))).alias("items"),
        _union_runs(both).alias("spans"), F.col("row.text").alias("text")).select(
        "row", "n_words", _words_in("text", "spans").alias("n_hit"), "items", "spans")


def _union_runs(spans):
    """Sorted spans joined where they overlap."""
    kind = "array<struct<start: bigint, stop: bigint>>"

    def add(done, x):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1),
                          F.array(F.struct(last["start"].alias("start"),
                                           F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return (F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["stop"]), longer)
                .otherwise(F.concat(done, F.array(x))))
    return F.aggregate(spans, F.array().cast(kind), add)


def _words_in(text: str, spans: str):
    """Words within the spans of a text."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + F.regexp_count(
        F.regexp_replace(F.substring(F.col(text), (x["start"] + 1).cast("int"), (x["stop"] - x["start"]).cast("int")),
                         "[A-Z]", "a"), F.lit(word)).cast("bigint"))
