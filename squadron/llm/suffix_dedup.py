"""Suffix-array dedup: bytes covered by a 200-byte string that also starts elsewhere.

``suffix_blocks`` leaves the places where a repeated window may begin; a whole
block that occurs twice is repeated throughout and stands once in what is
sorted.  The other blocks are cut into cells of ``STEP`` window starts, at places
that follow the anchor, so equal windows lie in cells of the same number whose
common bytes (the core) are equal: cells with a core of their own hold no repeat,
and cells with equal bytes throughout (the hull) stand once.  Their suffixes are ordered by a difference cover modulo 3, to the depth
of 200 bytes:

1. positions 1 and 2 modulo 3 are the sample.  The triple of 8-byte characters
   at each is sorted; its rank is the position's name (24 bytes);
2. triples of names are sorted again, at distances that keep the residue:
   (0, 24, 48) gives names of 72 bytes, (0, 63, 126) of 198.  A position whose
   name is unique is in no repeated window and leaves the sort;
3. the remaining suffixes are merged in: of any two positions, both are 0, 1 or
   2 bytes before a sampled one, so (bytes before, name, bytes after) is sorted
   for each of the three shifts, and neighbours in the order are compared.

Every sort is a range partitioning and a sort within partitions by Spark; names
are the partition and the place in it, so they follow the order.

Defined results: a null text is empty; texts under 200 bytes lose nothing; a
text that stands twice (same id or not) loses all; an empty table gives an
empty result; other columns are kept in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as S

from squadron.llm import suffix_blocks as B, textkit as T
from squadron.session import stage_table

LENGTH = B.LENGTH
#: Window starts of a cell.
STEP = 8
_REST = LENGTH - B.GRAM
#: Distances of the names that make the next triple.
LEVELS = [(24, (0, 24, 48)), (72, (0, 63, 126))]
COVERED = 198
_SIGN = np.uint64(1 << 63)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed blocks."""
    for part in T.pieces(batches, "text"):
        data, offsets = T.utf8(part.column("text"))
        raw = data.tobytes()
        out: dict[str, list] = {k: [] for k in ("row", "start", "n", "at", "count", "body")}
        for r, found in enumerate(part.column("found").to_pylist()):
            for x in found:
                out["row"].append(r)
                for k in ("start", "n", "at", "count"):
                    out[k].append(x[k])
                a = offsets[r] + x["start"]
                out["body"].append(raw[a:a + x["n"] + LENGTH - 1])
        row = pa.array(out["row"], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(row), part.column("text_hash").take(row),
             *[pa.array(out[k], pa.int32()) for k in ("start", "n", "at")], pa.array(out["count"], pa.int64()),
             pa.array(out["body"], pa.binary())],
            ["doc_id", "text_hash", "start", "n", "at", "count", "body"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of each block: the window starts that lie up to ``STEP`` bytes
    apart, counted from the anchor.  ``core`` is a hash of the bytes that all
    windows of a full cell hold, ``hull`` of all bytes of the cell's windows."""
    for part in T.pieces(batches, "body", 1 << 16):
        body = part.column("body").cast(pa.large_binary())
        offsets = np.frombuffer(body.buffers()[1], dtype=np.int64)[body.offset:body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
        n, at = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
        least = (at - n + 1) // STEP
        many = at // STEP - least + 1
        row = np.repeat(np.arange(len(n)), many)
        j = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - least, many)
        low, high = STEP * j, np.minimum(STEP * j + STEP - 1, _REST)
        first, last = np.maximum(0, at[row] - high), np.minimum(n[row] - 1, at[row] - low)
        base = (offsets - offsets[0])[row]
        core = B.range_hash(data, 2)(base + at[row] - low, base + at[row] - high + LENGTH)
        hull = B.range_hash(data, 3)(base + first, base + last + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [part.column("rid").take(pa.array(row)), pa.array(first.astype(np.int32)),
             pa.array((last - first + 1).astype(np.int32)), part.column("count").take(pa.array(row)),
             pa.array(T.combine([core, j.astype(np.uint64)], 1).view(np.int64)), pa.array(hull.view(np.int64))],
            ["rid", "first", "n", "count", "core", "hull"])


#: Blocks that are worked on together.
_TOGETHER = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, _TOGETHER):
            yield batch.slice(a, _TOGETHER)


def _flat(lists: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """A list column's entries as arrays: their rows, then the fields."""
    row = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    entries = lists.flatten()
    return row, *[np.asarray(entries.field(f).to_numpy(zero_copy_only=False)) for f in fields]


def _starts(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks' window starts: their rows, the starts, and whether the cell's
    hull stands only once."""
    row, first, n, once = _flat(cells, "first", "n", "once")
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), np.repeat(first, n) + within, np.repeat(once, n)


def _sampled(at: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Sampled places whose names the windows that begin at places ``at`` are
    ordered by, at the first level: their own and those at the distances of the
    next levels.  ``base``: where each block begins, and the end."""
    need = np.zeros(base[-1], dtype=bool)
    for shift in range(3):
        need[at + shift] = True
    need[(np.arange(base[-1]) - np.repeat(base[:-1], np.diff(base))) % 3 == 0] = False
    for _, offsets in reversed(LEVELS):
        at = np.flatnonzero(need)
        for o in offsets[1:]:
            need[at + o] = True
    return np.flatnonzero(need)


def _packed(rid: np.ndarray, pos: np.ndarray, *keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rid), pa.array(pos.astype(np.int32)), *map(pa.array, keys)], ["rid", "pos", "k0", "k1", "k2"])


def _first_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        data, base = T.utf8(part.column("body"))
        row, start, _ = _starts(part.column("cells"))
        at = _sampled(base[row] + start, base)
        row = np.searchsorted(base, at, side="right") - 1
        # Big-endian 8-byte characters, their order kept in signed numbers.
        keys = [(np.ascontiguousarray(data[at[:, None] + np.arange(8 * k, 8 * k + 8)]).view(">u8").ravel()
                 .astype(np.uint64) ^ _SIGN).view(np.int64) for k in range(3)]
        yield _packed(part.column("rid").to_numpy()[row], at - base[row], *keys)


def _next_triples(offsets: tuple[int, ...]):
    """Triples of the names at the distances, where all three exist."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row, pos, value = _flat(part.column("named"), "pos", "name")
            if not len(row):
                continue
            last = np.zeros(part.num_rows, dtype=np.int64)
            np.maximum.at(last, row, pos)
            base = np.concatenate(([0], np.cumsum(last + offsets[-1] + 1)))
            name = np.full(base[-1], -1, dtype=np.int64)
            at = base[row] + pos
            name[at] = value
            keys = [name[at + o] for o in offsets]
            ok = (keys[0] >= 0) & (keys[1] >= 0) & (keys[2] >= 0)
            yield _packed(part.column("rid").to_numpy()[row[ok]], pos[ok], *[k[ok] for k in keys])
    return run


def _merge_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window's keys (shift, name, other two bytes); pos is twice its start,
    and one more in a cell whose hull stands once."""
    for part in _slices(batches):
        data, base = T.utf8(part.column("body"))
        rid = part.column("rid").to_numpy()
        spread = base + 3 * np.arange(len(base))  # a block's names, and room for three more
        name = np.full(spread[-1], -1, dtype=np.int64)
        row, pos, value = _flat(part.column("named"), "pos", "name")
        name[spread[row] + pos] = value
        row, start, once = _starts(part.column("cells"))
        for shift in range(3):
            there = name[spread[row] + start + shift] >= 0
            r, p = row[there], start[there]
            around = [base[r] + p + k for k in range(shift)] \
                + [base[r] + p + shift + COVERED + k for k in range(2 - shift)]
            yield _packed(rid[r], 2 * p + once[there], np.full(len(p), shift, dtype=np.int64),
                          name[spread[r] + p + shift], data[around[0]].astype(np.int64) * 256 + data[around[1]])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: (rid, pos, name) of those whose neighbour has the
    same key.  Names grow with the key.  Of a key that the next batch may go on
    with, only a single row waits; from its second row on, rows go out at once."""
    base, number, key, first = TaskContext.get().partitionId() << 33, -1, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rid, pos, *keys = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(rid), dtype=bool)
        new[0] = key != tuple(int(k[0]) for k in keys)
        new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
        several = ~(new & np.append(new[1:], True))
        place = number + np.cumsum(new)
        out = [rid[several], pos[several], base + place[several]]
        if first is not None and not new[0]:
            out = [np.concatenate((np.array([x], dtype=y.dtype), y)) for x, y in zip((*first, base + number), out)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["rid", "pos", "name"])
        number, key = int(place[-1]), tuple(int(k[-1]) for k in keys)
        first = (int(rid[-1]), int(pos[-1])) if new[-1] else None


_KEYS = "rid bigint, pos int, k0 bigint, k1 bigint, k2 bigint"


def _drop(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _sorted_names(triples: DataFrame, label: str) -> DataFrame:
    """Names by a global sort of the triples; unique ones are left out."""
    spark = triples.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["k0", "k1", "k2"]
    return stage_table(triples.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                       .mapInArrow(_names, "rid bigint, pos int, name bigint"), label)


def _by_block(names: DataFrame) -> DataFrame:
    """All names of a block (a bounded number) in one row."""
    return names.groupBy("rid").agg(F.collect_list(F.struct("pos", "name")).alias("named"))


def repeated_starts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, n): runs of starts of repeated 200-byte windows."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .filter(F.octet_length("text") >= LENGTH).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = source.schema["doc_id"].dataType.simpleString()
    blocks = stage_table(source.select("doc_id", "text_hash", "text")
                         .mapInArrow(B.blocks, B.BLOCKS.format(id=kind))
                         .withColumn("bid", F.monotonically_increasing_id()), "suffix-blocks")
    distinct = blocks.groupBy("anchor", "block").agg(F.count("*").alias("count"), F.min("bid").alias("one"))
    held = distinct.groupBy("anchor").agg(F.count("*").alias("blocks"), F.max("count").alias("most"),
                                          F.min("count").alias("least"))
    some = distinct.join(held.filter("blocks > 1 or most > 1"), "anchor")
    places = stage_table(blocks.join(some, ["anchor", "block"]).withColumn("first", F.col("bid") == F.col("one"))
                         .drop("anchor", "block", "bid", "one"), "suffix-places")
    _drop(blocks)
    whole = places.filter("count > 1").select("doc_id", "text_hash", "start", "n")

    listed = (places.filter("first and blocks > 1 and least = 1").groupBy("doc_id", "text_hash")
              .agg(F.collect_list(F.struct("start", "n", "at", "count")).alias("found")))
    # Rows that repeat an id and a text give the same bodies, whose blocks are counted as repeated already.
    same = source["doc_id"].eqNullSafe(listed["doc_id"]) & (source["text_hash"] == listed["text_hash"])
    texts = source.join(listed, same).select(source["doc_id"], source["text_hash"], "text", "found")
    bodies = stage_table(texts.mapInArrow(
        _bodies, f"doc_id {kind}, text_hash bigint, start int, n int, at int, count bigint, body binary")
        .withColumn("rid", F.monotonically_increasing_id()), "suffix-bodies")
    cells = stage_table(bodies.select("rid", "n", "at", "count", "body").mapInArrow(
        _cells, "rid bigint, first int, n int, count bigint, core bigint, hull bigint"), "suffix-cells")
    hulls = cells.groupBy("core", "hull").agg(F.sum("count").alias("weight"), F.min("rid").alias("one"))
    cores = hulls.groupBy("core").agg(F.count("*").alias("hulls"), F.min("weight").alias("least"))
    open_core = (F.col("hulls") > 1) & (F.col("least") == 1)
    known = hulls.join(cores, "core").filter(open_core | (F.col("weight") > 1))
    status = (cells.join(known, ["core", "hull"])
              .groupBy("rid").agg(F.collect_list(F.struct(
                  "first", "n", (F.col("weight") == 1).alias("once"),
                  (open_core & (F.col("rid") == F.col("one"))).alias("sorted"))).alias("cells")))
    held = stage_table(bodies.join(status, "rid"), "suffix-held")
    _drop(bodies, cells)
    again = (held.filter("count = 1").select("doc_id", "text_hash", "start", F.explode("cells").alias("cell"))
             .filter("not cell.once")
             .select("doc_id", "text_hash", (F.col("start") + F.col("cell.first")).alias("start"), F.col("cell.n").alias("n")))
    kept = (held.withColumn("cells", F.filter("cells", lambda c: c["sorted"])).filter("size(cells) > 0")
            .select("rid", "doc_id", "text_hash", "start", "body", "cells"))

    names = _sorted_names(kept.select("rid", "body", "cells").mapInArrow(_first_triples, _KEYS), "suffix-names")
    for _, offsets in LEVELS:
        longer = _sorted_names(_by_block(names).mapInArrow(_next_triples(offsets), _KEYS), "suffix-names")
        _drop(names)
        names = longer
    keys = (kept.select("rid", "body", "cells").join(_by_block(names), "rid")
            .select("rid", "body", "cells", "named").mapInArrow(_merge_keys, _KEYS))
    repeated = _sorted_names(keys, "suffix-repeated")
    _drop(names)
    flagged = (repeated.filter("pos % 2 = 1")
               .select("rid", F.expr("pos div 2").cast("int").alias("pos")).distinct())
    single = (flagged.join(kept.select("rid", "doc_id", "text_hash", "start"), "rid")
              .select("doc_id", "text_hash", (F.col("start") + F.col("pos")).alias("start"), F.lit(1).alias("n")))
    return whole.union(again).union(single)


REMOVED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(text_col: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # The text is taken from the row, so that it is sent only once.
    named = (pa.RecordBatch.from_arrays([*b.columns, pc.struct_field(b.column("row"), text_col).cast(pa.large_string())],
                                        ["row", "runs", "text"]) for b in batches)
    for part in T.pieces(named, "text"):
        data, offsets = T.utf8(part.column("text"))
        raw, n, spans, kept = data.tobytes(), [], [], []
        for r, runs in enumerate(part.column("runs").to_pylist()):
            text = raw[offsets[r]:offsets[r + 1]]
            if not runs:
                n.append(0)
                spans.append(0)
                kept.append(text)
                continue
            step = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(step, [x["start"] for x in runs], 1)
            np.add.at(step, [x["start"] + x["n"] - 1 + LENGTH for x in runs], -1)
            gone = np.cumsum(step)[:-1] > 0
            n.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (the input row), n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    runs = (repeated_starts(docs, id_col, text_col).distinct().groupBy("doc_id", "text_hash")
            .agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col(f"row.{text_col}").cast("string")
    both = rows.join(runs, F.col(f"row.{id_col}").eqNullSafe(runs["doc_id"])
                     & (F.xxhash64(text) == runs["text_hash"]), "left")
    schema = S.StructType([both.schema["row"], *S.StructType.fromDDL(REMOVED)])
    return both.select("row", "runs").mapInArrow(partial(_cut, text_col), schema)
