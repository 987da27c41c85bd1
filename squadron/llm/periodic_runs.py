"""Periodic run detection.

A run is a stretch of consecutive words with smallest period q, at least
``max(MIN_WORDS, EXPONENT * q)`` words long, that no neighbour extends.  Position
i of period q matches when the words i and i + q are the same; a run is a
maximal stretch of ``length - q >= 2q`` matches.

Scale-tiled distribution: periods are taken by octave, 1 to ``FIRST - 1`` and
then [B, 2B) for B = ``FIRST``, 2 ``FIRST``, ...  A stretch of matches of a run
of octave B is at least 2B - 1 long, so it covers a whole block [c, c + B) with
c a multiple of B.  Each document is exploded into tiles of up to 5B words
around such c, of every octave, overlapping by four fifths; only tiles whose
block stands again at some distance of the octave are made (hashes of doubling
width decide, so a tile too many is possible and one too few is not).

Texts without tiles have no runs and are settled where they are read; only the
others are written beside their tiles, and only they meet their runs by a join.

A tile is solved by itself: the Z-function of the words from c gives the matches
to the right for every period, that of the reversed words those to the left.
Periods whose root (the q words from c) is itself a power are left out, as the
whole run then has the shorter period.  Fragments of matches are clipped to the
tile, dealt by (document, period), and those that overlap are stitched.

Memory: a task holds one slice of texts as word numbers; tiles are dealt over
all tasks, so one very long text is solved by many.  By the runs theorem a
document of n words has O(n) fragments.  Equal rows share their fragments.

Defined results: a null or wordless text has no words and no runs; rows are told
apart by id and text, so null and repeated ids are judged by their own text; an
empty table gives an empty result; other columns stay in ``row``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as S

from squadron.llm import textkit as T
from squadron.session import stage_table

MIN_WORDS = 24
EXPONENT = 3
#: Block of the first octave: a run of a period below it has MIN_WORDS - 7 matches or more, two blocks less one.
FIRST = 8
TILE_BYTES = 4 << 20

RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def octaves(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, first period, period behind the last) for texts up to that long."""
    block, low, high = FIRST, 1, FIRST
    while EXPONENT * low <= longest:
        yield block, low, high
        block, low, high = high, high, 2 * high


def numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as numbers, one text after the other, and each text's
    first word (and the end).  Equal words of a text have equal numbers."""
    parts, first = [], [0]
    for text in column.cast(pa.binary()):
        seen: dict[bytes, int] = {}
        n = first[-1]
        for words in T.word_blocks(text.as_py() or b""):
            parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
            n += len(words)
        first.append(n)
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.array(first)


def centres(word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """For each octave (block, low, high) the centres c, multiples of the block
    from the text's first word, whose block of words stands again low to high - 1
    words later in the text, and the texts that they are in."""
    lengths = np.diff(first)
    # A mark of its own behind every text keeps blocks that cross texts apart.
    texts = np.arange(len(lengths))
    spaced = np.empty(len(word) + len(lengths), dtype=np.uint64)
    spaced[np.arange(len(word)) + np.repeat(texts, lengths)] = word.astype(np.uint64)
    spaced[first[1:] + texts] = np.uint64(1 << 32) + texts.astype(np.uint64)
    name, wide = T.mix(spaced + np.uint64(1)), 1
    for block, low, high in octaves(int(lengths.max(initial=0))):
        while wide < block:
            name = T.mix(name[:-wide] * np.uint64(0xA0761D6478BD642F) + name[wide:])
            wide *= 2
        number = np.where(lengths >= EXPONENT * low, np.maximum(0, (lengths - block - low) // block + 1), 0)
        text = np.repeat(texts, number)
        c = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)) * block
        found = np.zeros(len(c), dtype=bool)
        padded = np.concatenate((name, np.zeros(high + block, dtype=np.uint64)))
        later = np.lib.stride_tricks.sliding_window_view(padded, high - low)
        step = max(1, (1 << 20) // (high - low))
        for k in range(0, len(c), step):
            at = c[k:k + step] + text[k:k + step]
            found[k:k + step] = (later[at + low] == name[at][:, None]).any(axis=1)
        yield block, low, high, c[found], text[found]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Slices with their words, their tiles' centres, and which texts have any."""
    for part in T.pieces(batches, "text"):
        word, first = numbered(part.column("text"))
        found = [f for f in centres(word, first) if len(f[3])]
        open_ = np.zeros(part.num_rows, dtype=bool)
        for *_, text in found:
            open_[text] = True
        yield part, word, first, found, open_


_TILE = ("block", "low", "high", "start", "centre")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has tiles, and its tiles."""
    for part, word, first, found, open_ in _parts(batches):
        if not found:
            continue
        rows = pa.array(np.flatnonzero(open_))
        none = [pa.nulls(len(rows), pa.int64())] * len(_TILE)
        yield pa.RecordBatch.from_arrays(
            [part.column(k).take(rows) for k in ("key_a", "key_b", "row", "text")]
            + none + [pa.nulls(len(rows), pa.list_(pa.int32()))], ["key_a", "key_b", "row", "text", *_TILE, "words"])
        for block, low, high, centre, text in found:
            start = np.maximum(first[text], centre - block)
            stop = np.minimum(first[text + 1], centre + 2 * block + high)
            step = max(1, TILE_BYTES // (4 * (3 * block + high)))
            for k in range(0, len(centre), step):
                a, b, r = start[k:k + step], stop[k:k + step], text[k:k + step]
                n = b - a
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
                same = lambda x: pa.array(np.full(len(r), x, dtype=np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [part.column("key_a").take(pa.array(r)), part.column("key_b").take(pa.array(r)),
                     pa.nulls(len(r), part.column("row").type), pa.nulls(len(r), part.column("text").type),
                     same(block), same(low), same(high), pa.array(a - first[r]), pa.array(centre[k:k + step] - a),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)),
                                              pa.array(word[inside], pa.int32()))],
                    ["key_a", "key_b", "row", "text", *_TILE, "words"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose text has no tiles, and so no runs."""
    for part, _, first, _, open_ in _parts(batches):
        rows = np.flatnonzero(~open_)
        texts = [b" ".join(w for block in T.word_blocks(t.as_py() or b"") for w in block)
                 for t in part.column("text").take(pa.array(rows)).cast(pa.binary())]
        none = pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1, np.int32)), pa.array([], _RUN))
        yield pa.RecordBatch.from_arrays(
            [part.column("row").take(pa.array(rows)), pa.array(np.diff(first)[rows]), none,
             pa.array(texts, pa.binary()).cast(pa.string())], ["row", "n_words", "runs", "collapsed"])


def z_function(s: list[int], most: int) -> list[int]:
    """For i below ``most``: how far s from i equals s from its begin."""
    n = len(s)
    z = [0] * min(most, n)
    left = right = 0
    for i in range(1, len(z)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@functools.cache
def prime_parts(q: int) -> tuple[int, ...]:
    """q divided by each of its prime divisors."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def solve(words: list[int], centre: int, block: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the stretches of matches around the tile's block."""
    right = words[centre:]
    z = z_function(right, high)
    live = [q for q in range(low, min(high, len(z))) if z[q] >= block
            and not any(z[d] >= q - d for d in prime_parts(q))]
    if not live:
        return []
    end = min(len(words), centre + high)
    left = words[centre - 1::-1] if centre else []
    back = z_function([*left, -1, *words[end - 1::-1]], len(left) + 2 + end - centre)
    return [(q, centre - back[len(left) + 1 + end - centre - q], centre + min(z[q], 2 * block)) for q in live]


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out = [], []
        values = [batch.column(k).to_numpy().tolist() for k in _TILE]
        words = batch.column("words")
        for i, (block, low, high, start, centre) in enumerate(zip(*values)):
            for q, a, b in solve(words[i].values.to_numpy().tolist(), centre, block, low, high):
                rows.append(i)
                out.append((q, start + a, start + b))
        if out:
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(pa.array(rows)) for k in ("key_a", "key_b")]
                + [pa.array(x, pa.int64()) for x in zip(*out)], ["key_a", "key_b", "period", "start", "stop"])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.pieces(batches, "text"):
        count, texts = [], []
        for text, runs in zip(part.column("text").cast(pa.binary()), part.column("runs")):
            words = [w for block in T.word_blocks(text.as_py() or b"") for w in block]
            count.append(len(words))
            if runs.values is not None and len(runs.values):
                keep = np.ones(len(words), dtype=bool)
                for run in runs.as_py():
                    keep[run["start"] + run["period"]:run["start"] + run["length"]] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(count, pa.int64()), part.column("runs"),
             pa.array(texts, pa.binary()).cast(pa.string())], ["row", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the table: row, n_words, runs (by start, then period)
    and collapsed, the text without the words that repeat a run's first period."""
    name, text = docs[id_col].cast("string"), docs[text_col].cast("string")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("text"),
                        F.xxhash64(name, text).alias("key_a"), F.xxhash64(F.lit(1), name, text).alias("key_b"))
    key = ["key_a", "key_b"]
    row = keyed.schema["row"].dataType
    opened = stage_table(keyed.mapInArrow(_opened, S.StructType([
        *S.StructType.fromDDL("key_a bigint, key_b bigint"), S.StructField("row", row), S.StructField("text", S.StringType()),
        *S.StructType.fromDDL(", ".join(f"{k} bigint" for k in _TILE) + ", words array<int>")])), "runs-opened")
    tiles = opened.filter("words is not null").select(*key, *_TILE, "words")
    keys = "key_a bigint, key_b bigint, "
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (tiles.repartition(parts).mapInArrow(_fragments, keys + "period bigint, start bigint, stop bigint")
             .distinct())
    stretch = Window.partitionBy(*key, "period").orderBy("start", "stop")
    reach = F.max("stop").over(stretch.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("start") > F.col("reach")).cast("int")).over(stretch)
    whole = (found.withColumn("reach", F.coalesce(reach, F.col("start"))).withColumn("island", island)
             .groupBy(*key, "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
             .withColumn("length", F.col("stop") - F.col("start") + F.col("period"))
             .filter(F.col("length") >= F.greatest(F.lit(MIN_WORDS), EXPONENT * F.col("period"))))
    runs = stage_table(whole.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length")))
                                               .alias("runs")), "runs")
    listed = F.coalesce(F.transform("runs", lambda r: F.struct(
        r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))),
        F.array().cast(f"array<{RUN}>"))
    joined = (opened.filter("words is null").select(*key, "row", "text").join(runs, key, "left")
              .select("row", "text", listed.alias("runs")))
    schema = S.StructType([S.StructField("row", row), *S.StructType.fromDDL(
        f"n_words bigint, runs array<{RUN}>, collapsed string")])
    return keyed.select("row", "text").mapInArrow(_settled, schema).union(joined.mapInArrow(_collapsed, schema))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; of equal
    ones the first by start, then period (as the list stands); null without runs."""
    over = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(over(r, best), r).otherwise(best))
