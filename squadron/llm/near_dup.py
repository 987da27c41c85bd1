"""MinHash near-dedup.

Fast similarity sketching: the sketch has ``SKETCH`` bins.  In each of the
first ``SKETCH`` rounds every shingle is thrown into a hashed bin, in the next
``SKETCH`` rounds into the bin of the round's number; a bin keeps its smallest
(round, hash).  Every coordinate of a non-empty set is therefore filled, after
about ``SKETCH * ln(SKETCH) / |set|`` rounds, and two sets agree on a
coordinate with a probability near their similarity, with concentration.
``BANDS`` bands of ``ROWS`` coordinates give the candidates: a pair at
similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
Candidates are verified on the full sets of 64-bit shingle hashes, so two different
shingles count as one only where their hashes collide.

Equal sets are one class from the start (a partial aggregate, so thousands of
copies cost one row).  Within a bucket of a band every class is compared with
the bucket's leader first, the class that shares most buckets with others; only
buckets that still hold classes of different components are looked at again,
small ones pair by pair, the others by prefix and positional filtering (rarest
shingles first), which is exact.  So a large group of near copies costs a star,
not all its pairs.  What is gathered for each bucket is written before it meets
the bucket's members: Spark then sends it by its measured size, or splits a
crowded bucket over tasks (it splits no join whose other side is an aggregate).

Defined results: a null or wordless text has an empty set and is linked with
nothing; a null id is linked with nothing and kept; rows that repeat an id are
each judged by their own text and share the id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from squadron.llm import textkit as T
from squadron.llm.components import components
from squadron.session import stage_table

SHINGLE = 5
SKETCH = 128
ROWS = 4
BANDS = SKETCH // ROWS
SIMILARITY_PERCENT = 75
#: Larger buckets are compared by their members' rarest shingles instead.
BUCKET_PAIRS = 4

_U = np.uint64


def sketch(value: np.ndarray, row: np.ndarray, n: int, bins: int = SKETCH) -> np.ndarray:
    """Sketches (n x bins) of n sets given as (value, row) pairs, rows sorted.
    A set without values keeps the largest number in every bin."""
    empty = np.iinfo(np.uint64).max
    out = np.full(n * bins, empty, dtype=np.uint64)
    waiting = np.zeros(n, dtype=bool)
    waiting[row] = True
    for turn in range(2 * bins):
        live = waiting[row]
        if not live.all():
            value, row = value[live], row[live]
        if not len(value):
            break
        h = T.mix(value + _U((turn + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        key = (h >> _U(8)) | _U(turn) << _U(56)
        spot = (h & _U(bins - 1)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(out, row * bins + spot, key)
        waiting = waiting & (out.reshape(n, bins) == empty).any(axis=1)
    return out.reshape(n, bins)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.pieces(batches, "text"):
        words = T.Words(part.column("text"))
        value, row = T.shingles(words, SHINGLE)
        n = part.num_rows
        size = np.bincount(row, minlength=n)
        bound = np.concatenate(([0], np.cumsum(size)))
        sums = []
        for seed in (0x1B873593, 0xCC9E2D51):
            total = np.zeros(len(value) + 1, dtype=np.uint64)
            np.cumsum(T.mix(value * _U(2 * seed + 1) + _U(seed)), out=total[1:])
            sums.append((total[bound[1:]] - total[bound[:-1]]).view(np.int64))
        grid = sketch(value, row, n)
        bands = np.stack([T.combine([grid[:, b * ROWS + r] for r in range(ROWS)], b + 1)
                          for b in range(BANDS)], axis=1)
        full = size > 0
        lengths = np.where(full, BANDS, 0)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]),
             pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)),
                                      pa.array(bands[full].ravel().view(np.int64)))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.pieces(batches, "text"):
        value, row = T.shingles(T.Words(part.column("text")), SHINGLE)
        size = np.bincount(row, minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"),
             pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)),
                                      pa.array(value.view(np.int64)))],
            names=["doc_id", "members"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_of_a")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_of_b")), "b"))
    shared = F.size(F.array_intersect("set_of_a", "set_of_b"))
    return (both.withColumn("shared", shared)
            .filter(100 * F.col("shared")
                    >= SIMILARITY_PERCENT * (F.size("set_of_a") + F.size("set_of_b") - F.col("shared")))
            .select("a", "b"))


def _close(n: str, m: str):
    """Sizes that allow the similarity."""
    return ((100 * F.least(F.col(n), F.col(m))) >= (SIMILARITY_PERCENT * F.greatest(F.col(n), F.col(m))))


def _across(member: DataFrame, key: str) -> DataFrame:
    """Pairs of members that share a key value and are in different groups."""
    left = member.select(key, F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("group").alias("ga"),
                         F.col("place").alias("pa"))
    right = member.select(key, F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("group").alias("gb"),
                          F.col("place").alias("pb"))
    fits = (left[key] == right[key]) & (F.col("ga") < F.col("gb")) & _close("n", "m") \
        & (F.least(F.col("n") - F.col("pa"), F.col("m") - F.col("pb")) + 1 >= _shared_at_least("n", "m"))
    return left.join(right, fits).select("a", "b")


def _shared_at_least(n: str, m: str):
    """Shingles that two sets of these sizes must share."""
    return F.ceil((F.col(n) + F.col(m)) * SIMILARITY_PERCENT / (100 + SIMILARITY_PERCENT))


def _prefixes(member: DataFrame, sets: DataFrame) -> DataFrame:
    """The members' rarest shingles and their places: in any common order two
    similar sets share one of their first n - ceil(0.75 n) + 1, and at the first
    that they share enough shingles must follow in both, so no pair is lost."""
    crowd = member.select("node", "n_shingles", "group").distinct()
    tokens = (crowd.join(sets.withColumnRenamed("doc_id", "node"), "node")
              .select("node", "n_shingles", "group", F.explode("members").alias("token")))
    rarity = tokens.groupBy("token").agg(F.count("*").alias("held"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "token"))
    need = F.ceil(F.col("n_shingles") * SIMILARITY_PERCENT / 100)
    return (tokens.join(rarity, "token").withColumn("place", place)
            .filter((F.col("place") <= F.col("n_shingles") - need + 1) & (F.col("held") > 1)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id
    reachable over links), kept (the document is its component's smallest id)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stage_table(source.mapInArrow(
        _signatures, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, "
                     "set_a bigint, set_b bigint, bands array<bigint>"), "near-sketch")
    key = ["n_shingles", "set_a", "set_b"]
    known = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stage_table(known.groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")),
                          "near-classes")
    spread = stage_table(classes.select("node", "n_shingles", F.explode("bands").alias("band")), "near-bands")

    sizes = stage_table(spread.groupBy("band").agg(F.count("*").alias("crowd")).filter("crowd > 1"), "near-sizes")
    member = stage_table(spread.join(sizes, "band"), "near-members")
    central = stage_table(member.groupBy("node").agg(F.sum("crowd").alias("central")), "near-central")
    sets = stage_table(source.join(central.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(
        _sets, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, members array<bigint>"), "near-sets")

    ranked = member.join(central, "node")
    leader = stage_table(ranked.groupBy("band").agg(F.max(F.struct("central", "node", "n_shingles")).alias("leader")),
                         "near-leaders")
    pairs = (member.join(leader, "band").filter("node <> leader.node")
             .select(F.col("node").alias("a"), F.col("n_shingles").alias("n"),
                     F.col("leader.node").alias("b"), F.col("leader.n_shingles").alias("m"))
             .filter(_close("n", "m")).select("a", "b").distinct())
    links = stage_table(_verified(stage_table(pairs, "near-pairs"), sets), "near-links")
    joined = components(links)

    grouped = (member.join(joined, "node", "left")
               .select("node", "n_shingles", "band", "crowd", F.coalesce("component", "node").alias("group")))
    open_ = stage_table(grouped.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high"))
                        .filter("low < high").select("band"), "near-open")
    rest = stage_table(grouped.join(open_, "band", "left_semi"), "near-rest")
    few = rest.filter(F.col("crowd") <= BUCKET_PAIRS).withColumn("place", F.lit(0))
    pairs = _across(few, "band").union(_across(_prefixes(rest.filter(F.col("crowd") > BUCKET_PAIRS), sets), "token"))
    found = stage_table(_verified(stage_table(pairs.distinct(), "near-pairs"), sets), "near-links")
    if not found.isEmpty():
        joined = components(links.union(found))
    label = (classes.join(joined, "node", "left")
             .select(*key, F.coalesce("component", "node").alias("component")))
    return (signed.join(label, key, "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
