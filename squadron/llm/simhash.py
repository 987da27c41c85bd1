"""SimHash near-dedup.

A fingerprint bit is the majority of that bit over the XXH64 hashes of all
three-word shingles of a text.  Fingerprints that differ in ``DISTANCE`` = 3
bits or fewer are linked.

Multi-index hashing: a fingerprint is cut into two 32-bit segments, each with a
table of its own.  Of two linked fingerprints one segment differs in at most one
bit, so every fingerprint asks, for each segment, for the segment's value and
for the values one bit away.  Of a pair one bit apart only the side whose bit is
0 asks, so the pair is met once.  Every match is verified over all 64 bits.
Equal fingerprints are one row from the start.

Crowded values: more than ``CROWD`` fingerprints may share a segment, as near
copies do.  Such a value is not compared pair by pair.  A fingerprint stands at
all points up to two bits from its other segment, one that asks at all points
up to one bit away (if its segment is the value itself) or at its own (if it is
one bit off).  Those who meet at a point differ in three bits at most, and any
two linked ones meet at a point; so the first of each side there is linked with
all of the other, which joins the same documents.  Only so many fingerprints fit
around a point, so no point is crowded.

Defined results: a null or wordless text has fingerprint zero and is linked like
any other; a null id is linked too, and has as component the smallest id that is
not null, or null; rows that repeat an id are each judged by their own text; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from squadron.llm import textkit as T
from squadron.llm.components import components
from squadron.session import stage_table

SHINGLE = 3
SEED = 42
BITS = 64
SEGMENT = BITS // 2
DISTANCE = 3
#: Fingerprints of one segment value that are compared one by one.
CROWD = 64


def _hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of the text's shingles, in blocks; fewer words are one shingle."""
    rest: list[bytes] = []
    for words in T.word_blocks(text, lower=True):
        words = rest + words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            begins = np.concatenate(([0], ends[:-SHINGLE]))
            spans = map(slice, begins.tolist(), (ends[SHINGLE - 1:] - 1).tolist())
            yield np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED)),
                              dtype=">u8", count=len(begins))
            rest, whole = words[1 - SHINGLE:], False
        else:
            rest, whole = words, True
    if rest and whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(rest), SEED)], dtype=">u8")


def fingerprint(text: bytes) -> int:
    """The text's fingerprint as a signed 64-bit number."""
    n, ones = 0, np.zeros(BITS, dtype=np.int64)
    for h in _hashes(text):
        n += len(h)
        for k in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[k:k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.pieces(batches, "text"):
        prints = [fingerprint(t.as_py() or b"") for t in part.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.int64())], ["id", "fingerprint"])


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def _ball(x: Column, radius: int) -> Column:
    """All values of a segment within one or two bits of x."""
    places = F.sequence(F.lit(0), F.lit(SEGMENT - 1))
    if radius == 1:
        masks = F.transform(places, _bit)
    else:
        masks = F.flatten(F.transform(places, lambda i: F.transform(
            F.sequence(F.lit(0), i), lambda j: _bit(i).bitwiseOR(_bit(j)))))
    return F.concat(F.array(x), F.transform(masks, lambda m: x.bitwiseXOR(m)))


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _links_at_points(member: DataFrame, asking: DataFrame) -> DataFrame:
    """Links that join the same fingerprints as all pairs of a crowded value do."""
    key = ["segment", "value", "point"]
    far = member.select("segment", "value", F.explode(_ball(F.col("rest"), 2)).alias("point"), "print")
    near = asking.select("segment", "value", F.explode(
        F.when(F.col("exact"), _ball(F.col("rest"), 1)).otherwise(F.array("rest"))).alias("point"), "print")
    met = (near.groupBy(*key).agg(F.min("print").alias("near"))
           .join(far.groupBy(*key).agg(F.min("print").alias("far")), key))
    return (far.join(met, key).select(F.col("near").alias("a"), F.col("print").alias("b"))
            .union(near.join(met, key).select(F.col("far").alias("a"), F.col("print").alias("b"))))


def _linked(prints: DataFrame) -> DataFrame:
    """Links (a, b) over distinct fingerprints (print) that join all that are
    within DISTANCE bits; every one is within DISTANCE bits itself."""
    low = (1 << SEGMENT) - 1
    high = F.shiftrightunsigned("print", SEGMENT)
    rest = F.col("print").bitwiseAND(F.lit(low))
    entry = F.inline(F.array(
        F.struct(F.lit(0).alias("segment"), high.alias("value"), rest.alias("rest")),
        F.struct(F.lit(1).alias("segment"), rest.alias("value"), high.alias("rest"))))
    table = stage_table(prints.select("print", entry), "simhash-table")
    key = ["segment", "value"]
    crowded = stage_table(table.groupBy(*key).agg(F.count("*").alias("crowd")).filter(F.col("crowd") > CROWD)
                          .select(*key), "simhash-crowded")
    # The value itself, and those with one more bit.
    ask = F.array_union(F.array("value"), F.transform(
        F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: F.col("value").bitwiseOR(_bit(i))))
    asking = (table.withColumn("own", F.col("value")).withColumn("value", F.explode(ask))
              .withColumn("exact", F.col("own") == F.col("value")).drop("own"))

    def pairs(members: DataFrame) -> DataFrame:
        seen = members.select(*key, F.col("print").alias("b"))
        met = asking.withColumnRenamed("print", "a").join(seen, key).filter(
            (~F.col("exact") | (F.col("a") < F.col("b"))) & (_differ("a", "b") <= DISTANCE))
        return met.select("a", "b")

    if crowded.isEmpty():
        return pairs(table)
    apart = stage_table(table.join(crowded, key, "left_anti"), "simhash-apart")
    packed = stage_table(table.join(crowded, key, "left_semi"), "simhash-packed")
    points = _links_at_points(packed, stage_table(asking.join(crowded, key, "left_semi"), "simhash-asking"))
    return pairs(apart).union(points)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (a signed number) and component_id,
    the smallest id reachable over links."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    made = stage_table(source.mapInArrow(
        _fingerprints, f"id {source.schema['id'].dataType.simpleString()}, fingerprint bigint"), "simhash-prints")
    classes = stage_table(made.groupBy(F.col("fingerprint").alias("print")).agg(F.min("id").alias("low")),
                          "simhash-classes")
    joined = components(_linked(classes.select("print"))).withColumnRenamed("node", "print")
    member = classes.join(joined, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = member.groupBy("component").agg(F.min("low").alias("component_id"))
    label = stage_table(member.join(least, "component").select(F.col("print").alias("fingerprint"), "component_id"),
                        "simhash-labels")
    return made.join(label, "fingerprint").select("id", "fingerprint", "component_id")


def hexadecimal(fingerprint_: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_), BITS // 4, "0"))
