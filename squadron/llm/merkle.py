"""Merkle dataset manifest.

A manifest is a tree of digests for every group (``source``), and one more over
the groups' roots.  Every ``FAN`` consecutive nodes become the SHA-256 of their
hexadecimal digests, until one is left.  It is built from aligned subtrees of
``LEVELS`` levels: each is one group of ``FAN ** LEVELS`` rows at most, which a
task hashes and stores as a block; the block roots are the leaves of the next
tier, so a tree of n leaves takes log(n) / (LEVELS log FAN) tiers.

Van Emde Boas layout: a block's nodes stand in one byte string, split at half
height again and again, top half first, then the bottom subtrees from left to
right.  ``address`` is the arithmetic of that order; construction writes and
sibling retrieval reads through it, and a path from leaf to block root touches
few neighbouring stretches whatever the size of a cache line.

Leaves get their place from a range partitioning by (group, id) with a count
per (group, range), so a group that holds most rows is sorted by many tasks.

Defined results: a null field is ``-``; a null group is a group of its own, the
first; null ids come first in their group, rows that repeat an id follow by
leaf, and rows that are equal throughout take consecutive places; an empty
table has an empty manifest; columns beside the fields are not read.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as S

from squadron.session import stage_table

FAN = 3
#: Levels of a block above its leaves: 6,561 leaves, 315 KB of digests.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCK = "tree string, block bigint, total bigint, root string, nodes binary"
_PATH = "array<struct<left:string,right:string>>"


def size(rows: int) -> int:
    """Nodes of a complete subtree with that many rows."""
    return (FAN ** rows - 1) // (FAN - 1)


def address(rows: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in the layout of a subtree with ``rows`` rows, of the nodes that
    stand at ``index`` (from the left) in its row ``depth`` (the root's is 0)."""
    at = np.zeros(len(index), dtype=np.int64)
    while rows > 1:
        top = rows // 2
        if depth < top:
            rows = top
            continue
        under = FAN ** (depth - top)
        at += size(top) + index // under * size(rows - top)
        index, depth, rows = index % under, depth - top, rows - top
    return at


def height(n: int) -> int:
    """Levels from n leaves to one node."""
    levels = 0
    while FAN ** levels < n:
        levels += 1
    return levels


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def store(leaves: list[bytes], levels: int) -> bytes:
    """A block: the leaves' digests and all nodes above them, in layout order."""
    out = np.zeros((size(levels + 1), 32), dtype=np.uint8)
    for depth in range(levels, -1, -1):
        out[address(levels + 1, depth, np.arange(len(leaves)))] = \
            np.frombuffer(b"".join(leaves), dtype=np.uint8).reshape(-1, 32)
        names = [x.hex().encode() for x in leaves]
        leaves = [_hash(b"".join(names[i:i + FAN])) for i in range(0, len(names), FAN)]
    return out.tobytes()


def siblings(nodes: bytes, levels: int, n: int, slots: np.ndarray) -> list[list[dict[str, str]]]:
    """For leaves at these slots of a block of n leaves, level by level upwards:
    the digests that stand left and right of the path's node in its run."""
    table = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32)
    paths = [[] for _ in slots]
    for level in range(levels):
        here = -(-n // FAN ** level)
        names = [x.tobytes().hex() for x in table[address(levels + 1, levels - level, np.arange(here))]]
        beside = [{"left": "".join(names[i - i % FAN:i]), "right": "".join(names[i + 1:i - i % FAN + FAN])}
                  for i in range(here)]
        for path, i in zip(paths, (slots // FAN ** level).tolist()):
            path.append(beside[i])
    return paths


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: every field as byte count, colon and value, or ``-``."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
                             for c in text]), 256)


def _placed(items: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The items with their ``place`` in their tree and the tree's ``total``."""
    order = [*order, "digest", "mark"]
    marked = stage_table(items.withColumn("mark", F.monotonically_increasing_id()), f"{name}-marked")
    ranged = stage_table(marked.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()),
                         f"{name}-ranged")
    counts = ranged.groupBy("tree", "range").agg(F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tree", "range", F.sum("n").over(tree).alias("total"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("tree", "range").orderBy(*order))
    return (ranged.join(offsets, ["tree", "range"])
            .withColumn("place", F.col("before") + number - 1).drop("before", "range", "mark"))


def _fill(table: pa.Table, most: int) -> pa.Table:
    """One block from its leaves (tree, block, place, total, digest)."""
    order = np.argsort(table.column("place").to_numpy())
    leaves = [bytes.fromhex(x) for x in table.column("digest").take(pa.array(order)).to_pylist()]
    total = table.column("total")[0].as_py()
    nodes = store(leaves, min(most, height(total)))
    return pa.table({"tree": table.column("tree")[:1], "block": table.column("block")[:1],
                     "total": pa.array([total]), "root": pa.array([nodes[:32].hex()]), "nodes": pa.array([nodes])})


def _climb(items: pa.Table, block: pa.Table, most: int) -> pa.Table:
    """The items of one block with their paths: inside the block, then above it."""
    total, at = block.column("total")[0].as_py(), block.column("block")[0].as_py()
    above = block.column("above")[0].as_py()
    first = at * FAN ** most
    inside = siblings(block.column("nodes")[0].as_py(), min(most, height(total)), min(FAN ** most, total - first),
                      items.column("place").to_numpy() - first)
    path = pa.array([p + above for p in inside],
                    pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
    for name in ("subroot", "top"):
        items = items.append_column(name, pa.array([block.column(name)[0].as_py()] * items.num_rows, pa.string()))
    return items.append_column("path", path)


@dataclasses.dataclass(frozen=True)
class Trees:
    """Tiers of (items, blocks), lowest first.  An item has tree, block, place
    (in its tree's tier), total (of that tier), digest, and in the lowest tier
    the columns it came with; a block has ``nodes`` in layout order."""

    tiers: list[tuple[DataFrame, DataFrame]]
    levels: int

    @property
    def width(self) -> int:
        return FAN ** self.levels

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        out = None
        for _, blocks in self.tiers:
            done = blocks.filter(F.col("total") <= self.width).select("tree", F.col("root").alias("digest"))
            out = done if out is None else out.union(done)
        return out

    def paths(self, crown: DataFrame) -> DataFrame:
        """The lowest items with ``subroot``, ``top`` and ``path``; crown gives
        (tree, subroot, top, above) of every tree."""
        reached, most = None, self.levels  # tasks get the number, not the trees
        for items, blocks in reversed(self.tiers):
            whole = blocks.filter(F.col("total") <= self.width).join(crown, "tree")
            if reached is not None:
                upper = reached.select("tree", F.col("place").alias("block"), "subroot", "top",
                                       F.col("path").alias("above"))
                whole = whole.unionByName(blocks.filter(F.col("total") > self.width).join(upper, ["tree", "block"]))
            schema = S.StructType([*items.schema, *S.StructType.fromDDL(f"subroot string, top string, path {_PATH}")])
            key = [F.col("tree"), F.col("block")]
            reached = items.groupBy(*key).cogroup(whole.groupBy(*key)).applyInArrow(
                lambda i, b: _climb(i, b, most), schema)
        return reached


def trees(items: DataFrame, order: Sequence[str], name: str, levels: int) -> Trees:
    """Trees over items (tree, digest, and more), which ascend by ``order``."""
    level = _placed(items, order, name)
    tiers, width = [], FAN ** levels
    while True:
        level = stage_table(level.withColumn("block", F.expr(f"place div {width}")), f"{name}-items")
        blocks = stage_table(level.groupBy("tree", "block").applyInArrow(lambda t: _fill(t, levels), _BLOCK), f"{name}-blocks")
        tiers.append((level, blocks))
        more = blocks.filter(F.col("total") > width)
        if more.isEmpty():
            return Trees(tiers, levels)
        level = more.select("tree", F.col("block").alias("place"), F.expr(f"(total + {width - 1}) div {width}").alias("total"),
                            F.col("root").alias("digest"))


@dataclasses.dataclass(frozen=True)
class Manifest:
    """The groups' trees and the tree over their roots (tree ``root``)."""

    groups: Trees
    crown: Trees

    def proofs(self) -> DataFrame:
        """One row per document: id, leaf, claimed, subroot, root and path."""
        seed = self.crown.roots().select("tree", F.lit(None).cast("string").alias("subroot"),
                                         F.col("digest").alias("top"), F.array().cast(_PATH).alias("above"))
        over = self.crown.paths(seed).select(F.col("group").alias("tree"), F.col("digest").alias("subroot"), "top",
                                             F.col("path").alias("above"))
        return self.groups.paths(over).select("id", F.col("digest").alias("leaf"), "claimed", "subroot",
                                              F.col("top").alias("root"), "path")


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS,
          claimed: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of a table.  ``claimed`` names fields and the values to be
    checked against it; their leaf is carried as ``claimed``."""
    now = [docs[c] for c in fields]
    said = [(claimed or {}).get(c, docs[c]) for c in fields]
    group = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))  # null first, else bytewise
    leaves = docs.select(group.alias("tree"), docs[id_col].alias("id"), leaf(now).alias("digest"),
                         leaf(said).alias("claimed"))
    groups = trees(leaves, ["id"], "merkle", levels)
    crown = trees(groups.roots().select(F.lit("root").alias("tree"), F.col("tree").alias("group"), "digest"),
                  ["group"], "merkle-crown", levels)
    return Manifest(groups, crown)


def fold(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and the nodes beside its path give."""
    return F.aggregate(path, leaf_, lambda got, p: F.sha2(F.concat(p["left"], got, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all nodes beside the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)
