"""Line dedup with levelled sorted runs.

Documents are taken in ``BATCHES`` batches by id.  The index is a set of runs:
parquet tables of (line hash, owner), each sorted by hash and without a hash
that another run has.  A batch reduces its lines to (hash, smallest id),
anti-joins the runs and adds the rest as a run of level 0; when a level has
``FANOUT`` runs, they are merged into one of the next level.  As batches are in
id order, a hash's owner is the smallest id that holds it, and every line whose
owner is another document goes.

Line keys are compared by two 64-bit hashes.  All work is DataFrame
expressions, joins and aggregates.

Defined results: a null or empty text is one empty line and stays empty; a null
id never owns a line and loses none; rows that repeat an id are one
document (its lines do not repeat each other); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as S

from squadron.session import stage_table

BATCHES = 4
FANOUT = 2
MIN_CHARS = 10

# White space that is stripped (space, and tab to carriage return); letters that are lower-cased.
_STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased (lower() does this
    where all characters are ASCII, and faster)."""
    bare = F.btrim(line, F.lit(_STRIPPED))
    return (F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare))
            .otherwise(F.translate(bare, _UPPER, _LOWER)))


def _batches(docs: DataFrame) -> Column:
    """Number of the batch of ``doc_id``; ids that are no numbers are one batch."""
    if not isinstance(docs.schema["doc_id"].dataType, S.NumericType):
        return F.lit(0)
    cuts = [i / BATCHES for i in range(1, BATCHES)]
    bounds = docs.agg(F.percentile_approx("doc_id", cuts).alias("cuts")).first()["cuts"] or []
    return sum((F.when(F.col("doc_id") > F.lit(b), 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))


class LineIndex:
    """The levelled runs: (h1, h2, owner), every hash once."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def owners(self, held: DataFrame) -> DataFrame:
        """The held (h1, h2, mine) with their owners so far, if any."""
        out = held.withColumn("owner", F.lit(None).cast(held.schema["mine"].dataType))
        if self.runs():
            known = self.runs()[0]
            for run in self.runs()[1:]:
                known = known.union(run)
            out = held.join(known, ["h1", "h2"], "left")
        return out.select("h1", "h2", "mine", "owner")

    def add(self, novel: DataFrame) -> None:
        """A batch's new hashes as a run; full levels move up merged."""
        run, level = _run(novel), 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.union(other)
            self.levels[level] = []
            run, level = _run(merged), level + 1


def _run(rows: DataFrame) -> DataFrame:
    """Rows (h1, h2, owner) as a table sorted by hash in every part."""
    return stage_table(rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2"), "line-run")


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line): every line (numbered from 0) that an earlier document holds."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .filter("doc_id is not null and text <> ''")
    key = line_key(F.col("text_line"))
    lines = (source.select("doc_id", F.xxhash64("text").alias("text_hash"),
                           F.posexplode(F.split("text", "\n", -1)).alias("line", "text_line"))
             .select("doc_id", "text_hash", "line", key.alias("key"))
             .filter(F.char_length("key") >= MIN_CHARS)
             .select("doc_id", "text_hash", "line", F.xxhash64("key").alias("h1"),
                     F.xxhash64(F.lit("line"), "key").alias("h2")))
    lines = stage_table(lines, "lines")
    index, dropped, number = LineIndex(), None, _batches(lines.select("doc_id"))
    for batch in range(BATCHES if isinstance(docs.schema[id_col].dataType, S.NumericType) else 1):
        own = lines.filter(number == batch)
        held = own.groupBy("h1", "h2").agg(F.min("doc_id").alias("mine"))
        looked = stage_table(index.owners(held), "line-owners")
        index.add(looked.filter("owner is null").select("h1", "h2", F.col("mine").alias("owner")))
        lost = (own.join(looked.select("h1", "h2", F.coalesce("owner", "mine").alias("owner")), ["h1", "h2"])
                .filter("owner <> doc_id").select("doc_id", "text_hash", "line"))
        dropped = lost if dropped is None else dropped.union(lost)
    return dropped


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows as ``row``, with n_lines, n_dropped and kept_text."""
    # A repeated id with the same text has the same lines, so distinct numbers serve each such row.
    lost = (duplicate_lines(docs, id_col, text_col).groupBy("doc_id", "text_hash")
            .agg(F.collect_set("line").alias("lost")))
    text = F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("text_now", text)
    both = rows.join(lost, (F.col(f"row.{id_col}") == lost["doc_id"])
                     & (F.xxhash64("text_now") == lost["text_hash"]), "left").select("row", "text_now", "lost")
    split = both.select("row", "text_now", "lost", F.split("text_now", "\n", -1).alias("cut"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), F.col("lost"))
    return split.select(
        "row", F.size("cut").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text_now"))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("cut"), i)), "\n")).alias("kept_text"))
