"""The training-data pipeline: quality classifier, line dedup, MinHash
near-dedup, benchmark decontamination, SentencePiece coding.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the
last return the columns of ``docs``, whatever these are besides doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from squadron.llm import decontaminate, line_dedup, near_dup, pieces, quality_knn
from squadron.session import stage_table

#: Text that is coded together; the workers still hold what earlier stages left.
CODING_BYTES = 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality_knn.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_knn.classify(docs, model).filter("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier one holds; n_chars, where
    the table has it, follows the text."""
    done = line_dedup.dedup_lines(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text"))
           .otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if new.get(c) is not None
                         else F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, and among rows
    of that id the text with the smallest hash.  Each row of a repeated id is
    judged by its own text; rows equal in id and text are one document, of which
    any one row stays.  Rows with a null id stay."""
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        gone = near_dup.near_duplicates(docs).filter("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    text_hash = F.xxhash64(docs["text"].cast("string"))
    key = F.when(docs["doc_id"].isNotNull(), F.struct(docs["doc_id"], text_hash.alias("text_hash")))
    gone = (near_dup.near_duplicates(docs.select(key.alias("doc_id"), "text")).filter("not kept")
            .select(F.col("doc_id.doc_id").alias("gone_id"), F.col("doc_id.text_hash").alias("gone_hash")).distinct())
    rest = docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (text_hash == gone["gone_hash"]), "left_anti")
    once = rest.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return (decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark"))
            .filter("n_hit = 0").select("row.*"))


def coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces: doc_id, n_pieces, ids_sha256, round_trip."""
    return pieces.digests(pieces.encode(docs.select("doc_id", "text"), back=True, group_bytes=CODING_BYTES))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near_duplicates),
    ("decontamination", benchmark), ("sentencepiece", coding),
]

#: The classifier and the coding have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
