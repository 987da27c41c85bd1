"""One query per operator: the operator with its production parameters over
its whole table, reduced to the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from squadron.llm import (decontaminate, licenses, line_dedup, merkle, near_dup, periodic_runs, pieces,
                          quality_knn, quality_rules, secrets, simhash, suffix_dedup, url_rules)
from squadron.llm.oracle import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@_query
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, labelled=url_rules.labelled_by(pages)).select(
        "row.page_id", "host", "path", "rule", "verdict")


@_query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rated(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


@_query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(_read(spark, sf_dir, "documents").select("doc_id", "text"),
                                         _read(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "row.doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


@_query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


@_query
def op8_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, _read(spark, sf_dir, "labels"))
    return quality_knn.classify(docs, model).select(
        "row.doc_id", quality_knn.held_out("row.doc_id").alias("held_out"), "score", "predicted")


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, back=True))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proofs = merkle.build(docs, claimed={"text": tampered}).proofs()
    return (proofs.withColumn("folded_root", merkle.fold(F.col("claimed"), F.col("path")))
            .select(F.col("id").alias("doc_id"), "leaf", "subroot", "root",
                    merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), F.slice(again, F.lit(1), n - a)), " "))

    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), 0)
    made = F.get(F.transform(F.array(words), planted), F.lit(0))  # the words are extracted once
    found = periodic_runs.find_runs(docs.withColumn("text", F.when(h % 10 == 0, made).otherwise(F.col("text"))))
    best = periodic_runs.strongest(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]),
                                                                 F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")
