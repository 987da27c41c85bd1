"""The pipeline against brute force, stage by stage, and the query registry."""

from __future__ import annotations

import brute

import corpus_pipeline
from squadron.llm import pieces, queries, quality_knn

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    model = quality_knn.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r[0] for r in quality_knn.classify(docs, model).filter("predicted = 0").select("row.doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected]
    seen, kept = {}, []
    for i, text in sorted(rows):
        key = lambda s: brute.ascii_lower(s.strip(" \t\n\x0b\x0c\r"))
        all_ = text.split("\n")
        kept.append((i, "\n".join(s for s in all_ if len(key(s)) < 10 or seen.setdefault(key(s), i) == i)))
    keep = {r[0] for r in brute.near(kept) if r[3]}
    kept = [r for r in kept if r[0] in keep]
    clean = {r[0] for r in brute.leaks(kept, bench) if not r[5]}
    want = {i: text for i, text in kept if i in clean}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want) and 0 < len(want) < docs.count()
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, text in want.items():
        assert got[i]["round_trip"] and got[i]["n_pieces"] == len(lib.encode(text))
        assert got[i]["ids_sha256"] == brute.sha(",".join(map(str, lib.encode(text))))


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None, "en", "s", None, "x"), (1, "", "en", "s", 0, "y"), (2, "a line that is long\nb", "en", "s", 21, "z"),
         (3, "a line that is long\nc", None, "s", 21, "z"), (3, "a line that is long\nc", None, "s", 21, "z")],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0
    lined = {r["doc_id"]: r for r in corpus_pipeline.lines(spark, docs, SF).filter("doc_id is not null").collect()}
    assert lined[3]["text"] == "c" and lined[3]["n_chars"] == 1 and lined[2]["n_chars"] == 21
    assert corpus_pipeline.lines(spark, docs, SF).filter("doc_id is null and text is null").count() == 1


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(queries.ORACLE) <= set(names)


def test_oracles(spark):
    """Spark against DuckDB for every operator with SQL."""
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got = queries.QUERIES[name](spark, SF)
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect()), name


def test_native_operators_run_no_python(spark):
    for name in ("op1_url_rules", "op9_line_dedup"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas")), name
