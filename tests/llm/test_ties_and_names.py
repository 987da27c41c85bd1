"""Ties, clashing names, very long texts, and what the models call ordinary."""

import ast
import random
import socket
import string
import unittest

import numpy as np
from pyspark.sql import functions as F

from squadron.llm import decontaminate, licenses, quality_knn, secrets, url_rules
from test_llm_operators import prose

HEX = "0123456789abcdef"


def _keys(n, letters, size, seed):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=size)) for _ in range(n)]


def test_rare_identifiers_are_no_secrets(spark, docs):
    """Labelled hex keys and the given documents teach; names of Python's own
    library and fresh keys of several alphabets are the held-out cases."""
    labelled = docs([(k, f"the token = {x} stands here") for k, x in enumerate(_keys(300, HEX, 40, 1))])
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ratio = secrets.train(given.select("text").union(labelled.select("text")))
    for name in ("MAX_CONNECTION_RETRY_COUNT", "my_very_long_identifier_name", "AbstractBeanFactoryProvider",
                 "/usr/local/share/applications/index", "----------------", "=" * 40):
        assert secrets.find(f"a {name} b".encode(), ratio) == [], name
    names = sorted({n for m in (ast, socket, unittest.TestCase) for n in dir(m) if len(n) >= secrets.MIN_RUN})
    wrong = [n for n in names if secrets.find(n.encode(), ratio)]
    assert len(names) > 100 and len(wrong) <= 0.05 * len(names), wrong
    base62 = string.ascii_letters + string.digits
    for letters, size in ((base62, 24), (base62, 40), (base62 + "+/", 32), (HEX, 20), (HEX.upper(), 32)):
        keys = _keys(200, letters, size, 7)
        assert sum(bool(secrets.find(f"a {x} b".encode(), ratio)) for x in keys) >= 0.9 * len(keys), letters


def test_transition_counts_equal_brute_force(docs):
    texts = ["ab-C9 token = abcdefgh1 é zz", "", None, "q", "Word word\nAKIA" + "Z" * 20]
    got = {(r["model"], r["cell"]): r["n"] for r in docs(list(enumerate(texts))).select("text").mapInArrow(
        secrets._counts, "model int, cell int, n bigint").groupBy("model", "cell").agg(F.sum("n").alias("n")).collect()}
    want = {}
    key = secrets._KEY.decode()
    for t in texts:
        raw = (t or "").encode()
        code = [key.find(chr(c)) if chr(c) in key else len(key) for c in raw]
        mine = [any(own <= i < stop for _, _, stop, own in secrets.base_spans(raw)) for i in range(len(raw))]
        for i in range(len(raw) - 1):
            if mine[i] == mine[i + 1] and min(code[i], code[i + 1]) < len(key):
                at = int(mine[i]), code[i] * (len(key) + 1) + code[i + 1]
                want[at] = want.get(at, 0) + 1
    assert got == want


def test_chances_are_distributions():
    count = np.zeros((len(secrets._KEY) + 1,) * 2)
    count[1, 2] = 7
    for p in (secrets.chances(count[:-1, :-1], 0.9, 0.01), secrets.chances(secrets.spelt(count), 0.3, 0.5)):
        assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()


def test_nearest_takes_the_first_of_equals():
    r = np.random.default_rng(2)
    near = np.round(r.random((50, 40)), 1)
    for k in (1, 5, 39, 40):
        for row, top in zip(near, quality_knn.nearest(near, k)):
            assert top.tolist() == sorted(sorted(range(40), key=lambda i: (-row[i], i))[:k])


def test_classifier_ties_and_repeated_ids(spark, docs):
    """More equal labelled rows than may vote, and ids with several texts: the
    scores do not depend on the order of the rows."""
    same = [(k, prose(60, 1)) for k in range(80)]
    other = [(k, prose(60, k)) for k in range(80, 120)]
    again = [(k, prose(50, 500 + k)) for k in range(100, 120)] + [(85, None)]
    table = [*same, *other, *again, (None, prose(60, 1))]
    known = [(k, int(k % 3 > 0)) for k in range(120)]
    scores = []
    for seed in (0, 1):
        random.Random(seed).shuffle(table)
        random.Random(seed).shuffle(known)
        labels = spark.createDataFrame(known, "doc_id bigint, quality int").repartition(3)
        model = quality_knn.fit(docs(table).repartition(2 + seed), labels)
        got = quality_knn.classify(docs(table), model).select(
            "row.doc_id", "row.text", F.round("score", 6), quality_knn.held_out("row.doc_id")).collect()
        scores.append(sorted(map(tuple, got), key=str))
    assert scores[0] == scores[1]
    assert [x[3] for x in scores[0] if x[0] is None] == [False]


def test_decontamination_with_clashing_names(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(k, prose(12, k)) for k in range(8)], "item_id int, text string")
    names = ["__before", "__text", "before", "win", "items", "spans", "n_hit"]
    table = docs([(k, f"{prose(5, 50)} {prose(12, k)} tail") for k in range(8)] + [(90, prose(4000, 91)), (91, None)])
    for c in names:
        table = table.withColumn(c, F.lit(c))
    found = lambda: sorted(map(tuple, decontaminate.find_benchmark(table, bench).select(
        "row.doc_id", "n_words", "n_hit", F.array_join("items", ","), "row.__text", "row.before").collect()))
    one = found()
    assert [r[2] for r in one[:8]] == [12] * 8 and [r[2] for r in one[8:]] == [0, 0]
    assert all(r[4:] == ("__text", "before") for r in one)
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", 300)  # several automata, one after the other
    assert len(list(decontaminate.windows(bench))) > 3
    assert found() == one


def test_licences_by_broadcast_and_by_shuffle(docs, monkeypatch):
    mit = licenses.KNOWN[-1][1]
    table = docs([(1, mit), (1, mit), (2, None), (None, "Released under the MIT License."), (3, ""), (4, "copyright x"),
                  (5, "\n".join(["plain words"] * 40000 + ["Released under the MIT License."]))])
    got = lambda: sorted(map(str, licenses.scan(table).collect()))
    one = got()
    assert len(one) == 7 and sum("license_id='MIT'" in r for r in one) == 3
    assert sum("n_notices=1" in r for r in one) == 2
    monkeypatch.setattr(licenses, "SENT_BYTES", 0)
    assert got() == one


def test_very_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://A.example.com/en/" + "x/" * 50000 + "?q=1"), (2, None), (3, "")],
                                  "page_id int, url string")
    got = {r["page_id"]: r for r in url_rules.judge(pages).select("row.page_id", "host", "rule", "verdict").collect()}
    assert got[1]["rule"] == "example.com/en/" and got[1]["verdict"] == "block" and got[1]["host"] == "a.example.com"
    assert got[2]["verdict"] == got[3]["verdict"] == "allow"
