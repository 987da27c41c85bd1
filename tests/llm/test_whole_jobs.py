"""Cases that the operators once left out."""

from __future__ import annotations

import random
import string
from pathlib import Path

import numpy as np
import pyarrow as pa
from test_llm_operators import edited, prose

import corpus_pipeline
from squadron.llm import licenses, secrets, suffix_dedup, url_rules

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

{}Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.

{}Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
{} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_whole_licences_with_their_titles(docs):
    by = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n"
    body = dict(licenses.KNOWN[-1:])["MIT"]
    no_bsd = next(t for i, t in licenses.KNOWN if i == "0BSD" and t.startswith("Permission"))
    folder = Path(licenses.__file__).parent / "license_texts"
    texts = [
        ("MIT", "MIT License\n\n" + by + body), ("MIT", "# The MIT License (MIT)\n=====\n" + by + body),
        ("MIT", "mit licence\n" + " ".join(body.split("\n")) + "\n"), ("0BSD", "BSD Zero Clause License\n\n" + by + no_bsd),
        ("BSD-2-Clause", by + BSD.format("* ", "* ", "", "OWNER")),
        ("BSD-2-Clause", "BSD 2-Clause License\n\n" + by + BSD.format("1. ", "2. ", "", "HOLDER")),
        ("BSD-3-Clause", "BSD 3-Clause License\n\n" + by + BSD.format("1. ", "2. ", NAMES, "HOLDER")),
        ("ISC", "ISC License\n\n" + by + """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""" + no_bsd[no_bsd.index("THE SOFTWARE"):]),
        ("Unlicense", next(t for i, t in licenses.KNOWN if i == "Unlicense"))]
    texts += [(p.stem, p.read_text()) for p in sorted(folder.glob("*.txt"))]
    whole = (folder / "Apache-2.0.txt").read_text()
    texts += [("Apache-2.0", whole[:whole.index("   APPENDIX")]), (None, "MIT License\n\nno text of it follows")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs([(k, t) for k, (_, t) in enumerate(texts)])).collect()}
    assert [got[k] for k in range(len(texts))] == [i for i, _ in texts]


def _keys(n, letters, size, seed):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=size)) for _ in range(n)]


def test_every_run_is_scored(docs):
    """Letters-only keys, keys after a path or a name, and keys beside a base span."""
    labelled = [(k, f"the token = {x} stands here") for k, x in
                enumerate(_keys(300, string.ascii_letters + string.digits, 40, 1))]
    r = random.Random(5)
    pairs = [a + b for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou"]
    word = lambda: "".join(r.choices(pairs, k=r.randint(2, 4)))
    words = [(1000 + k, " ".join(w for _ in range(400) for w in (word(), word().capitalize(), word().upper(),
                                                                 f"/{word()}/{word()}_{word()}={r.randint(1, 2000)}")))
             for k in range(20)]
    ratio = secrets.train(docs(labelled + words))
    path = "/" + "".join(word() + r.choice("/_") for _ in range(12))
    assert secrets.find(path.encode(), ratio) == []
    for key in _keys(20, string.ascii_letters, 24, 2) + _keys(20, string.ascii_letters + string.digits, 24, 3):
        assert secrets.find(f"a {key} b".encode(), ratio) == [(2, 3, 26)]
        for before, after in ((path, ""), ("_".join(word() for _ in range(8)) + "=", ""), (path, path)):
            a = len(before)
            text = (before + key + after).encode()
            assert any(k == 3 and s <= a and a + 24 <= e for s, k, e in secrets.find(text, ratio)), text
        base = "0123456789abcdef" * 2
        for text, at in ((f"{base}_{key}", 33), (f"{key}-{base}", 0)):
            found = secrets.find(text.encode(), ratio)
            assert (text.index(base), 2, text.index(base) + 32) in found
            assert any(k == 3 and s <= at and at + 24 <= e for s, k, e in found), text


def test_no_likely_part_is_left():
    """What is found between separators is likely, apart, and meets every likely part."""
    r = random.Random(4)
    ratio = np.random.default_rng(4).normal(0.2, 1.5, (len(secrets._KEY), len(secrets._KEY)))
    some = 0
    for _ in range(300):
        text = "".join(r.choice("abc1/_" if r.random() < 0.5 else "abcdXY12") for _ in range(r.randint(16, 70))).encode()
        code = [secrets._KEY.index(c) for c in text]
        mean = lambda a, b: sum(ratio[x, y] for x, y in zip(code[a:b - 1], code[a + 1:b])) / (b - a - 1)
        found = [(a, b) for a, _, b in secrets.find(text, ratio)]
        marks = [k for k, c in enumerate(text) if c in b"+/_=-"]
        edges = sorted({0, len(text), *marks, *(k + 1 for k in marks)})
        likely = [(a, b) for a in edges for b in edges if b - a >= secrets.MIN_RUN and mean(a, b) > secrets.MIN_RATIO]
        assert set(found) <= set(likely) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        assert all(any(a < y and x < b for x, y in found) for a, b in likely)
        some += 0 < len(found) and found != [(0, len(text))]
    assert some > 20


def test_segments_that_begin_with_a_digit_are_tokens(spark):
    label = [(f"http://s{k}.org/18plus/{k}", "block") for k in range(30)] + \
        [(f"http://t{k}.org/2024-news/{k}", "allow") for k in range(30)]
    pages = spark.createDataFrame([(1, "http://b.org/18plus/7"), (2, "http://c.org/2024-news/8"), (3, "http://d.org/77")],
                                  "page_id int, url string")
    labelled = spark.createDataFrame(label, "url string, label string")
    got = {r["page_id"]: (r["verdict"], r["because"]) for r in url_rules.judge(pages, labelled=labelled).select(
        "row.page_id", "verdict", "because").collect()}
    assert got == {1: ("block", "host:org path:18plus"), 2: ("allow", "host:org path:2024-news"), 3: ("allow", None)}
    number = url_rules.with_parts(pages.filter("page_id = 3")).select(url_rules.tokens().alias("t")).first()["t"]
    assert number == ["host:d.org", "host:org"]


def test_near_dedup_stage_with_repeated_ids(spark, docs):
    a, b, c = (prose(120, 800 + k) for k in range(3))
    near_a = edited(a, 0.01, 1)
    assert near_a != a
    cases = [
        ([(3, a), (5, a), (5, b)], [(3, a), (5, b)]),
        ([(5, a), (5, a), (5, a), (7, near_a)], [(5, a)]),
        ([(5, near_a), (5, b), (3, a), (7, b)], [(3, a), (5, b)]),
        ([(5, a), (5, b), (6, c), (6, c), (6, None), (6, None)], [(5, a), (5, b), (6, c), (6, None)]),
        ([(None, a), (None, a), (1, ""), (1, ""), (2, a), (2, c)], [(None, a), (None, a), (1, ""), (2, a), (2, c)]),
        ([(1, a), (2, near_a), (3, b)], [(1, a), (3, b)]),
    ]
    for rows, want in cases:
        table = docs(rows)
        out = corpus_pipeline.near_duplicates(spark, table, "")
        assert out.columns == table.columns and out.dtypes == table.dtypes
        assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == sorted(want, key=str)
    two = corpus_pipeline.near_duplicates(spark, docs([(5, a), (5, near_a), (6, b)]), "").select("doc_id").collect()
    assert sorted(r[0] for r in two) == [5, 6]


def test_names_hold_one_row_of_a_key(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TaskContext", type("Context", (), {
        "get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 3)}))}))

    def table(keys):
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(keys)), pa.int64()), pa.array(range(len(keys)), pa.int32()),
             *[pa.array([k[c] for k in keys], pa.int64()) for c in range(3)]], ["rid", "pos", "k0", "k1", "k2"])

    def got(batches):
        return [tuple(r.values()) for b in suffix_dedup._names(batches) for r in b.to_pylist()]

    r = random.Random(6)
    for trial in range(60):
        keys = sorted((r.randint(0, 1), r.randint(0, 2), r.randint(0, 3)) for _ in range(r.randint(1, 30)))
        order = sorted(set(keys))
        want = [(k, k, (3 << 33) + order.index(x)) for k, x in enumerate(keys) if keys.count(x) > 1]
        whole, batches, at = table(keys), [], 0
        while at < len(keys):
            n = r.randint(0, 4)
            batches.append(whole.slice(at, n))
            at += n
        assert got(batches) == want
    one, rows, waiting = table([(1, 2, 3)] * 4000), 0, []

    def pulled():
        for k in range(0, 4000, 10):
            waiting.append(k - rows)
            yield one.slice(k, 10)

    for out in suffix_dedup._names(pulled()):
        rows += out.num_rows
    assert rows == 4000 and max(waiting) <= 1
