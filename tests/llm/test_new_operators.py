"""SimHash near-dedup, periodic runs and the Merkle manifest against plain
readings of their contracts, and their edge cases."""

from __future__ import annotations

import random
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import CASES, VOCABULARY, edited, prose, rows

from squadron.llm import merkle, periodic_runs, queries, simhash


def near_prints(seed, n, flips):
    """Fingerprints around one, up to ``flips`` bits off, and some elsewhere."""
    r = random.Random(seed)
    centre = r.getrandbits(64)
    out = {centre}
    while len(out) < n:
        x = centre
        for _ in range(r.randint(1, flips)):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out | {r.getrandbits(64) for _ in range(20)})


def test_simhash(docs):
    got = simhash.near_duplicates(docs(CASES)).select("id", simhash.hexadecimal(F.col("fingerprint")), "component_id")
    assert rows(got) == brute.simhash(CASES)
    assert simhash.near_duplicates(docs([])).collect() == []


def test_simhash_of_null_ids_only(docs):
    got = simhash.near_duplicates(docs([(None, prose(30, 1)), (None, None), (None, prose(30, 1))]))
    assert [r.component_id for r in got.collect()] == [None] * 3


@pytest.mark.parametrize("crowd", [1, 4, 64])
def test_links_join_all_that_are_three_bits_apart(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    values = near_prints(3, 150, 8) + near_prints(4, 60, 3)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash._linked(spark.createDataFrame([(v,) for v in signed], "print bigint")).collect()
    full = lambda v: v & ((1 << 64) - 1)
    assert all((full(a) ^ full(b)).bit_count() <= 3 for a, b in links)
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if (full(a) ^ full(b)).bit_count() <= 3]
    assert brute.joined(signed, links) == brute.joined(signed, near)


def test_word_blocks_join_up_over_cuts():
    text = prose(500, 6).encode() + " \x0b\x1c x y\x00 é ".encode()
    from squadron.llm import textkit
    for limit in (1, 7, 100, 1 << 20):
        assert [w for b in textkit.word_blocks(text, limit=limit) for w in b] == text.split()
    whole = simhash.fingerprint(text)
    old = textkit.word_blocks.__defaults__
    try:
        textkit.word_blocks.__defaults__ = (False, 9)
        assert simhash.fingerprint(text) == whole
    finally:
        textkit.word_blocks.__defaults__ = old


def repeated(seed):
    """Words with runs of many periods, side by side, nested and cut short."""
    r = random.Random(seed)
    words = []
    for _ in range(r.randint(1, 8)):
        root = [r.choice(VOCABULARY[:r.choice([1, 2, 3, 200])]) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 17, 40, 64]))]
        words += root * r.randint(1, 9) + root[:r.randint(0, len(root))]
        words += [r.choice(VOCABULARY) for _ in range(r.randint(0, 12))]
    return words


RUN_CASES = CASES + [(200 + k, " ".join(repeated(k))) for k in range(60)] + [
    (300, "a " * 3000), (301, "a b " * 40 + "c " + "b a " * 40), (302, "\n".join(["x y z"] * 30)),
    (303, "q " * 23), (304, "q " * 24), (305, " ".join(map(str, range(500))) * 4), (None, "q " * 30)]


def test_runs(docs):
    got = periodic_runs.find_runs(docs(RUN_CASES)).select(
        "row.doc_id", "n_words", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])),
        "collapsed")
    want = []
    for i, text in RUN_CASES:
        words = brute.words(text)
        runs = brute.runs(words)
        want.append((i, len(words), [f"{a},{n},{q}" for a, n, q in runs], " ".join(brute.collapsed(words, runs))))
    assert rows(got) == sorted(want, key=str)
    assert sum(bool(w[2]) for w in want) > 40
    assert periodic_runs.find_runs(docs([])).collect() == []


def test_tiles_do_not_depend_on_the_texts_beside():
    """A text is settled or not whatever it is read with."""
    def tiles(texts):
        ids = [[dict.fromkeys(t) and list(dict.fromkeys(t)).index(w) for w in t] for t in texts]
        first = np.cumsum([0, *map(len, texts)])
        out = [set() for _ in texts]
        for block, _, _, at, text in periodic_runs.centres(np.array(sum(ids, []), dtype=np.int32), first):
            for c, k in zip(at.tolist(), text.tolist()):
                assert first[k] <= c and c + block <= first[k + 1]
                out[k].add((block, int(c - first[k])))
        return out

    texts = [repeated(1000 + k) for k in range(30)] + [[], ["a"] * 9]
    assert tiles(texts) == [tiles([t])[0] for t in texts]


def test_op12_query(spark, tmp_path):
    some = [(i, t) for i, t in RUN_CASES if i is not None] + [(k, prose(40 + k, k)) for k in range(400, 460)]
    spark.createDataFrame(some, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    want = []
    for i, text in some:
        words = brute.planted(i, brute.words(text))
        runs = brute.runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                     brute.sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)),
                     brute.sha(" ".join(brute.collapsed(words, runs)))))
    assert rows(got) == sorted(want, key=str)


def test_layout_is_a_numbering_that_keeps_subtrees_together():
    for rows_ in range(1, 9):
        all_ = [merkle.address(rows_, d, np.arange(3 ** d)) for d in range(rows_)]
        assert sorted(np.concatenate(all_).tolist()) == list(range(merkle.size(rows_)))
        assert all_[0][0] == 0
    top, bottom = 8 // 2, 8 - 8 // 2
    for tree in (0, 5, 3 ** top - 1):  # a bottom subtree stands in one stretch
        at = np.concatenate([merkle.address(8, top + d, tree * 3 ** d + np.arange(3 ** d)) for d in range(bottom)])
        assert sorted(at.tolist()) == list(range(at[0], at[0] + merkle.size(bottom)))


MERKLE = "text string, doc_id bigint, tree string, source string, lang string, n_chars bigint, place bigint, path string"


def manifest_rows(n, seed):
    r = random.Random(seed)
    out = [(r.choice([None, "", "a\nb", "é\n" * 5, prose(20, k)]), r.choice([k, k, k, None]), "t",
            r.choice(["hot", "hot", "hot", None, "", "b", "ä", "Z", "=x"]), r.choice([None, "en"]),
            r.choice([None, -7, 12]), 3, "p") for k in range(n)]
    return out + out[:3]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest(spark, levels):
    """Blocks of one level make many tiers; the proofs are the same."""
    data = manifest_rows(130, levels)
    df = spark.createDataFrame(data, MERKLE)
    got = (merkle.build(df, claimed={"text": F.translate("text", "\n", "")}, levels=levels).proofs()
           .withColumn("folded", merkle.fold(F.col("claimed"), F.col("path")))
           .select("id", "leaf", "claimed", "subroot", "root", merkle.proof_digest(F.col("path")), "folded"))
    plain = [(i, s, lang, n, t) for t, i, _, s, lang, n, _, _ in data]
    assert rows(got) == brute.manifest(plain)


def test_manifest_of_few_rows(spark):
    for data in ([], [("t", 1, "t", "s", None, 1, 1, "p")], [("t", 1, "t", None, None, 1, 1, "p")] * 2):
        got = merkle.build(spark.createDataFrame(data, MERKLE)).proofs().withColumn(
            "folded", merkle.fold(F.col("claimed"), F.col("path")))
        assert all(r.folded == r.root for r in got.collect()) and got.count() == len(data)


def test_different_long_words_are_not_linked(docs):
    """Thue-Morse words of a and b, and their complements, have equal polynomial hashes modulo 2^64."""
    from squadron.llm import near_dup
    turn = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    data = [(1, turn), (2, turn.translate(str.maketrans("ab", "ba"))), (3, turn), (4, "ab" * 32), (5, "ab" * 33)]
    assert rows(near_dup.near_duplicates(docs(data))) == brute.near(data)
