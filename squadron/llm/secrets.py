"""Secret scans: fixed patterns, and character Markov models.

The fixed patterns find assignments, access keys and long hexadecimal runs.
Two first-order Markov models over the characters of keys are trained on the
whole corpus: one on the strings that the patterns labelled as secrets, one on
all other runs of key characters (ordinary words) and on identifiers spelt from
these words: joined in capitals, by capital letters, by separators, followed by
digits, and rules of one separator.  A transition that a model has seen too
rarely backs off to that of the two characters' classes (capitals, small
letters, digits, separators) and to any character, with fixed weights, so that
what is merely rare in this corpus is no secret.  Any run of
at least ``MIN_RUN`` key characters outside the patterns' spans is a secret
where the log-likelihood ratio a character exceeds ``MIN_RATIO``; where that of
the whole run does not, so are the parts of at least ``MIN_RUN`` characters
between separators (``+/_=-``) for which it does.  Nothing but the ratio decides.

The training counts are sums over all documents, aggregated by Spark; what the
driver holds is one count per model and pair of characters.

Defined results: null and empty texts have no secrets; without labelled
secrets the Markov models find nothing; an empty table gives an empty result;
repeated rows are scanned alike; other columns are kept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from squadron.llm import textkit as T
from squadron.llm.rows import annotate

MIN_RUN = 16
MIN_RATIO = 0.5
MIN_LABELLED = 20  # transitions of labelled secrets, below which nothing is learnt
#: Weights of a model's own transitions against its class transitions, and of any character at all.
OWN_ORDINARY, ANY_ORDINARY = 0.9, 0.01
OWN_SECRET, ANY_SECRET = 0.3, 0.5
#: Identifier words that a digit follows or precedes, and the share of two digits in a row.
DIGIT_SHARE, DIGITS_SHARE = 0.05, 0.1
KINDS = ("assign", "access", "hex", "markov")

# The base patterns, their words and least lengths, and the characters of keys.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.IGNORECASE)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")  # greedy from the left: whole runs of [0-9a-f]
_KEY = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
_SEPARATORS = _KEY.index(b"+")  # the codes from here on

_SIZE = len(_KEY)
_OUTSIDE = _SIZE  # the code of all other characters
_CODE = np.full(256, _OUTSIDE, dtype=np.int64)
_CODE[np.frombuffer(_KEY, dtype=np.uint8)] = np.arange(_SIZE)
_CAPITALS, _SMALL, _DIGITS = np.arange(26), np.arange(26, 52), np.arange(52, 62)
_MARKS = np.arange(_SEPARATORS, _SIZE)
#: Characters x classes.
_CLASS = np.eye(4)[np.repeat(np.arange(4), [len(c) for c in (_CAPITALS, _SMALL, _DIGITS, _MARKS)])]
_HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))

SPANS = "spans array<struct<start: bigint, kind: int, stop: bigint>>"


def base_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, stop, start of the secret itself) in bytes; kind is a place in KINDS."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"\x01" * 24 in text.translate(_HEX_CLASS):
        out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions (model, cell, n): model 1 is that of the labelled secrets.
    Model 0 also counts where runs of key characters begin and end."""
    for part in T.pieces(batches, "text"):
        data, offsets = T.utf8(part.column("text"))
        raw = data.tobytes()
        labelled = np.zeros(len(data) + 1, dtype=np.int64)
        for a, b in zip(offsets[:-1], offsets[1:]):
            for _, _, stop, own in base_spans(raw[a:b]):
                labelled[a + own] += 1
                labelled[a + stop] -= 1
        labelled = np.cumsum(labelled)[:-1] > 0
        code = _CODE[data]
        inside = code != _OUTSIDE
        joined = inside[:-1] | inside[1:]
        edge = offsets[1:-1] - 1
        joined[edge[(edge >= 0) & (edge < len(joined))]] = False
        cell = code[:-1] * (_SIZE + 1) + code[1:]
        both, neither = labelled[:-1] & labelled[1:], ~labelled[:-1] & ~labelled[1:]
        for model, mask in ((0, joined & neither), (1, joined & both)):
            n = np.bincount(cell[mask], minlength=(_SIZE + 1) ** 2)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), model, dtype=np.int32)), pa.array(used.astype(np.int32)),
                 pa.array(n[used].astype(np.int64))], ["model", "cell", "n"])


def spelt(seen: np.ndarray) -> np.ndarray:
    """Transitions of identifiers made of the words in ``seen`` (transitions
    with the outside last): small letters stand for words in snake, camel and
    lower case, so they count three times; what may follow a word counts alike."""
    inner = sum(seen[np.ix_(a, b)] for a in (_CAPITALS, _SMALL) for b in (_CAPITALS, _SMALL))
    first = seen[_OUTSIDE, _CAPITALS] + seen[_OUTSIDE, _SMALL]
    last = seen[_CAPITALS, _OUTSIDE] + seen[_SMALL, _OUTSIDE]
    words, marks, digits = first.sum(), len(_MARKS), len(_DIGITS)
    out = np.zeros((_SIZE, _SIZE))
    out[np.ix_(_SMALL, _SMALL)] = 3 * inner
    out[np.ix_(_CAPITALS, _CAPITALS)] = inner
    out[np.ix_(_CAPITALS, _SMALL)] = first[:, None] * inner / np.maximum(inner.sum(axis=1, keepdims=True), 1)
    out[np.ix_(_SMALL, _CAPITALS)] = np.outer(last, first / max(words, 1))
    for letters in (_CAPITALS, _SMALL):
        out[np.ix_(letters, _MARKS)] = last[:, None] / marks
        out[np.ix_(_MARKS, letters)] = first / marks
        out[np.ix_(letters, _DIGITS)] = last[:, None] * DIGIT_SHARE / digits
        out[np.ix_(_DIGITS, letters)] = first * DIGIT_SHARE / digits
    out[_MARKS, _MARKS] = 2 * words / marks  # rules: a separator repeated
    out[np.ix_(_DIGITS, _MARKS)] = words * DIGIT_SHARE / (digits * marks)
    out[np.ix_(_MARKS, _DIGITS)] = words * DIGIT_SHARE / (digits * marks)
    out[np.ix_(_DIGITS, _DIGITS)] = words * DIGITS_SHARE / digits ** 2
    return out


def chances(count: np.ndarray, own: float, any_: float) -> np.ndarray:
    """Transition probabilities: a row's own counts (weight ``own``), backed off
    to its class's transitions, equal within a class, and to any character
    (weight ``any_`` of the whole); a row without counts has no part of its own."""
    total = count.sum(axis=1, keepdims=True)
    between = _CLASS.T @ count @ _CLASS + 1e-9
    by_class = _CLASS @ (between / between.sum(axis=1, keepdims=True)) @ (_CLASS / _CLASS.sum(axis=0)).T
    mixed = np.where(total > 0, own * count / np.maximum(total, 1e-9) + (1 - own) * by_class, by_class)
    return (1 - any_) * mixed + any_ / _SIZE


def log_ratio(count: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio of every transition from the counts of both models."""
    ordinary, secret = count[0], count[1, :_SIZE, :_SIZE]
    return (np.log(chances(secret, OWN_SECRET, ANY_SECRET))
            - np.log(chances(ordinary[:_SIZE, :_SIZE] + spelt(ordinary), OWN_ORDINARY, ANY_ORDINARY)))


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray | None:
    """The log-likelihood ratio of every transition, from all documents; None
    where too little is labelled."""
    rows = (docs.select(F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_counts, "model int, cell int, n bigint")
            .groupBy("model", "cell").agg(F.sum("n").alias("n")).collect())  # 2 x 68 x 68 rows at most
    count = np.zeros((2, (_SIZE + 1) ** 2))
    for r in rows:
        count[r["model"], r["cell"]] += r["n"]
    count = count.reshape(2, _SIZE + 1, _SIZE + 1)
    return log_ratio(count) if count[1, :_SIZE, :_SIZE].sum() >= MIN_LABELLED else None


def _likely(text: bytes, start: int, stop: int, ratio: np.ndarray) -> list[tuple[int, int]]:
    """The secrets in key characters text[start:stop]: all of them, where their
    mean ratio exceeds MIN_RATIO, or else the parts between separators (in one
    or several pieces) that together exceed it most."""
    n = stop - start
    if n < MIN_RUN:
        return []
    code = _CODE[np.frombuffer(text, dtype=np.uint8, count=n, offset=start)]
    excess = np.zeros(n)  # up to each character, over MIN_RATIO a transition
    np.cumsum(ratio[code[:-1], code[1:]] - MIN_RATIO, out=excess[1:])
    if excess[-1] > 0:
        return [(start, stop)]
    marks = np.flatnonzero(code >= _SEPARATORS)
    if not len(marks):
        return []
    border = np.unique(np.concatenate(([0], marks, marks + 1, [n])))
    opened = excess[np.minimum(border, n - 1)].tolist()
    closed = excess[np.maximum(border - 1, 0)].tolist()
    border = border.tolist()
    # best[j]: most excess of separate parts up to border j; a part from i to j has closed[j] - opened[i].
    best, begun = [0.0] * len(border), [-1] * len(border)
    near, first, top = 0, -1, -np.inf
    for j in range(1, len(border)):
        while border[near] + MIN_RUN <= border[j]:
            if best[near] - opened[near] > top:
                first, top = near, best[near] - opened[near]
            near += 1
        best[j] = best[j - 1]
        if top + closed[j] > best[j]:
            best[j], begun[j] = top + closed[j], first
    out, j = [], len(border) - 1
    while j > 0:
        if begun[j] >= 0:
            out.append((start + border[begun[j]], start + border[j]))
            j = begun[j]
        else:
            j -= 1
    return out


def find(text: bytes, ratio: np.ndarray | None) -> list[tuple[int, int, int]]:
    """(start, kind, stop) in bytes: the base spans, and the Markov spans outside them."""
    spans = [(a, kind, b) for a, kind, b, _ in base_spans(text)]
    if ratio is None:
        return spans
    starts = [a for a, _, _ in spans]
    reach = np.maximum.accumulate([b for _, _, b in spans]) if spans else ()
    more = []
    for m in _RUN.finditer(text):
        k, a = bisect_right(starts, m.start()), m.start()
        if k:
            a = max(a, int(reach[k - 1]))
        while k < len(spans) and starts[k] < m.end():
            more += [(x, 3, y) for x, y in _likely(text, a, starts[k], ratio)]
            a = max(a, int(reach[k]))
            k += 1
        more += [(x, 3, y) for x, y in _likely(text, a, m.end(), ratio)]
    return sorted(spans + more)


def scan(docs: DataFrame, ratio: np.ndarray | None, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (the input row) and spans (code points, stop exclusive,
    kind as a place in KINDS), by start, then kind."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def work():
        held = sent.value

        def judge(column: pa.Array) -> list[pa.Array]:
            data, offsets = T.utf8(column)
            raw, out = data.tobytes(), []
            for a, b in zip(offsets[:-1], offsets[1:]):
                found = find(raw[a:b], held)
                if found:
                    point = np.concatenate(([0], np.cumsum((data[a:b] & 0xC0) != 0x80)))
                    found = [{"start": int(point[s]), "kind": k, "stop": int(point[e])} for s, k, e in found]
                out.append(found)
            return [pa.array(out, pa.list_(pa.struct(
                [("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])))]

        return judge

    return annotate(docs, text_col, SPANS, work)


def listed(spans):
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
