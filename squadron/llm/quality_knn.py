"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes hashed byte-trigram weights (log counts times the sample's
inverse document frequency) beside a few shape terms (shares of repeated words,
symbols, capitals, ... on a log scale).  The labelled sample's term matrix is
reduced to ``LATENT`` directions; the labelled vectors are broadcast (at most
``SAMPLE`` x ``LATENT`` floats).  Every document's vector is compared with all
of them by blocked cosine products, and the ``NEIGHBOURS`` most similar vote,
weighted by similarity and by how many labelled rows a sampled row stands for.
Similarities are compared to ``PLACES`` decimals; where more are equal than
may vote, those with the smallest ids (as text) do.  Vectors are rounded, too,
and products are made in double precision, so a score does not depend on the
texts that a task happens to compare at once.

The only bounded step is the labelled sample: ``SAMPLE`` rows at most, half of
each label where there are enough, chosen by a hash of the id.

Defined results: a null text is scored as an empty one; without labelled rows
every score is 0.5; with one label only, the score is that label; null labels
and labelled ids without a document teach nothing; a labelled id with several
texts teaches the smallest of them (null first); repeated rows score alike; a
null id is not held out; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from squadron.llm import textkit as T
from squadron.llm.rows import annotate

SAMPLE = 4000
LATENT = 48
NEIGHBOURS = 25
PLACES = 5
SHARPNESS = 4.0
THRESHOLD = 0.3
BINS = 1024
BLOCK = 512
STEPS = 8  # cells of each shape term's log scale
SHAPE_WEIGHT = 1.0

_U = np.uint64


def _shares(words: T.Words) -> np.ndarray:
    """Shape of each row: rows x terms, shares in 0..1 (the last two: logs)."""
    data, offsets = words.data, words.offsets
    n, size = len(offsets) - 1, np.maximum(1, np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return np.diff(total[offsets]) / size

    count = np.maximum(1, np.diff(words.first))
    h = words.hashes()
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (words.row[1:] == words.row[:-1])
    order = np.lexsort((h, words.row))
    seen = np.zeros(len(h), dtype=bool)
    seen[1:] = (h[order][1:] == h[order][:-1]) & (words.row[order][1:] == words.row[order][:-1])
    per = lambda mask: np.bincount(words.row[mask], minlength=n) / count
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    space = np.isin(data, np.array(T.SPACE_BYTES, dtype=np.uint8))
    length = words.stop - words.start
    return np.stack([
        share(upper), share(digit), share(~letter & ~digit & ~space), share(data == 10),
        share(np.isin(data, np.frombuffer(b"#*$%&|<>!", dtype=np.uint8))),
        per(again), per(seen[np.argsort(order)] if len(order) else seen), per(length == 1), per(length > 14),
        np.log2(1 + np.diff(words.first)) / 16, np.bincount(words.row, length, n) / count / 32,
    ], axis=1)


def features(column: pa.Array) -> np.ndarray:
    """Raw term weights of each text: rows x (BINS + shape cells), float32."""
    words = T.Words(column)
    data, offsets = words.data, words.offsets
    n = len(offsets) - 1
    counts = np.zeros((n, BINS), dtype=np.float32)
    if len(data) > 2:
        row = np.repeat(np.arange(n), np.diff(offsets))
        code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        cell = ((code.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
        whole = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][whole] * BINS + cell[whole], minlength=n * BINS
                             ).reshape(n, BINS).astype(np.float32)
    shares = _shares(words)
    logs = np.clip(np.log2(np.maximum(shares, 1 / 512)) + 9, 0, 9) / 9  # 1/512 and less: 0, all: 1
    logs[:, -2:] = np.clip(shares[:, -2:], 0, 1)
    # Each share falls between two cells, so near shares have near vectors.
    spot = logs * (STEPS - 1)
    low = np.minimum(spot.astype(np.int64), STEPS - 2)
    cells = np.zeros((n, shares.shape[1], STEPS), dtype=np.float32)
    i, j = np.indices(low.shape)
    cells[i, j, low] = 1 - (spot - low)
    cells[i, j, low + 1] = spot - low
    return np.concatenate((np.log1p(counts), cells.reshape(n, -1)), axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, ascending; the first among equals."""
    least = np.partition(near, near.shape[1] - k, axis=1)[:, [-k]]
    above, equal = near > least, near == least
    left = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | equal & (np.cumsum(equal, axis=1) <= left))[1].reshape(len(near), k)


@dataclass
class Model:
    """Term weights, projection, and the labelled latent vectors by id."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, raw: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
        held = (raw[:, :BINS] > 0).sum(axis=0)
        idf = np.log((1 + len(raw)) / (1 + held)).astype(np.float32) + 1
        model = cls(idf, np.zeros((raw.shape[1], 0), np.float32), raw[:, :0], labels, weights)
        terms = model._terms(raw)
        value, vector = np.linalg.eigh(terms.T.astype(np.float64) @ terms)
        model.basis = vector[:, np.argsort(-value)[:LATENT]].astype(np.float32)
        model.vectors = model.latent(raw)
        return model

    def _terms(self, raw: np.ndarray) -> np.ndarray:
        raw = raw.astype(np.float64)
        return np.concatenate((_unit(raw[:, :BINS] * self.idf), _unit(raw[:, BINS:]) * SHAPE_WEIGHT), axis=1)

    def latent(self, raw: np.ndarray) -> np.ndarray:
        return np.round(_unit(self._terms(raw) @ self.basis), PLACES + 1)

    def score(self, raw: np.ndarray) -> np.ndarray:
        out = np.full(len(raw), 0.5)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for a in range(0, len(raw), BLOCK):
            near = np.round(self.latent(raw[a:a + BLOCK]) @ self.vectors.T, PLACES)
            top = nearest(near, k)
            vote = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6) ** SHARPNESS
            vote *= self.weights[top]
            out[a:a + BLOCK] = (vote * self.labels[top]).sum(axis=1) / vote.sum(axis=1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The model from at most ``sample`` labelled rows whose crc32(id) mod 5 is not 0."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .filter("id is not null and label in (0, 1)").filter(~held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    order = F.xxhash64("id")
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {y: min(n, max(sample // 2, sample - sum(m for z, m in total.items() if z != y)))
             for y, n in total.items()}
    # orderBy + limit keeps `sample` rows a task, so no task holds a whole label.
    parts = [known.filter(F.col("label") == y).orderBy(order, "id").limit(share[y]) for y in sorted(total)]
    if not parts:
        return None
    chosen = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def raw(batches):
        for part in T.pieces(batches, "text"):
            x = features(part.column("text"))
            kind = pa.list_(pa.float32())
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.ListArray.from_arrays(ends, pa.array(x.ravel())).cast(kind)],
                ["id", "label", "x"])

    # chosen is bounded by `sample`, hence the broadcast; so are the rows collected.
    rows = (text.join(F.broadcast(chosen), "id").groupBy(F.col("id").cast("string").alias("id"), "label")
            .agg(F.min("text").alias("text"), F.bool_or(F.col("text").isNull()).alias("none"))
            .select("id", "label", F.when(~F.col("none"), F.col("text")).alias("text"))
            .mapInArrow(raw, "id string, label int, x array<float>").toArrow().sort_by("id"))
    if not rows.num_rows:
        return None
    x = np.stack([np.asarray(v.values) for v in rows.column("x")]).astype(np.float32)
    y = rows.column("label").to_numpy().astype(np.float64)
    weight = np.array([total[int(v)] / max(1, (y == v).sum()) for v in y])
    return Model.fit(x, y, weight)


def held_out(id_col: str):
    """Rows that teach nothing: crc32 of the id's text modulo 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (the input row), score and predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        held = sent.value
        return lambda column: [pa.array(held.score(features(column)) if held is not None
                                        else np.full(len(column), 0.5), pa.float64())]

    return annotate(docs, text_col, "score double", work).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
