"""Vectorised text helpers used inside Arrow tasks.

``pieces`` cuts Arrow batches into slices of bounded text, so a task's memory
does not depend on how many rows a batch holds; ``Words`` finds the words of
every row of a slice with whole-array numpy operations and hashes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)
                          .to_numpy(zero_copy_only=False), dtype=np.int64)
        before = np.cumsum(size) - size
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(before, before[start] + limit)))
            yield batch.slice(start, stop - start)
            start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column (null: empty) and the row offsets in them."""
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2^64, and of its inverse."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for base, name in ((int(_BASE), "_powers"), (pow(int(_BASE), -1, 1 << 64), "_inverse")):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            globals()[name] = np.multiply.accumulate(p)
    return _powers[:n], _inverse[:n]


def table(separators, lower: bool = True) -> np.ndarray:
    """Byte table: separators become 0, A-Z are lower-cased where asked."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    t[list(separators)] = 0
    t[0] = 0 if 0 in separators else 1  # a NUL that is part of a word must not look like a gap
    return t


# The white space of the contracts (space, and tab to carriage return).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE_TABLE = table(SPACE_BYTES)


_BLANK = bytes.maketrans(bytes(SPACE_BYTES), b" " * len(SPACE_BYTES))
_BLANK_LOWER = bytes.maketrans(bytes(SPACE_BYTES) + bytes(range(65, 91)), b" " * len(SPACE_BYTES) + bytes(range(97, 123)))


def word_blocks(raw: bytes, lower: bool = False, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The white-space separated words of a text, in lists of about ``limit``
    bytes, so the objects in memory do not grow with the text."""
    text = raw.translate(_BLANK_LOWER if lower else _BLANK)
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + limit) if at + limit < len(text) else -1
        cut = cut if cut >= 0 else len(text)
        yield text[at:cut].split()
        at = cut


#: Longer words are hashed one by one.
_LONG = 64


class Words:
    """Words of a slice: ``start``, ``stop`` (byte positions in ``data``),
    ``row`` (row of each word), ``first`` (first word of each row, and the end)."""

    def __init__(self, column: pa.Array, byte_table: np.ndarray = SPACE_TABLE):
        self.data, self.offsets = utf8(column)
        self.norm = byte_table[self.data]
        n = len(self.data)
        inside = self.norm != 0
        edge = np.zeros(n + 1, dtype=bool)  # a word ends before position i, whatever stands there
        edge[self.offsets] = True
        before = np.concatenate(([False], inside[:-1])) if n else inside
        after = np.concatenate((inside[1:], [False])) if n else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's normalised bytes: eight bytes at a time
        are mixed in, for all words together; of long words xxHash is taken."""
        size = self.stop - self.start
        out = mix(size.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(1))
        padded = np.concatenate((self.norm, np.zeros(8, dtype=np.uint8)))
        eights = np.ndarray(len(self.norm) + 1, dtype="<u8", buffer=padded, strides=(1,))
        longest = min(int(size.max(initial=0)), _LONG)
        for k in range(0, longest, 8):
            live = np.flatnonzero((size > k) & (size <= _LONG))
            left = np.minimum(8, size[live] - k).astype(np.uint64)
            piece = eights[self.start[live] + k] & (~_U(0) >> (_U(64) - _U(8) * left))
            out[live] = mix(out[live] * _U(0xA0761D6478BD642F) + piece)
        for i in np.flatnonzero(size > _LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.norm[self.start[i]:self.stop[i]].tobytes())
        return out


def combine(columns: list[np.ndarray], seed: int) -> np.ndarray:
    """An order-dependent 64-bit hash of several hash arrays."""
    out = np.full(len(columns[0]), seed, dtype=np.uint64)
    for c in columns:
        out = mix(out * _U(0xA0761D6478BD642F) + c)
    return out


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of every row, sorted within the
    row, and their rows.  A row with fewer words has its whole sequence as one
    shingle; a row without words has none."""
    h = words.hashes()
    count = np.diff(words.first)
    at = np.arange(max(0, len(h) - width + 1))
    at = at[words.row[at] == words.row[at + width - 1]] if len(at) else at
    if len(at):
        value, row = combine([h[at + k] for k in range(width)], width), words.row[at].copy()
    else:
        value, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.array([combine([h[i:i + 1] for i in range(words.first[r], words.first[r + 1])],
                                  int(count[r]))[0] for r in short], dtype=np.uint64)
        value, row = np.concatenate((value, whole)), np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    bounds = np.searchsorted(row, np.arange(len(count) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        value[a:b].sort()
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]
