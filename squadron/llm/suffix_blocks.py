"""Content-defined blocks, the lossless filter before suffix sorting.

Every ``LENGTH``-byte window has an anchor: the smallest hash among its
``GRAM``-byte grams, the leftmost of equals.  The anchor depends on the window's
bytes alone, so equal windows have equal anchors at equal offsets.  A block is
a run of window starts with the same anchor; two equal windows lie in blocks
with the same anchor gram.  Blocks found twice as a whole are repeated
throughout; of the others only those whose anchor gram occurs in another block
can hold a repeated window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from squadron.llm import textkit as T

LENGTH = 200
GRAM = 48

_U = np.uint64
BLOCKS = "doc_id {id}, text_hash bigint, start int, n int, at int, anchor bigint, block bigint"


def range_hash(data: np.ndarray, salt: int) -> callable:
    """A function of (starts, stops) giving 64-bit hashes of byte ranges."""
    forward, back = T.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    value = T.mix(np.arange(256, dtype=np.uint64) + _U(salt))[data]
    np.cumsum(value * forward[:-1], out=total[1:])
    return lambda a, b: T.mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def anchors(data: np.ndarray, gram_hash, starts: np.ndarray) -> np.ndarray:
    """The anchor position of the window at each of the starts (all windows of
    the data are looked at; those that cross rows are not asked for)."""
    grams = len(data) - GRAM + 1
    at = np.arange(grams)
    bits = max(22, int(grams).bit_length())
    low = (gram_hash(at, at + GRAM) >> _U(bits) << _U(bits)) | at.astype(np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    found = np.minimum(low[starts], low[starts + width - have])
    return (found & _U((1 << bits) - 1)).astype(np.int64)


def row_starts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the rows, and their rows."""
    n = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + offsets[row], row


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each row (doc_id, text, text_hash); starts count from the row's first byte."""
    for part in T.pieces(batches, "text", 1 << 16):
        data, offsets = T.utf8(part.column("text"))
        start, row = row_starts(offsets)
        if not len(start):
            continue
        one = range_hash(data, 1)
        anchor = anchors(data, one, start)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(start)))
        a, r, p = start[first], row[first], anchor[first]
        end = a + n + LENGTH - 1
        small = lambda x: pa.array(x.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(r)), part.column("text_hash").take(pa.array(r)),
             small(a - offsets[r]), small(n), small(p - a), pa.array(one(p, p + GRAM).view(np.int64)),
             pa.array(range_hash(data, 0x51ED270B)(a, end).view(np.int64))],
            ["doc_id", "text_hash", "start", "n", "at", "anchor", "block"])
