"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is cut into marked words (a space is the mark, which starts a word, as
no piece holds a mark after another character).  The distinct words of a slice
are sorted, which is the depth-first order of their trie: going from one word
to the next, the forward column (best score and last piece of every prefix) is
kept up to their common prefix and only the rest is computed.  A worker keeps
the ids of some words of its earlier slices.

For a unigram model the forward score is the best sum of piece scores.  For a
BPE model a prefix has one segmentation, the one that merging gives: it is the
only path on which every two neighbouring pieces, merged on their own, stay
these two pieces.  So the forward pass allows a piece after another only then,
and its result equals merging by rank.  A piece that is no result of merging
is allowed nowhere.  Characters outside the vocabulary become byte pieces.

Defined results: a null or empty text has no pieces and decodes to an empty
text; a literal mark (U+2581) reads as a space, as in the format itself, so
such a text does not come back unchanged; repeated rows are coded alike; other
columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as S

from squadron.llm import textkit as T
from squadron.llm.rows import annotate

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text whose distinct words are coded together.
GROUP_BYTES = 24 << 20
#: Words (seen twice in a slice) whose ids a worker keeps, about 20 MB.
KNOWN_WORDS = 60_000
_UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """Pieces of a model file, read on the driver and sent to the tasks."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: dict[int, int] = field(default_factory=dict)
    ends: dict[str, tuple[int, ...]] = field(default_factory=dict)
    keep: int = KNOWN_WORDS
    known: dict[str, list[int]] = field(default_factory=dict)
    _joins: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only models with the identity normaliser and a dummy prefix are supported")
        return cls.build([p.piece for p in proto.pieces], [p.score for p in proto.pieces],
                         [p.type for p in proto.pieces], proto.trainer_spec.model_type == 1)

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], kinds: list[int], unigram: bool) -> Vocabulary:
        v = cls(pieces, scores, kinds, unigram)
        v.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k in (1, 4)}
        v.bytes_ = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        lengths: dict[str, set[int]] = {}
        for p in v.ids:
            if len(p) > 2:
                lengths.setdefault(p[-3:], set()).add(len(p))
        # Lengths of the pieces that may end where a string ends with these three characters.
        v.ends = {e: (*sorted(n, reverse=True), 2, 1) for e, n in lengths.items()}
        if any(MARK in p.lstrip(MARK) for p in v.ids):
            raise ValueError("a piece has a mark after another character: words are not independent")
        return v

    def merged(self, text: str) -> list[str]:
        """A short string by merging: the best neighbouring pair first, the
        leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, before: int | None, piece: int) -> bool:
        """Merging the strings of ``before`` and ``piece`` on their own gives
        just these two.  None: nothing before; -1 - c: a character c that is
        no piece."""
        if len(self._joins) > 2_000_000:
            self._joins.clear()
        parts = [] if before is None else [chr(-1 - before) if before < 0 else self.pieces[before]]
        parts.append(self.pieces[piece])
        known = self._joins[before, piece] = self.merged("".join(parts)) == parts
        return known

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes_[b] for b in char.encode()] if len(self.bytes_) == 256 else [self.kinds.index(2)]


def encode_words(vocabulary: Vocabulary, words: list[str]) -> list[list[int]]:
    """Ids of each of the distinct words, which are in code point order."""
    forward = _best_scores if vocabulary.unigram else _only_paths
    # The forward columns: of the path to each prefix, the last piece, its start and (unigram) the score.
    last: list[int | None] = [None]
    begin, best = [0], [0.0]
    out, before = [], ""
    for word in words:
        same, size = 0, len(word)
        for x, y in zip(word, before):
            if x != y:
                break
            same += 1
        del last[same + 1:], begin[same + 1:], best[same + 1:]
        forward(vocabulary, word, same + 1, last, begin, best)
        path, end = [], size
        while end:
            path.append(last[end])
            end = begin[end]
        path.reverse()
        if min(path) < 0:
            path = [k for p in path for k in ([p] if p >= 0 else vocabulary.fallback(chr(-1 - p)))]
        out.append(path)
        before = word
    return out


def _only_paths(vocabulary: Vocabulary, word: str, first: int, last: list, begin: list, best: list) -> None:
    """The forward columns of the prefixes from ``first`` characters on, by merging."""
    find, ends, joins, stays = vocabulary.ids.get, vocabulary.ends.get, vocabulary._joins.get, vocabulary.stays
    for end in range(first, len(word) + 1):
        for length in ends(word[end - 3:end], (2, 1)) if end > 2 else (2, 1)[2 - end:]:
            start = end - length
            if start < 0:
                continue
            piece = find(word[start:end])
            if piece is None:
                if length == 1:
                    piece = -1 - ord(word[start])
                    break
                continue
            pair = last[start], piece
            ok = joins(pair)
            if stays(*pair) if ok is None else ok:
                break
        last.append(piece)
        begin.append(start)


def _best_scores(vocabulary: Vocabulary, word: str, first: int, last: list, begin: list, best: list) -> None:
    """The same by the largest sum of scores."""
    find, ends, scores = vocabulary.ids.get, vocabulary.ends.get, vocabulary.scores
    floor = min(scores, default=0.0) - _UNKNOWN_PENALTY
    for end in range(first, len(word) + 1):
        top, took, place = -np.inf, None, end - 1
        for length in ends(word[end - 3:end], (2, 1)) if end > 2 else (2, 1)[2 - end:]:
            start = end - length
            if start < 0:
                continue
            piece = find(word[start:end])
            if piece is None and length > 1:
                continue
            reach = best[start] + (floor if piece is None else scores[piece])
            if reach > top:
                top, took, place = reach, -1 - ord(word[start]) if piece is None else piece, start
        last.append(took)
        begin.append(place)
        best.append(top)


def _marked(text: str) -> list[str]:
    """The marked words of a text: marks, then characters that are none."""
    line = MARK + text.replace(" ", MARK)
    parts = line.split(MARK)[1:]
    out, marks = [], 0
    for part in parts:
        marks += 1
        if part:
            out.append(MARK * marks + part)
            marks = 0
    return [*out, MARK * marks] if marks else out


def encode_slice(vocabulary: Vocabulary, column: pa.Array) -> pa.Array:
    """The id lists of a slice of texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    odd = pc.or_(pc.match_substring_regex(column, f"  |{MARK}|^ | $"), pc.equal(column, ""))
    rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    split = pc.split_pattern(pc.if_else(odd, "", column), " ")  # an odd row is one empty word for now
    coded = split.flatten().dictionary_encode()
    plain = [MARK + w for w in coded.dictionary.to_pylist()]
    count = np.diff(split.offsets.to_numpy())
    code = coded.indices.to_numpy().astype(np.int64)
    if len(rows):
        index = {w: i for i, w in enumerate(plain)}
        own = {int(r): [index.setdefault(w, len(index)) for w in _marked(t)] if (t := column[int(r)].as_py()) else []
               for r in rows}
        first = np.concatenate(([0], np.cumsum(count)))
        parts, at = [], 0
        for r in sorted(own):
            parts += [code[at:first[r]], np.array(own[r], dtype=np.int64)]
            at = first[r + 1]
            count[r] = len(own[r])
        code = np.concatenate([*parts, code[at:]])
        plain = list(index)
    lists: list[list[int]] = [[]] * len(plain)
    used = np.bincount(code, minlength=len(plain))
    known, new = vocabulary.known, []
    for i in np.flatnonzero(used).tolist():
        held = known.get(plain[i])
        if held is None:
            new.append(i)
        else:
            lists[i] = held
    new.sort(key=plain.__getitem__)
    for i, coded_word in zip(new, encode_words(vocabulary, [plain[i] for i in new])):
        lists[i] = coded_word
        if used[i] > 1 and len(known) < vocabulary.keep and len(plain[i]) <= 32:
            known[plain[i]] = coded_word
    size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = pa.array(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(size.sum())))
    ends = pa.array(np.concatenate(([0], np.cumsum(size))))
    coded_words = pa.LargeListArray.from_arrays(ends, flat).take(pa.array(code))
    word = np.concatenate(([0], np.cumsum(count)))
    return pa.LargeListArray.from_arrays(pa.array(coded_words.offsets.to_numpy()[word]), coded_words.values)


def decode_slice(vocabulary: Vocabulary, column: pa.Array) -> pa.Array:
    """The texts of id lists; ids that are no pieces of text (control, unknown
    or out of range) give nothing, invalid bytes the replacement character."""
    n = len(column)
    parts = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(MARK, " ").encode() if k in (1, 4) else b""
             for p, k in zip(vocabulary.pieces, vocabulary.kinds)]
    column = column.cast(pa.large_list(pa.int32()))
    ids = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False)
    ids = np.where((ids >= 0) & (ids < len(parts)), ids, len(parts))
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(count)))
    strings = pa.array([*parts, b""], pa.large_binary()).take(pa.array(ids))
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int64)
    raw = memoryview(strings.buffers()[2] or b"")
    out = []
    for r in range(n):
        text = str(raw[ends[first[r]]:ends[first[r + 1]]], "utf-8", "replace")
        out.append(text[1:] if text.startswith(" ") else text)
    return pa.array(out, pa.string())


def encode(docs: DataFrame, path: str = MODEL, text_col: str = "text", back: bool = False,
           group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Columns ``row`` (the input row) and ids; with ``back`` also decoded, the
    text that the ids give, made in the same pass.  Smaller groups take less
    memory (about 15 bytes a byte) and more time."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def work():
        vocabulary = sent.value

        def code(column: pa.Array) -> list[pa.Array]:
            ids = encode_slice(vocabulary, column).cast(pa.list_(pa.int32()))
            return [ids, decode_slice(vocabulary, ids)] if back else [ids]

        return code

    return annotate(docs, text_col, "ids array<int>" + ", decoded string" * back, work, group_bytes)


def decode(coded: DataFrame, path: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """The input columns and ``decoded``, the text of the ids."""
    sent = coded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    at, schema = coded.columns.index(ids_col), coded.schema

    def run(batches):
        vocabulary = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, decode_slice(vocabulary, part.column(at))], [*part.schema.names, "decoded"])

    return coded.mapInArrow(run, S.StructType([*schema, S.StructField("decoded", S.StringType())]))


def digests(coded: DataFrame) -> DataFrame:
    """Of encoded and decoded rows: doc_id, n_pieces, ids_sha256 (of the ids in
    decimal, comma-joined), round_trip (the decoded text is the text)."""
    return coded.select(
        "row.doc_id", F.size("ids").cast("bigint").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("round_trip"))
