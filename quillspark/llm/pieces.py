"""SentencePiece encoding and decoding: batched Viterbi over words of equal length.

Words of one length advance together as rows of a matrix. At each end position the hashes of the
substrings that end there probe a hash table of all pieces; a vectorised maximum over the scores
of the paths picks each word's best last piece, and its beginning is stored as a backpointer.

The vocabulary given here is of the BPE kind: its encoding is what merging the best-scored pair first
gives. That encoding is the only path in which each piece and each pair of neighbours encodes to
itself (see ``merge_order``), so the maximum is taken over the steps whose piece may stand after the
last piece of the path that it continues; other steps have a score of minus infinity. Vocabularies of
the unigram kind have no such condition.

No piece has a blank after another character, so blanks before a word start an independent segment.
Segments' ids are remembered in a bounded table. The cost of a word is in proportion to its length.

Defined results: null and empty texts have no ids and decode to an empty text; every text survives a
round trip, as unknown characters become byte pieces (only the blank sign U+2581 itself, which the
model writes for a space, comes back as a space); equal rows give equal results; an empty table gives
no rows; input columns with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowkit import append, mix
from .merge_order import ABSENT, MergeOrder, Table

BLANK = "▁"
_REMEMBERED = 200_000
_SHORT = 64
_CHAR = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 200_000  # characters that advance together


class PieceCoder:
    """Encoder and decoder of a SentencePiece model file."""

    def __init__(self, path: str):
        import re

        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unknown = model.unk_id()
        names = [model.id_to_piece(i) for i in range(n)]
        self.byte_id = [0] * 256
        self.surface: list[bytes] = [b""] * n
        normal = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.surface[i] = bytes([int(name[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                normal.append(i)
                self.surface[i] = name.replace(BLANK, " ").encode()
        self.index = {names[i]: i for i in normal}
        self.score = np.array([model.get_score(i) for i in range(n)])
        keys = np.array([self._key(names[i]) for i in normal], np.uint64)
        self.pieces = Table(keys, np.array(normal))  # raises where two pieces have the same hash
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece, and this tells nearly all of them
        self.maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.longest = max(len(names[i]) for i in normal)
        self.segments = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.known: dict[str, bytes] = {}
        self._number([names[i] for i in normal], np.array(normal))

    def _number(self, names: list[str], ids: np.ndarray) -> None:
        """Numbers of pieces in the order of their merges: 0 unknown characters, then single characters, then the rest by score.

        Each longer piece is merged once by itself, to learn its last merge; those that merging does
        not reach are never the outcome of an encoding and have no number.
        """
        by_length: dict[int, list[int]] = {}
        for k, name in enumerate(names):
            by_length.setdefault(len(name), []).append(k)
        middle = np.full(len(names), -1)
        for length, group in by_length.items():
            for begin in range(0, len(group) if length > 1 else 0, max(1, _ROWS // length)):
                own = np.array(group[begin : begin + max(1, _ROWS // length)])
                codes = np.frombuffer("".join(names[k] for k in own).encode("utf-32-le"), "<u4").reshape(len(own), length)
                middle[own] = self._derive(codes)
        single = by_length.get(1, [])
        reached = np.flatnonzero(middle > 0)
        rank = reached[np.argsort(-self.score[ids[reached]], kind="stable")]
        self.number = np.full(len(self.score), -1, np.int64)  # by id
        self.number[ids[single]] = np.arange(1, 1 + len(single))
        self.number[ids[rank]] = np.arange(len(rank)) + 1 + len(single)
        size = 1 + len(single) + len(rank)
        self.id_of = np.zeros(size, np.int64)
        numbered = np.flatnonzero(self.number > 0)
        self.id_of[self.number[numbered]] = numbered
        left, right = np.arange(size), np.arange(size)
        for k in rank.tolist():
            x, y = (self.index[part] for part in (names[k][: middle[k]], names[k][middle[k] :]))
            left[self.number[ids[k]]], right[self.number[ids[k]]] = self.number[x], self.number[y]
        made = np.arange(1 + len(single), size)
        time = np.zeros(size, np.int64)
        time[made] = np.unique(-self.score[ids[rank]], return_inverse=True)[1] + 1
        self.order = MergeOrder(left, right, Table(left[made].astype(np.uint64) << np.uint64(32) | right[made].astype(np.uint64), made), time)
        self.worth = np.append(self.score, self.score.min() - 10)  # the last: unknown characters

    @staticmethod
    def _fold(codes: np.ndarray) -> np.ndarray:
        """Hash terms of code points."""
        return mix(codes.astype(np.uint64) + np.uint64(1))

    def _key(self, piece: str) -> int:
        h = 0
        for t in PieceCoder._fold(np.array([ord(c) for c in piece])).tolist():
            h = (h * int(_CHAR) + t) & (1 << 64) - 1
        return h

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of pieces by the hashes of their strings; -1 where there is none."""
        out = np.full(len(keys), -1)
        at = np.flatnonzero(self.maybe[(keys >> np.uint64(44)).astype(np.int64)])
        found = self.pieces.get(keys[at])
        out[at] = np.where(found == ABSENT, -1, found)
        return out

    def _prefix(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix hashes (words x length + 1) and powers, so that any substring's hash is two products away."""
        words, length = codes.shape
        terms = self._fold(codes)
        prefix = np.zeros((words, length + 1), np.uint64)
        for j in range(length):
            prefix[:, j + 1] = prefix[:, j] * _CHAR + terms[:, j]
        powers = np.ones(length + 1, np.uint64)
        powers[1:] = np.multiply.accumulate(np.full(length, _CHAR))
        return prefix, powers

    def _derive(self, codes: np.ndarray) -> np.ndarray:
        """Where the last merge of each word parts it, by plain merging of the best pair; -1 for words that don't become one symbol."""
        words, length = codes.shape
        prefix, powers = self._prefix(codes)
        after = np.tile(np.arange(1, length + 2), (words, 1))  # where the symbol that starts here ends
        before = np.tile(np.arange(-1, length), (words, 1))
        last = np.full(words, -1)

        def value(r: np.ndarray, a: np.ndarray) -> np.ndarray:
            """The score of merging the symbol at ``a`` with the next one."""
            middle = after[r, a]
            inside = middle < length
            end = np.where(inside, after[r, np.minimum(middle, length)], length)
            found = self._probe(prefix[r, np.minimum(end, length)] - prefix[r, a] * powers[np.minimum(end, length) - a])
            return np.where(inside & (found >= 0), self.score[found], -np.inf)

        best = np.full((words, length), -np.inf)
        for a in range(length - 1):
            best[:, a] = value(np.arange(words), np.full(words, a))
        live = np.arange(words)
        while len(live):
            at = best[live].argmax(1)  # the leftmost of equal scores
            open_ = best[live, at] > -np.inf
            live, at = live[open_], at[open_]
            if not len(live):
                break
            middle = after[live, at]
            end = after[live, middle]
            last[live] = middle
            best[live, middle] = -np.inf
            after[live, at] = end
            inner = end < length
            before[live[inner], end[inner]] = at[inner]
            best[live, at] = value(live, at)
            previous = before[live, at]
            has = previous >= 0
            best[live[has], previous[has]] = value(live[has], previous[has])
        return np.where(after[:, 0] == length, last, -1)

    def viterbi(self, codes: np.ndarray, merging: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The best path through each of a number of words of one length.

        Returns a mask of the places where pieces end (words x length) and the pieces' ids there (-1:
        an unknown character). Without ``merging`` pieces may stand side by side freely, as unigram
        vocabularies have it.
        """
        words, length = codes.shape
        prefix, powers = self._prefix(codes)
        total = np.full((words, length + 1), -np.inf)
        total[:, 0] = 0
        back = np.zeros((words, length + 1), np.int32)
        piece = np.full((words, length + 1), -1, np.int32)
        rows = np.arange(words)
        for end in range(1, length + 1):
            begins = np.arange(max(0, end - self.longest), end)
            found = self._probe((prefix[:, end : end + 1] - prefix[:, begins] * powers[end - begins]).ravel()).reshape(words, -1)
            worth = np.where(found >= 0, self.worth[found], -np.inf)
            worth[:, -1] = self.worth[found[:, -1]]  # a single character, known or not
            if merging:
                step = np.where(found >= 0, self.number[found], -1)
                step[:, -1] = np.maximum(step[:, -1], 0)
                worth[step < 0] = -np.inf
                row, k = np.nonzero((step >= 0) & (begins > 0))
                previous = piece[row, begins[k]]
                fits = self.order.allowed(np.where(previous >= 0, self.number[previous], 0), step[row, k])
                worth[row[~fits], k[~fits]] = -np.inf
            worth = worth + total[:, begins]
            pick = worth.argmax(1)
            back[:, end] = begins[pick]
            piece[:, end] = found[rows, pick]
            total[:, end] = worth[rows, pick]
        ends = np.zeros((words, length + 1), bool)
        at = np.full(words, length)
        while (live := at > 0).any():
            ends[rows[live], at[live]] = True
            at = np.where(live, back[rows, at], 0)
        return ends[:, 1:], piece[:, 1:]

    def learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids of distinct segments (without their first blank), as little-endian int32."""
        by_length: dict[int, list[str]] = {}
        out: dict[str, bytes] = {}
        for segment in segments:
            by_length.setdefault(len(segment) + 1, []).append(segment)
        for length, group in by_length.items():
            size = max(1, _ROWS // length)
            for begin in range(0, len(group), size):
                block = group[begin : begin + size]
                codes = np.frombuffer("".join(BLANK + segment for segment in block).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(block), length)
                ends, piece = self.viterbi(codes)
                ids = piece[ends].astype("<i4")
                cuts = np.concatenate([[0], np.cumsum(ends.sum(1))]).tolist()
                unknown = ((piece < 0) & ends).any(1).tolist()
                raw = ids.tobytes()
                for k, segment in enumerate(block):
                    if not unknown[k]:
                        out[segment] = raw[4 * cuts[k] : 4 * cuts[k + 1]]
                    else:
                        found: list[int] = []
                        for i, e in zip(ids[cuts[k] : cuts[k + 1]].tolist(), np.flatnonzero(ends[k]).tolist()):
                            found += [i] if i >= 0 else [self.byte_id[b] for b in chr(codes[k, e]).encode("utf-8", "surrogatepass")]
                        out[segment] = np.array(found, "<i4").tobytes()
        return out

    def cut(self, text: str) -> list[str]:
        """Independent segments, each without the blank it begins with."""
        if not text:
            return []
        if BLANK not in text and "  " not in text and text[0] != " ":
            return text.split(" ")
        return [segment[1:] for segment in self.segments.findall((BLANK + text).replace(" ", BLANK))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian int32."""
        cut = [self.cut(t) for t in texts]
        known = self.known
        fresh = self.learn(list({w for segments in cut for w in segments if w not in known}))
        if len(known) + len(fresh) > _REMEMBERED:
            wanted = {w: known[w] for segments in cut for w in segments if w in known}  # what these texts need stays
            known.clear()
            known.update(wanted)
        long = {w: v for w, v in fresh.items() if len(w) > _SHORT}
        known.update((w, v) for w, v in fresh.items() if len(w) <= _SHORT)
        look = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        return [b"".join(map(look, segments)) for segments in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the blank that encoding puts before a text is taken off."""
        surface = self.surface
        text = b"".join([surface[i] for i in np.frombuffer(ids, "<i4").tolist()])
        return text[1:].decode("utf-8", "replace") if text[:1] == b" " else text.decode("utf-8", "replace")


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(path)
    return _CODERS[path]


def _lists(blobs: list[bytes]) -> pa.Array:
    """list<int32> of ids."""
    offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Add ``n_pieces``, ``ids_sha256`` (of the ids as little-endian int32), ``round_trip`` (decoding gives the text back) and, unless ``ids`` is false, ``piece_ids``."""
    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    fields += [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))] * ids

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        c = coder(model)
        texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
        blobs = c.encode(texts)
        digests = [hashlib.sha256(b).hexdigest() for b in blobs]
        out = {"n_pieces": pa.array([len(b) // 4 for b in blobs], pa.int64()), "ids_sha256": pa.array(digests), "round_trip": pa.array([c.decode(b) == t for b, t in zip(blobs, texts)])}
        return out | ({"piece_ids": _lists(blobs)} if ids else {})

    return append(docs, compute, fields, text, keep)


def decode(docs: DataFrame, model: str, ids: str = "piece_ids", into: str = "text") -> DataFrame:
    """The texts of ``ids`` in column ``into``; null ids give null."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def texts(column):
        c = coder(model)
        return column.map(lambda x: None if x is None else c.decode(np.asarray(x, "<i4").tobytes()))

    return docs.withColumn(into, texts(F.col(f"`{ids}`")))
