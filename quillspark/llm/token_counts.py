"""Exact token counts at every prefix, by dynamic programming over prefixes.

Byte-pair encoding has a property that makes prefix counts a dynamic programme: the encoding of a
piece is the only sequence of tokens in which each neighbouring pair encodes to itself. So the last
token of a prefix is the one candidate (a token that is a suffix of the prefix) that is compatible
with the last token of what is left before it, and ``count[i] = count[i - len(last)] + 1``. One walk
over a piece gives the count of all its prefixes; compatibility of a pair is told by undoing the two
tokens' merges (see ``merge_order``).

Texts are cut into pieces as the tokenizer's byte-level pattern does it. The counts of all prefixes of
a piece are remembered in a bounded table, so a text costs a look-up for each piece. ``PrefixCounts``
stores the count of every prefix of a text and answers truncation and budget questions from that.

Defined results: null counts as empty (0 bytes, 0 tokens); equal rows give equal results; strings of
special tokens inside texts are one token each (the library's default); an empty table gives no rows;
input columns with the name of a result are replaced; long texts cost in proportion to their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowkit import U64, append, mix
from .merge_order import ABSENT, MergeOrder, Table

#: Fixed value: the published pattern of byte-level pre-tokenizers.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_REMEMBERED = 500_000
_PAIRS = 100_000
_SHORT = 64
_BASE = U64(0x9E3779B97F4A7C15)


def _byte_letters() -> dict[str, int]:
    """Letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairCounter:
    """Counts tokens of a byte-level BPE vocabulary given as a ``tokenizers`` file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_letters()
        write = lambda s: bytes(letter[c] for c in s)
        self.rank = {}
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((write(a), write(b)), i)
        added = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {write(t) for t in spec["model"]["vocab"] if t not in added}
        self.tails = {t[i:] for t in self.tokens for i in range(len(t))}
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(added, key=len, reverse=True))) if added else None
        self.blanks = regex.compile(r"\s+")
        self.known: dict[str, int] = {}
        self.prefixes_of: dict[str, bytes] = {}  # counts after each character of a remembered piece
        self.long: dict[str, np.ndarray] = {}  # the same for long pieces of the texts at hand
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self._number()

    def _number(self) -> None:
        """Tokens numbered by merge rank, with the tables that the batched programme probes."""
        number = {bytes([i]): i for i in range(256)}
        left, right, keys, made = list(range(256)), list(range(256)), [], []
        for a, b in self.rank:
            if a + b not in number and a in number and b in number:
                number[a + b] = len(left)
                left.append(number[a])
                right.append(number[b])
            if a in number and b in number:
                keys.append(number[a] << 32 | number[b])
                made.append(number[a + b])
        self.order = MergeOrder(np.array(left), np.array(right), Table(np.array(keys, U64), np.array(made)))
        self.terms = mix(np.arange(1, 257).astype(U64))
        self.powers = np.ones(1 + max(map(len, self.tokens)), U64)
        self.powers[1:] = np.multiply.accumulate(np.full(len(self.powers) - 1, _BASE))
        reached = self.order.valid(np.array(left)[256:], np.array(right)[256:], np.arange(256, len(left)))
        own = {t for t, i in number.items() if (i < 256 or reached[i - 256]) and t in self.tokens}
        tails = sorted({t[i:] for t in own for i in range(len(t))}, key=len)
        hashes, at = np.zeros(len(tails), U64), 0
        while at < len(tails):
            n = len(tails[at])
            stop = at
            while stop < len(tails) and len(tails[stop]) == n:
                stop += 1
            block = np.frombuffer(b"".join(tails[at:stop]), np.uint8).reshape(-1, n)
            for j in range(n):
                hashes[at:stop] = hashes[at:stop] * _BASE + self.terms[block[:, j]]
            at = stop
        self.table = Table(hashes, np.array([number[t] if t in own else -1 for t in tails]))

    def merged(self, text: bytes) -> list[bytes]:
        """Plain merging, for pairs of tokens only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def step(self, piece: bytes, end: int, state) -> tuple[int, bytes]:
        """Count and last token of ``piece[:end]``, given those of shorter prefixes."""
        options, length = [], 1
        while length <= end and (tail := piece[end - length : end]) in self.tails:
            if tail in self.tokens:
                options.append(tail)
            length += 1
        for token in reversed(options):
            count, before = state(end - len(token))
            if (self.compatible(before, token)) if before else self.merged(token) == [token]:
                return count + 1, token
        raise ValueError("the vocabulary lacks a byte")

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of one piece, the empty one first."""
        states: list[tuple[int, bytes]] = [(0, b"")]
        for end in range(1, len(piece) + 1):
            states.append(self.step(piece, end, states.__getitem__))
        return [n for n, _ in states]

    def learn(self, pieces: list[str]) -> None:
        """Remember the counts of all prefixes of distinct pieces; short ones advance together, byte by byte."""
        raw = [p.encode() for p in pieces]
        short = [i for i, r in enumerate(raw) if len(r) <= _SHORT]
        for i, counts in zip(short, self.batch([raw[i] for i in short])):
            self.prefixes_of[pieces[i]], self.known[pieces[i]] = counts, counts[-1]
        for p, r in zip(pieces, raw):
            if len(r) > _SHORT:
                codes = np.frombuffer(r, np.uint8)
                ends = np.append(np.flatnonzero((codes[1:] & 0xC0) != 0x80) + 1, len(r))
                self.long[p] = np.array(self.prefix_counts(r), np.int32)[ends]

    def prefixes(self, piece: str) -> np.ndarray:
        """Token counts after each character of a piece."""
        if piece not in self.prefixes_of and piece not in self.long:
            self.learn([piece])
        found = self.prefixes_of.get(piece)
        return self.long[piece] if found is None else np.frombuffer(found, np.uint8)

    def batch(self, raw: list[bytes]) -> list[bytes]:
        """The dynamic programme over prefixes for many pieces (of less than 256 bytes) at once: one step for each position.

        Gives the counts after each character of each piece, a byte each.
        """
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        lengths = np.array([len(raw[i]) for i in order], np.int64)
        if not len(lengths):
            return []
        width = int(lengths[0])
        codes = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
        sums = np.zeros((len(order), width + 1), U64)
        for j in range(width):
            sums[:, j + 1] = sums[:, j] * _BASE + self.terms[codes[:, j]]
        count = np.zeros((len(order), width + 1), np.int32)
        last = np.full((len(order), width + 1), -1, np.int32)
        for end in range(1, width + 1):
            live = np.arange(int(np.searchsorted(-lengths, -end, side="right")))
            rows, tokens, sizes = [], [], []
            for size in range(1, end + 1):  # longer and longer suffixes, as long as they end some token
                found = self.table.get(sums[live, end] - sums[live, end - size] * self.powers[size])
                live, found = live[found != ABSENT], found[found != ABSENT]
                if not len(live):
                    break
                is_token = found >= 0
                rows.append(live[is_token])
                tokens.append(found[is_token])
                sizes.append(np.full(int(is_token.sum()), size))
            row, token, size = map(np.concatenate, (rows, tokens, sizes))
            before = last[row, end - size]
            fits = before < 0
            inner = np.flatnonzero(~fits)
            fits[inner] = self.order.valid(before[inner], token[inner])
            row, token, size = row[fits], token[fits], size[fits]
            last[row, end] = token
            count[row, end] = count[row, end - size] + 1
        ends = np.ones((len(order), width), bool)  # a character ends where the next byte doesn't go on with it
        ends[:, :-1] = (codes[:, 1:] & 0xC0) != 0x80
        ends &= np.arange(width) < lengths[:, None]
        flat = count[:, 1:][ends].astype(np.uint8).tobytes()
        cuts = np.concatenate([[0], np.cumsum(ends.sum(1))]).tolist()
        out: list[bytes] = [b""] * len(raw)
        for k, i in enumerate(order):
            out[i] = flat[cuts[k] : cuts[k + 1]]
        return out

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special tokens' strings, and these."""
        at = 0
        if self.special is not None:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m[0], True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def count(self, text: str) -> int:
        return self.fits([text], 0)[0][0]

    def fits(self, texts: list[str], limit: int) -> tuple[list[int], list[int]]:
        """Token counts of many texts, and how many of their characters stay within ``limit`` tokens; pieces not met before are learnt together."""
        cut, special = [], []
        for text in texts:
            special.append(self.special is not None and self.special.search(text) is not None)
            cut.append([p for part, s in self.parts(text) if not s for p in self.pieces.findall(part)] if special[-1] else self.pieces.findall(text))
        fresh = list({p for pieces in cut for p in pieces if p not in self.known})
        if len(self.known) + len(fresh) > _REMEMBERED:
            self.known.clear()
            self.prefixes_of.clear()
            fresh = list({p for pieces in cut for p in pieces})
        self.long.clear()
        self.learn(fresh)
        look = self.known.__getitem__ if not self.long else lambda p: self.known[p] if p in self.known else int(self.long[p][-1])
        counts, chars = [], []
        for text, pieces, odd in zip(texts, cut, special):
            if odd:
                prefix = PrefixCounts(self, text)
                counts.append(prefix.total())
                chars.append(prefix.longest(limit))
                continue
            totals = np.cumsum(np.fromiter(map(look, pieces), np.int64, len(pieces)))
            counts.append(int(totals[-1]) if len(pieces) else 0)
            chars.append(len(text) if counts[-1] <= limit else self._reach(pieces, totals, limit))
        return counts, chars

    def _reach(self, pieces: list[str], totals: np.ndarray, limit: int) -> int:
        """Characters of the longest prefix within ``limit`` tokens, from the stored counts of the pieces around the limit."""
        over = int(np.searchsorted(totals, limit, side="right"))  # this piece ends beyond the limit
        low, high = over, over + 1
        while low > 0 and pieces[low - 1].isspace():  # a run of blanks counts as one piece where a prefix ends in it
            low -= 1
        while high < len(pieces) and pieces[high - 1].isspace():
            high += 1
        before = int(totals[low - 1]) if low else 0
        return sum(map(len, pieces[:low])) + PrefixCounts(self, "".join(pieces[low:high])).longest(limit - before)


class PrefixCounts:
    """The token count of every prefix of one text, as encoding that prefix alone would give."""

    def __init__(self, counter: BytePairCounter, text: str):
        self.counter = counter
        self.counts = self._all(text)

    def _all(self, text: str) -> np.ndarray:
        counts = np.zeros(len(text) + 1, np.int64)
        begin, resume, before = 0, 0, 0
        for part, special in self.counter.parts(text):
            end = begin + len(part)
            if special:
                # cut short, a special token is ordinary text, which goes on from the last piece with a sign
                tail = self._all(text[resume : end - 1])
                counts[begin + 1 : end] = before + tail[begin + 1 - resume :]
                counts[end] = counts[begin] + 1
                resume, before = end, int(counts[end])
            else:
                last, before = self._ordinary(part, counts[begin : end + 1])
                resume = begin + last
            begin = end
        return counts

    def _ordinary(self, text: str, counts: np.ndarray) -> tuple[int, int]:
        """Fill in the counts of a text without special tokens (the first is given); returns where its last piece that isn't blank begins, and the count of the pieces before it."""
        at = last = 0
        for piece in self.counter.pieces.findall(text):
            end = at + len(piece)
            if piece in CONTRACTIONS:  # cut short, it is a sign and a letter
                steps = [int(self.counter.prefixes(c)[-1]) for c in piece[:-1]]
                counts[at + 1 : end] = counts[at] + np.cumsum(steps)
                counts[end] = counts[at] + self.counter.prefixes(piece)[-1]
            else:
                counts[at + 1 : end + 1] = counts[at] + self.counter.prefixes(piece)
            if not piece.isspace():
                last = at
            at = end
        ends = counts.copy()
        for run in self.counter.blanks.finditer(text):  # at the end of a prefix a run of blanks is one piece
            counts[run.start() + 1 : run.end() + 1] = ends[run.start()] + self.counter.prefixes(run[0])
        return last, int(ends[last])

    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, n_chars: int) -> int:
        """Tokens of the first ``n_chars`` characters."""
        return int(self.counts[max(0, min(n_chars, len(self.counts) - 1))])

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix within ``budget`` tokens."""
        fit = np.flatnonzero(self.counts <= budget)
        return int(fit[-1]) if len(fit) else 0


_COUNTERS: dict[str, BytePairCounter] = {}


def counter(path: str) -> BytePairCounter:
    """One counter for each worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = BytePairCounter(path)
    return _COUNTERS[path]


RESULT = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens``, ``over_limit`` and ``fit_chars``.

    ``fit_chars`` is the number of characters of the longest prefix that stays within ``limit`` tokens
    (the whole text if it does), read off the prefix counts. One narrow stage.
    """

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        c = counter(tokenizer)
        column = part.column(part.schema.get_field_index(text))
        bodies = [body or "" for body in column.to_pylist()]
        tokens, fits = c.fits(bodies, limit)
        n_tokens = np.array(tokens, np.int64)
        return {"n_bytes": pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit), "fit_chars": pa.array(fits, pa.int64())}

    return append(docs, compute, RESULT, text, keep)
