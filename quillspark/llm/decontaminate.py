"""Benchmark decontamination: Wu-Manber multi-pattern search over word windows.

A benchmark item's patterns are its windows of ``width`` consecutive words (one shorter window if it
has fewer words), written as `` w1 w2 ... wn `` with single spaces. A document is brought into the
same form, and the search proceeds as Wu and Manber describe: a shift table over hashed byte blocks
says how far the window may jump, a bucket table over the hash of the pattern's last block selects
the patterns that may end here, and a direct comparison confirms them. Many positions of a buffer
("lanes") advance in lockstep, so each step is a handful of numpy operations.

The patterns of one pass are bounded by ``pattern_bytes`` of benchmark text. A larger benchmark is
searched in several passes over the documents, one after the other: each broadcasts the tables of its
share of the items, writes what it finds and lets the tables go, so that neither the driver nor a
worker ever holds more than one share. What was found is then brought to the documents by a broadcast
of at most ``BROADCAST_BYTES``; beyond, a bitmap of text hashes says which documents go to a join, and
the others stay where they are read.

Defined results: null or empty text has no words and no hits; an item without words, without text or
without id is never found; items of equal id are one; equal rows give equal results; an empty table of
documents gives no rows, an empty benchmark no hits; columns of the input that bear the name of a
result are replaced, others of any name stay.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import LOWER, Tokens, append, byte_set, discard, slices, spare, text_bytes, written
from .placing import place, places

WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_WORD_RE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_HASH = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 18
_LANE = 512
#: Bytes of what was found that may be broadcast.
BROADCAST_BYTES = 16 << 20


def item_words(text: str | None) -> list[bytes]:
    return _WORD_RE.findall((text or "").encode().translate(bytes(LOWER)))


def item_windows(text: str | None, width: int) -> list[tuple[bytes, int]]:
    """The patterns of an item with their number of words."""
    words = item_words(text)
    if not words:
        return []
    runs = [words[i : i + width] for i in range(max(1, len(words) - width + 1))]
    return [(b" " + b" ".join(run) + b" ", len(run)) for run in runs]


class _Group:
    """Wu-Manber tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes], ids: list[int]):
        self.least = min(map(len, patterns))
        self.block = 8 if self.least >= 16 else min(4, self.least)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(len(patterns), self.least)
        most = self.least - self.block + 1
        self.shift = np.full(1 << _TABLE_BITS, most, np.int32)
        for j in range(most):
            block = np.zeros((len(patterns), 8), np.uint8)
            block[:, : self.block] = heads[:, j : j + self.block]
            key = self.key(block.view("<u8").ravel())
            np.minimum.at(self.shift, key, most - 1 - j)
        order = np.argsort(key, kind="stable")  # of the last block
        self.keys, self.ids = key[order], np.asarray(ids)[order]

    def key(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks & self.mask) * _HASH >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


class WuManber:
    """Finds every occurrence of every pattern in a buffer. Patterns are distinct byte strings of three bytes or more."""

    def __init__(self, patterns: list[bytes]):
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(patterns) + bytes(8), np.uint8)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            groups.setdefault(min(len(p).bit_length(), 7), []).append(i)
        self.groups = [_Group([patterns[i] for i in ids], ids) for ids in groups.values()]

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and pattern numbers of all occurrences in ``text``."""
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        blocks = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))
        found = [self._scan(g, blocks, len(text)) for g in self.groups if len(text) >= g.least]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _scan(self, group: _Group, blocks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        tail = group.least - group.block
        cursor = np.arange(0, n - group.least + 1, _LANE) + tail
        stop = np.minimum(cursor + _LANE, n - group.least + 1 + tail)
        hits, keys = [], []
        while len(cursor):
            key = group.key(blocks[cursor])
            jump = group.shift[key]
            here = np.flatnonzero(jump == 0)
            if len(here):
                hits.append(cursor[here] - tail)
                keys.append(key[here])
            cursor = cursor + np.maximum(jump, 1)
            alive = cursor < stop
            if not alive.all():
                cursor, stop = cursor[alive], stop[alive]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        position, key = np.concatenate(hits), np.concatenate(keys)
        low = np.searchsorted(group.keys, key, "left")
        many = np.searchsorted(group.keys, key, "right") - low
        position = np.repeat(position, many)
        rank = np.arange(len(position)) - np.repeat(np.cumsum(many) - many, many)
        pattern = group.ids[np.repeat(low, many) + rank]
        return self._confirm(blocks, n, position, pattern)

    def _confirm(self, blocks: np.ndarray, n: int, position: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct comparison, eight bytes at a time; pairs drop out at their first difference."""
        own = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, 0, (1,))
        fits = position + self.lengths[pattern] <= n
        position, pattern = position[fits], pattern[fits]
        done_p, done_k, offset = [], [], 0
        while len(position):
            left = self.lengths[pattern] - offset
            mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * np.clip(left, 0, 7).astype(np.uint64))) - np.uint64(1))
            same = ((blocks[position + offset] ^ own[self.at[pattern] + offset]) & mask) == 0
            ended = same & (left <= 8)
            done_p.append(position[ended])
            done_k.append(pattern[ended])
            position, pattern = position[same & ~ended], pattern[same & ~ended]
            offset += 8
        return (np.concatenate(done_p), np.concatenate(done_k)) if done_p else (position, pattern)


def spaced(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The texts in the form of the patterns, each ended by `` \\0``, and the place before each word."""
    lengths = tokens.stops - tokens.starts
    row = np.repeat(np.arange(len(tokens.counts)), tokens.counts)
    place = np.cumsum(lengths + 1) - (lengths + 1) + 2 * row
    total = int(lengths.sum() + len(lengths) + 2 * len(tokens.counts))
    out = np.full(total, 32, np.uint8)
    source = np.flatnonzero(tokens.inside)
    out[source + np.repeat(place + 1 - tokens.starts, lengths)] = LOWER[tokens.data[source]]
    closing = np.concatenate([[0], np.cumsum(lengths + 1)])[tokens.first[1:]] + 2 * np.arange(len(tokens.counts)) + 1
    out[closing] = 0
    return out, place


class _Benchmark:
    """Patterns of a share of the items."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        of: dict[bytes, list[str]] = {}
        words: dict[bytes, int] = {}
        for item, text in items:
            for pattern, n in item_windows(text, width):
                words[pattern] = n
                mine = of.setdefault(pattern, [])
                if not mine or mine[-1] != item:
                    mine.append(item)
        self.items = list(of.values())
        self.words = np.array([words[p] for p in of], np.int64)
        self.finder = WuManber(list(of)) if of else None


def _search(bench: _Benchmark, tokens: Tokens) -> tuple[np.ndarray, list[set]]:
    """Where runs of hit words begin (+1) and end (-1), and the items found in each text."""
    change = np.zeros(len(tokens.starts) + 1, np.int64)
    found: list[set] = [set() for _ in tokens.counts]
    if bench.finder is not None and len(tokens.starts):
        buffer, place = spaced(tokens)
        position, pattern = bench.finder.search(buffer)
        word = np.searchsorted(place, position)
        np.add.at(change, word, 1)
        np.add.at(change, word + bench.words[pattern], -1)
        row = tokens.row_of(word)
        for key in np.unique(row * len(bench.items) + pattern).tolist():
            found[key // len(bench.items)].update(bench.items[key % len(bench.items)])
    return change, found


def _runs(tokens: Tokens, hit: np.ndarray) -> list[list[int]]:
    """Runs of hit words of each text: start, end, start, end ..."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist() if hit.any() else []
    runs: list[list[int]] = [[] for _ in tokens.counts]
    for a, b in zip(edge[::2], edge[1::2]):
        r = int(tokens.row_of(np.array([a]))[0])
        while a < b:  # a run of hits may go on into the next row
            end = min(b, int(tokens.first[r + 1]))
            if end > a:
                runs[r] += [a - int(tokens.first[r]), end - int(tokens.first[r])]
            a, r = max(a, end), r + 1
    return runs


def _columns(tokens: Tokens, change: np.ndarray, found: list) -> dict[str, pa.Array]:
    hit = np.cumsum(change[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = (sums[tokens.first[1:]] - sums[tokens.first[:-1]]).astype(np.int64)
    n_words = tokens.counts.astype(np.int64)
    ordered = [sorted(x) for x in found]
    return {
        "n_words": pa.array(n_words),
        "n_hit": pa.array(n_hit),
        "n_items": pa.array([len(x) for x in ordered], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered], pa.string()),
        "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
        "items": pa.array(ordered, pa.list_(pa.string())),
        "hit_runs": pa.array(_runs(tokens, hit), pa.list_(pa.int32())),
    }


RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_runs", T.ArrayType(T.IntegerType())),
]


def _tokens(part: pa.RecordBatch, text: str) -> Tokens:
    return Tokens(*text_bytes(part.column(part.schema.get_field_index(text))), WORD)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, pattern_bytes: int = 2 << 20, keep: list[str] | None = None) -> DataFrame:
    """Mark documents that hold benchmark passages.

    Adds ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` (at least one word
    hit, and at least a twentieth of all words), ``items`` (the item ids found, sorted) and
    ``hit_runs`` (word positions: start, end, start, end ...). Documents are read once for each
    ``pattern_bytes`` of benchmark text; documents without a hit are never shuffled (but for those that
    share a place in a bitmap with one that has).
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null and t <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = max(1, -(-size // pattern_bytes))

    def tables(k: int):
        share = items if passes == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        return spark.sparkContext.broadcast(_Benchmark(sorted((r.i, r.t) for r in share.toLocalIterator()), width))

    if passes == 1:
        bench = tables(0)

        def at_once(part: pa.RecordBatch) -> dict[str, pa.Array]:
            tokens = _tokens(part, text)
            return _columns(tokens, *_search(bench.value, tokens))

        return append(docs, at_once, RESULT, text, keep)

    kept = docs.columns if keep is None else keep
    h, g, items_of, runs_of = spare(docs, "h", "g", "found", "runs")
    named = docs.withColumns({h: F.xxhash64(f"`{text}`"), g: F.xxhash64(F.lit("text"), f"`{text}`")})
    texts = named.select(F.col(h).alias("h"), F.col(g).alias("g"), F.col(f"`{text}`").alias("t"))
    parts = []
    for k in range(passes):
        bench = tables(k)
        parts.append(written(_found(texts, bench), "hits"))
        bench.unpersist()
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy(F.col("h").alias(h), F.col("g").alias(g)).agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias(items_of), F.flatten(F.collect_list("runs")).alias(runs_of))
    merged = written(merged, "found")
    discard(*parts)

    def joined(part: pa.RecordBatch) -> dict[str, pa.Array]:
        tokens = _tokens(part, text)
        change = np.zeros(len(tokens.starts) + 1, np.int64)
        for first, runs in zip(tokens.first.tolist(), part.column(part.schema.get_field_index(runs_of)).to_pylist()):
            places = np.array(runs or [], np.int64).reshape(-1, 2) + first
            np.add.at(change, places[:, 0], 1)
            np.add.at(change, places[:, 1], -1)
        return _columns(tokens, change, [x or [] for x in part.column(part.schema.get_field_index(items_of)).to_pylist()])

    weight = F.sum(64 + 4 * F.size(runs_of) + F.octet_length(F.array_join(items_of, ",")) + 24 * F.size(items_of))
    if (merged.agg(weight).first()[0] or 0) <= BROADCAST_BYTES:
        both = named.join(F.broadcast(merged), [h, g], "left")
    else:
        (mark,) = spare(named, "mark")
        marked = place(named, h, written(places(merged, h), "places"), mark)
        clear = marked.where(~F.col(mark)).withColumns({c: F.lit(None).cast(merged.schema[c].dataType) for c in (items_of, runs_of)})
        both = clear.unionByName(marked.where(mark).join(merged, [h, g], "left")).drop(mark)
    out = append(both, joined, RESULT, text, [*kept, items_of, runs_of])
    return out.drop(items_of, runs_of)


def _found(texts: DataFrame, bench) -> DataFrame:
    """(h, g, items, runs) of the texts in which one share of the benchmark is found."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                tokens = _tokens(part, "t")
                change, found = _search(bench.value, tokens)
                runs = _runs(tokens, np.cumsum(change[:-1]) > 0)
                at = [i for i, x in enumerate(found) if x]
                if at:
                    pick = pa.array(at)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array([sorted(found[i]) for i in at], pa.list_(pa.string())), pa.array([runs[i] for i in at], pa.list_(pa.int32()))], names=["h", "g", "items", "runs"])

    return texts.mapInArrow(run, "h long, g long, items array<string>, runs array<int>").dropDuplicates(["h", "g"])
