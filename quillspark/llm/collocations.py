"""Phrases of a corpus whose words occur together more often than apart, by group (language, say).

Every task holds a generalised suffix automaton of a shard of its texts, bounded in depth and kept in flat
arrays: a state is a run of words, its suffix link the run without its first word, its endpos count the
number of places where it ends. States of one word are the words; the states of each further depth are found
by sorting pairs of (state that the link leads to, word to its left), so many texts go in at once. Enumeration
visits states by depth and needs no transitions.

Counts of a depth are summed over all shards before the next depth is enumerated, and a state is entered
only if the runs that it is made of by one word less at either end may be frequent, which a bitmap of these
(at most 128 MB, sized by their number) tells. A bitmap errs on the side of too many, so counts of frequent
phrases are exact. Links of the phrases found, and the same by the last word, tell which phrases are only part
of a longer one. The first phrases of a group are taken from parts of it before they meet in one place.

Defined results: a null or empty text has no words; a null group is ``none``; repeated rows count as often as
they occur; a text is never cut (a very long one passes through several automata, each beginning with the words
before it as context); an empty table gives no rows; other columns are ignored. Words are told apart by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrowkit import U64, discard, mix, release, slices, written
from .substring_dedup import bitmap, bits_for, in_bitmap

#: Bytes that end a piece; a byte that UTF-8 never has stands for them. A tab is a blank.
_BREAK = b"\xff"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))

#: Words of a shard, and bytes of text that are split at once.
SHARD_WORDS, _CHUNK = 1 << 19, 1 << 20
#: Rows handed on at once.
_ROWS = 1 << 15
_TURN = U64(0x9FB21C651E98DF25)


class Words:
    """Numbers of the words of one group; all groups of a shard number from one list. Breaks are 0."""

    class _Group(dict):
        def __init__(self, name: str, words: list[bytes], names: list[str]):  # no link back to the owner: a cycle would stay in memory
            super().__init__({_BREAK: 0})
            self.name, self.words, self.names = name, words, names

        def __missing__(self, word: bytes) -> int:
            self[word] = number = len(self.words)
            self.words.append(word)
            self.names.append(self.name)
            return number

    def __init__(self):
        self.words: list[bytes] = [b""]
        self.names: list[str] = [""]
        self.groups: dict[str, Words._Group] = {}

    def numbers(self, group: str, words: list[bytes]) -> np.ndarray:
        own = self.groups.get(group)
        if own is None:
            own = self.groups[group] = self._Group(group, self.words, self.names)
        return np.fromiter(map(own.__getitem__, words), np.int32, len(words))


def _hash(word: bytes, group: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(group))


def _extend(state: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Hashes of runs that are made longer by a word to the left."""
    return mix(state * _TURN + left)


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words and breaks of a text, a bounded part at a time."""
    raw = text.encode().lower().translate(_FOLD)
    at = 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > _CHUNK:
            stop = raw.rfind(b" ", at, at + _CHUNK) + 1 or raw.find(b" ", at + _CHUNK) + 1 or len(raw)
        yield raw[at:stop].replace(_BREAK, b" \xff ").split()
        at = stop


class Automaton:
    """Runs of up to ``depth`` words that end at counted places of a shard.

    ``link[d]`` and ``left[d]`` give, for each state of depth d + 1, the state of depth d without its first
    word, and that word; ``count[d]`` how many places end there.
    """

    def __init__(self, words: np.ndarray, depth: int, context: int, hashes: np.ndarray | None, table: np.ndarray | None):
        run = np.arange(len(words)) - np.maximum.accumulate(np.where(words == 0, np.arange(len(words)), -1))  # words of the piece so far
        ends = np.flatnonzero(run >= depth)
        if depth > 1:
            state = hashes[words]
            for d in range(1, depth - 1):
                state[d:] = _extend(state[d:], hashes[words[:-d]])  # of runs of d + 1 words
            maybe = in_bitmap(table, state)
            ends = ends[maybe[ends] & maybe[ends - 1]]
        ends = ends[ends >= context]
        state = words[ends].astype(np.int64)
        self.link, self.left = [], [np.zeros(0, np.int64)]
        for d in range(1, depth):
            pairs, state = np.unique(state << 32 | words[ends - d], return_inverse=True)
            self.link.append(pairs >> 32)
            self.left.append(pairs & 0xFFFFFFFF)
        self.states = np.unique(state) if depth == 1 else np.arange(len(self.link[-1]))
        self.count = np.bincount(state)[self.states] if len(state) else np.zeros(0, np.int64)

    def runs(self) -> list[np.ndarray]:
        """The words of each deepest state, first to last, found along its links."""
        state, out = self.states, []
        for link, left in zip(self.link[::-1], self.left[:0:-1]):
            out.append(left[state])
            state = link[state]
        return [*out, state]


def _levels(docs: DataFrame, depth: int, table) -> DataFrame:
    """Runs of ``depth`` words by shard: g, phrase, n; with depth 1 also the number of all words (phrase null)."""

    def emit(known: Words, parts: list[np.ndarray], context: int) -> Iterator[pa.RecordBatch]:
        words = np.concatenate(parts)
        hashes = np.array([0, *(_hash(w, g.encode()) for w, g in zip(known.words[1:], known.names[1:]))], U64) if depth > 1 else None
        found = Automaton(words, depth, context, hashes, table.value if table else None)
        runs = found.runs()
        letters = pa.array(known.words, pa.binary()).cast(pa.string())
        texts = [letters.take(pa.array(r)) for r in runs]
        phrase = pc.binary_join_element_wise(*texts, " ") if depth > 1 else texts[0]
        of = pa.array(known.names, pa.string()).take(pa.array(runs[-1]))
        n = pa.array(found.count.astype(np.int64))
        if depth == 1:
            sums = pa.table([of, n], ["g", "n"]).group_by("g").aggregate([("n", "sum")])
            of, n = pa.concat_arrays([of, *sums.column("g").chunks]), pa.concat_arrays([n, *sums.column("n_sum").chunks])
            phrase = pa.concat_arrays([phrase, pa.nulls(sums.num_rows, pa.string())])
        whole = pa.RecordBatch.from_arrays([of, phrase, n], names=["g", "phrase", "n"])
        del words, hashes, found, runs, letters, texts
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts, held, context = Words(), [np.zeros(1, np.int32)], 0, 0
        for batch in batches:
            for part in slices(batch, "t"):
                for group, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for words in words_of(text):
                        numbers = known.numbers(group, words)
                        parts.append(numbers)
                        held += len(numbers)
                        if held >= SHARD_WORDS:
                            yield from emit(known, parts, context)
                            tail = np.concatenate(parts[-depth:])[-(depth - 1) :] if depth > 1 else numbers[:0]
                            before = [_BREAK if not x else known.words[x] for x in tail.tolist()]
                            known = Words()
                            parts, held, context = [np.zeros(1, np.int32), known.numbers(group, before)], 0, 1 + len(before)
                    parts.append(np.zeros(1, np.int32))
        if held:
            yield from emit(known, parts, context)
        release()

    return docs.mapInArrow(run, "g string, phrase string, n long")


def _hashed(phrases: DataFrame) -> DataFrame:
    """The hashes that the automata give the phrases of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, U64)
            runs = [p.encode().split(b" ")[::-1] for p in batch.column(1).to_pylist()]
            words = [[_hash(w, g.encode()) for w in r] for g, r in zip(batch.column(0).to_pylist(), runs)]
            if words:
                table = np.array(words, U64)
                out = table[:, 0].copy()
                for d in range(1, table.shape[1]):
                    out = _extend(out, table[:, d])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["h"])

    return phrases.select("g", "phrase").mapInArrow(run, "h long")


def frequent_phrases(docs: DataFrame, text: str = "text", group: str = "lang", depth: int = 3, least: int = 10, none: str = "und") -> tuple[list[DataFrame], DataFrame]:
    """Written tables (g, phrase, a) of all phrases that occur ``least`` times or more, by number of words, and the number of words (g, n)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(none)).alias("g"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    levels: list[DataFrame] = []
    for d in range(1, depth + 1):
        table = None
        if d > 1:
            hashes = written(_hashed(levels[-1]), "hashes")
            table = spark.sparkContext.broadcast(bitmap(hashes, "h", bits_for(hashes.count())))
            discard(hashes)
        counts = _levels(rows, d, table).groupBy("g", "phrase").agg(F.sum("n").alias("a"))
        counted = written(counts.where((F.col("a") >= least) | F.col("phrase").isNull()), "phrases")
        if table:
            table.unpersist()
        if d == 1:
            totals = counted.where("phrase is null").select("g", F.col("a").alias("n"))
            counted = counted.where("phrase is not null")
        levels.append(counted)
    return levels, totals


#: Parts of a group whose first phrases are found apart.
PARTS = 64


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", depth: int = 3, least: int = 10, share: tuple[int, int] = (50, 100), top: int = 2000, none: str = "und") -> DataFrame:
    """The first ``top`` phrases of each group: group, rank, phrase, a, l, r, n, score.

    A phrase of two to ``depth`` words that occurs a >= ``least`` times is cut after each of its words; the cut with the
    lowest floor(1000000 a a / (l r)), l and r being the counts of both parts, counts (the first, of equal ones). Phrases
    go that lie inside a longer one with at least ``share`` of their count. A longer one than by one word needs
    no look: the one between occurs as often at least.
    """
    levels, totals = frequent_phrases(docs, text, group, depth, least, none)

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    part = union([t.withColumn("m", F.lit(i)) for i, t in enumerate(levels[:-1], 1)])
    found = union([t.withColumn("m", F.lit(i)) for i, t in enumerate(levels[1:], 2)])
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - m)"))
    cut = cut.join(part.select("g", F.col("phrase").alias("first"), F.col("a").alias("l")), ["g", "first"])
    cut = cut.join(part.select("g", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["g", "rest"])
    exact = "cast(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * 1000000 div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0))) as long)"
    best = cut.groupBy("g", "phrase", "a").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("b"))

    # a phrase's suffix link, and the same by its last word, lead to the phrases that it holds
    longer = found.where("m > 2").select("g", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - m)"), F.expr("substring_index(phrase, ' ', m - 1)"))).alias("phrase"))
    longer = longer.groupBy("g", "phrase").agg(F.max("a").alias("longer"))
    whole = best.join(longer, ["g", "phrase"], "left").where(f"longer is null or {share[1]} * longer < {share[0]} * a")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = whole.select("g", "phrase", "a", "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("p"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g", "p").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "g").select(F.col("g").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
