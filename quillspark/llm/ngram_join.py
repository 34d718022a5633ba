"""N-gram Jaccard self-join with set-relation skipping.

Sets of word n-grams are indexed by the rarest of their elements (a prefix long enough that linked
sets share ``COMMON`` elements of it), rarity being counted over all rows in 2^``BUCKETS`` buckets.
Two relations between sets are used to skip work, and neither loses a link between different sets:

* *Index lists.* Entries of a list are ordered by size and position and cut into blocks. The block's
  sizes and positions bound the overlap that any of its entries can have with any of another block's,
  and pairs of blocks out of reach are skipped whole; within the others the bounds are put to pairs.
* *Answers.* Equal sets form one class, which is joined once. The first ``HUBS`` classes of a list are
  its hubs; pairs of a class and a hub are counted over all lists, and compared where they share as
  many lists as linked sets do. That settles all pairs but those on lists with more classes than hubs.
  Where such a list has classes of several components, the classes that are most similar to their hubs
  are hubs in turn, as they are most likely to be linked with others.
  What a comparison gives, the exact overlap, is the hub's answer for the class; two classes' answers
  for one hub give bounds for the two: what they share within the hub and what they have beyond it. So
  their own answer is derived, link or no link, without looking at them, or only the pair that the
  bounds leave open is compared. Classes in one component are never compared again.

Sets consist of 64-bit hashes of their n-grams, and intersections are counted over whole hashes.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a
text with fewer words than ``n`` has one element, its whole sequence; equal rows are one class; rows
with a null key take part, but a component is named by its least key that is not null; an empty table
gives no rows; columns beside key and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowkit import LOWER, NOT_BLANK, U64, Tokens, _WORD_POWERS, discard, mix, release, rolling, slices, spare, text_bytes, written
from .components import components, extended
from .placing import place, places
from .substring_dedup import bitmap, bits_for, in_bitmap

BUCKETS = 24
_CHUNK = 1 << 18
_HELD = 1 << 22  # elements that a task counts at once
COMMON = 4
#: Entries of an index list that one task takes; longer lists are dealt in parts.
LIST_BLOCK = 4096
#: Entries that are skipped together.
SKIP_BLOCK = 64
#: Classes of a list that the others are counted against.
HUBS = 8
_MARKS = ["m0", "m1", "m2", "m3"]
_SEEN = 200_000
#: Rows that may be broadcast (16 bytes each).
BROADCAST_ROWS = 1 << 20


def shingle_sets(column: pa.Array, n: int, member: np.ndarray = NOT_BLANK) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, offsets = text_bytes(column)
    tokens = Tokens(data, offsets, member)
    words = tokens.hashes(LOWER)
    hashes, at = tokens.windows(words, n)
    cuts = np.searchsorted(at, tokens.first)
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
    for r in np.flatnonzero((tokens.counts > 0) & (tokens.counts < n)).tolist():
        a, b = tokens.first[r], tokens.first[r + 1]
        out[r] = mix(rolling(words, np.array([a]), np.array([b]), _WORD_POWERS) + U64(b - a))
    return out


def signature(elements: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(mix(np.array([np.add.reduce(mix(elements ^ U64(0x5851F42D4C957F2D))) + U64(len(elements))], U64)).view(np.int64)[0])


def needed(share: tuple[int, int], n: int) -> int:
    """The least overlap with which a set of ``n`` elements can be linked at all."""
    return -(-share[0] * n // share[1])


def linked(share: tuple[int, int], both, n, m):
    """Whether sets of ``n`` and ``m`` elements with ``both`` in common are linked: both / union >= share."""
    return share[1] * both >= share[0] * (n + m - both)


def common(share: tuple[int, int]) -> int:
    """How many prefix elements linked sets share at least: ``COMMON``, or fewer where small sets can be linked."""
    size = 1
    while not linked(share, size, size, size + 1):
        size += 1
    return min(COMMON, needed(share, size))


def prefix_size(share: tuple[int, int], size):
    """How many of a set's elements are indexed."""
    return np.minimum(size, size - needed(share, size) + common(share))


# ---- rarity ----------------------------------------------------------------------------------


def _signed(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Per row its set's size and signature; and at the end of each task its counts of element buckets, in packed chunks (rows with a chunk)."""
    names = ["key", "n", "sign", "chunk", "counts"]

    def packed(seen: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint32)
        cuts = np.searchsorted(places, np.arange(0, (1 << BUCKETS) + 1, _CHUNK))
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a < b:
                counts = np.bincount(places[a:b].astype(np.int64) - k * _CHUNK, minlength=_CHUNK)
                blob = zlib.compress(np.minimum(counts, 65535).astype("<u2").tobytes(), 1)
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.nulls(1, key_type), none, none, pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for part in slices(batch, "t"):
                sets = shingle_sets(part.column(1), n)
                sizes = np.array([len(s) for s in sets], np.int64)
                signs = pa.array([signature(s) if len(s) else None for s in sets], pa.int64())
                if sizes.sum():
                    seen.append((np.concatenate(sets) >> U64(64 - BUCKETS)).astype(np.uint32))
                    held += len(seen[-1])
                if held > _HELD:
                    yield from packed(seen)
                    seen, held = [], 0
                none = pa.nulls(len(sets), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), signs, none, pa.nulls(len(sets), pa.binary())], names=names)
        yield from packed(seen)
        release()

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(source.schema["key"].dataType)
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n long, sign long, chunk int, counts binary")


def _rarity(signed: DataFrame) -> np.ndarray:
    """Eight times the binary logarithm of one more than each bucket's count: a byte a bucket, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(0)

        def out() -> pa.RecordBatch:
            steps = np.minimum(np.rint(8 * np.log2(1.0 + total)), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["chunk", "steps"])

        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != current:
                    if current is not None:
                        yield out()
                    current, total = chunk, np.zeros(_CHUNK, np.uint64)
                total += np.frombuffer(zlib.decompress(blob), "<u2")
        if current is not None:
            yield out()

    chunks = signed.where("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros(1 << BUCKETS, np.uint8)
    for row in chunks.mapInArrow(run, "chunk int, steps binary").toArrow().to_pylist():
        table[row["chunk"] * _CHUNK : (row["chunk"] + 1) * _CHUNK] = np.frombuffer(row["steps"], np.uint8)
    return table


# ---- index lists -----------------------------------------------------------------------------


def _entries(docs: DataFrame, text: str, n: int, share: tuple[int, int], rarity) -> DataFrame:
    """Index entries of each class: element, part of its list (0: undivided), signature, size, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, text):
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for elements in shingle_sets(part.column(0), n):
                    size = len(elements)
                    # a set this small can be linked with its equals only
                    if size == 0 or not linked(share, size, size, size + 1):
                        continue
                    sign = signature(elements)
                    if sign in seen:
                        continue
                    if len(seen) < _SEEN:
                        seen.add(sign)
                    steps = rarity.value[(elements >> U64(64 - BUCKETS)).astype(np.int64)]
                    order = np.argsort(steps, kind="stable")[: int(prefix_size(share, size))]
                    parts = np.ceil(2.0 ** (steps[order] / 8) / LIST_BLOCK).astype(np.int64)
                    columns[0].append(elements[order].view(np.int64))
                    columns[1].append(np.where(parts > 1, 1 + sign % parts, 0).astype(np.int32))
                    columns[2].append(np.full(len(order), sign))
                    columns[3].append(np.full(len(order), size, np.int32))
                    columns[4].append(np.arange(len(order), dtype=np.int32))
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["e", "part", "sign", "n", "at"])
        release()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "e long, part int, sign long, n int, at int")


def _fits(sizes: np.ndarray, size, share: tuple[int, int]) -> np.ndarray:
    """Which sets have a size that a set of ``size`` elements could be linked with."""
    return share[1] * np.minimum(sizes, size).astype(np.int64) >= share[0] * np.maximum(sizes, size).astype(np.int64)


def _with_hubs(entries: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Entries (e, part, h, sign, n, at) of lists that more than one class is on, each with its hubs.

    The hubs of an entry are those of its list's first ``HUBS`` classes by (h, signature) that come before
    it and have a size that fits; ``far`` says that there are classes before it that are no hubs. Lists of any length stream through: of a list that goes on in the next batch only its
    first entries are kept. Parts of divided lists are kept whole, and all their entries are far.
    """
    names = ["e", "part", "sign", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, ghosts, last = None, 0, None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            e, _, sign = columns[:3]
            if not len(e):
                continue
            again = np.zeros(len(e), bool)  # one class from several tasks
            again[1:] = (e[1:] == e[:-1]) & (sign[1:] == sign[:-1])
            again[0] = last == (e[0], sign[0])
            last = (e[-1], sign[-1])
            columns = [c[~again] for c in columns]
            if carry is not None:
                columns = [np.concatenate(x) for x in zip(carry, columns)]
            e, part, sign, n, _ = columns
            if not len(e):
                continue
            starts = np.concatenate([[0], np.flatnonzero((e[1:] != e[:-1]) | (part[1:] != part[:-1])) + 1])
            length = np.diff(np.append(starts, len(e)))
            first, place = np.repeat(starts, length), np.arange(len(e))
            hub = np.minimum(first[:, None] + np.arange(HUBS), len(e) - 1)
            good = (hub < place[:, None]) & _fits(n[:, None], n[hub], share)
            whole = np.repeat((length > 1) | (part[starts] > 0), length)
            alone = length[-1] == 1 and part[-1] == 0 and ghosts < len(e)  # more of its list may come in the next batch
            out = np.flatnonzero(whole & (place >= ghosts))
            offsets = np.concatenate([[0], np.cumsum(good[out].sum(1))]).astype(np.int32)
            hubs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sign[hub[out]][good[out]]))
            far = (place - first > HUBS) | (part > 0)
            yield pa.RecordBatch.from_arrays([*[pa.array(c[out]) for c in columns], hubs, pa.array(far[out])], names=[*names, "hubs", "far"])
            carry = [c[starts[-1] : starts[-1] + HUBS + 1] for c in columns]
            ghosts = 0 if alone else len(carry[0])

    dealt = entries.repartition("e", "part").sortWithinPartitions("e", "part", "h", "sign").select(*names)
    return dealt.mapInArrow(run, "e long, part int, sign long, n int, at int, hubs array<long>, far boolean")


def _counted(lists: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(u, v): classes with their hubs, where they share as many lists as linked sets at least.

    The first classes of a divided list's parts have the least of them as their hub.
    """
    own = lists.select(F.col("sign").alias("u"), F.explode("hubs").alias("v"))
    heads = lists.where("part > 0 and size(hubs) = 0").select("e", "sign")
    least = heads.groupBy("e").agg(F.min("sign").alias("hub"))
    above = heads.join(least, "e").where("sign <> hub").select(F.col("sign").alias("u"), F.col("hub").alias("v"))
    return own.unionByName(above).groupBy("u", "v").agg(F.count("*").alias("c")).where(F.col("c") >= common(share)).select("u", "v")


def _dense(lists: DataFrame) -> DataFrame:
    """The classes that are on some list with more classes than hubs: pairs of others have been counted whole."""
    long = written(lists.where("far").select("e").distinct(), "long")
    out = written(lists.join(_light(long), "e", "left_semi").select("sign").distinct(), "dense")
    discard(long)
    return out


def _light(table: DataFrame) -> DataFrame:
    """The table, marked for a broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


# ---- comparison ------------------------------------------------------------------------------


def _sets(docs: DataFrame, text: str, n: int, wanted) -> DataFrame:
    """The sets of the classes whose signature is in the bitmap ``wanted``, as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, text):
                signs, blobs = [], []
                for elements in shingle_sets(part.column(0), n):
                    if not len(elements):
                        continue
                    sign = signature(elements)
                    if sign in seen or not in_bitmap(wanted.value, np.array([sign], np.int64).view(U64))[0]:
                        continue
                    if len(seen) < _SEEN:
                        seen.add(sign)
                    signs.append(sign)
                    blobs.append(elements.tobytes())
                if signs:
                    yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array(blobs, pa.binary())], names=["sign", "elements"])
        release()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "sign long, elements binary").dropDuplicates(["sign"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, nu, nv, both): sizes and exact overlap of each pair. ``v`` may be the hub of very many pairs: its set is dealt in as many copies as its pairs need."""
    degree = written(pairs.groupBy("v").agg(F.ceil(F.count("*") / 256).cast("int").alias("copies")), "degree")
    chosen = written(pairs.join(degree, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int").alias("salt")), "chosen")
    copies = _light(degree).join(sets.select(F.col("sign").alias("v"), F.col("elements").alias("b")), "v").select("v", "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    salted = _light(chosen).join(sets.select(F.col("sign").alias("u"), F.col("elements").alias("a")), "u")
    joined = salted.join(copies, ["v", "salt"]).select("u", "v", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, last, other = [], None, np.zeros(0, U64)
            for a, b in zip(batch.column(2), batch.column(3)):
                x, raw = np.frombuffer(a.as_buffer(), U64), b.as_py()
                if raw != last:
                    last, other = raw, np.frombuffer(raw, U64)
                place = np.minimum(np.searchsorted(other, x), len(other) - 1)
                sizes.append((len(x), len(other), int((other[place] == x).sum())))
            columns = np.array(sizes, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in columns]], names=["u", "v", "nu", "nv", "both"])
        release()

    return joined.mapInArrow(run, "u long, v long, nu long, nv long, both long")


def _links(compared: DataFrame, share: tuple[int, int]) -> DataFrame:
    return compared.where(linked(share, F.col("both"), F.col("nu"), F.col("nv"))).select("u", "v")


# ---- pairs across components -----------------------------------------------------------------


class _Entries:
    """Entries of index lists as columns, and what is known of pairs of them without their sets."""

    def __init__(self, batch_columns: list[np.ndarray], share: tuple[int, int]):
        self.share = share
        self.key, self.at, self.sign, self.n, self.root, self.m, self.own, self.star, self.known, self.star_n, *marks = batch_columns
        self.at, self.n, self.m, self.known, self.star_n = (x.astype(np.int64) for x in (self.at, self.n, self.m, self.known, self.star_n))
        self.rest = self.n - self.at
        self.behind = self.n - prefix_size(share, self.n)
        self.marks = np.stack([x.view(U64) for x in marks], 1)
        self.double = self.m - np.bitwise_count(self.marks).sum(1, dtype=np.int64)
        self.edges = np.concatenate([[0], np.flatnonzero(self.key[1:] != self.key[:-1]) + 1, [len(self.key)]])
        two = np.maximum.reduceat(self.own, self.edges[:-1]) != np.minimum.reduceat(self.own, self.edges[:-1])
        self.two = np.repeat(two, np.diff(self.edges))  # two blocks of a divided list: pairs within a block are another task's

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of entries that lie in blocks within reach of each other."""
        length = np.diff(self.edges)
        short = np.repeat(length <= SKIP_BLOCK, length)
        for d in range(1, int(length[length <= SKIP_BLOCK].max(initial=1))):  # short lists, all at once
            i = np.flatnonzero((self.key[d:] == self.key[:-d]) & short[:-d])
            yield i, i + d
        for a, b in zip(self.edges[:-1][length > SKIP_BLOCK].tolist(), self.edges[1:][length > SKIP_BLOCK].tolist()):
            cuts = np.arange(a, b, SKIP_BLOCK)
            at, rest = np.maximum.reduceat(self.at[:b], cuts), np.maximum.reduceat(self.rest[:b], cuts)
            least = np.minimum.reduceat(self.n[:b], cuts)
            for k, begin in enumerate(cuts.tolist()):
                most = np.minimum(at[k], at[k:]) + np.minimum(rest[k], rest[k:])
                reach = np.flatnonzero(linked(self.share, most, least[k], least[k:])) + k
                i = np.arange(begin, min(begin + SKIP_BLOCK, b))
                for other in reach.tolist():
                    j = np.arange(cuts[other], min(cuts[other] + SKIP_BLOCK, b))
                    x, y = np.meshgrid(i, j, indexing="ij")
                    above = x < y
                    yield x[above], y[above]

    def open(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be linked, and whether it is certain that they are."""
        other = (self.root[i] != self.root[j]) & (~self.two[i] | (self.own[i] != self.own[j]))
        i, j = i[other], j[other]
        # at an element in common, two sets share at most the smaller position and the smaller rest
        within = np.minimum(self.at[i], self.at[j]) + np.minimum(self.rest[i], self.rest[j])
        reach = linked(self.share, within, self.n[i], self.n[j])
        i, j = i[reach], j[reach]
        # up to the end of the prefix that ends first they share no more elements than lists
        shared = np.bitwise_count(self.marks[i] & self.marks[j]).sum(1, dtype=np.int64) + np.minimum(self.double[i], self.double[j])
        most = np.minimum(np.minimum(self.m[i], self.m[j]), shared) + np.maximum(self.behind[i], self.behind[j])
        # answers of one pivot: within it and beyond it
        same = self.star[i] == self.star[j]
        beyond = np.minimum(self.n[i] - self.known[i], self.n[j] - self.known[j])
        most = np.where(same, np.minimum(most, np.minimum(self.known[i], self.known[j]) + beyond), most)
        least = np.where(same, self.known[i] + self.known[j] - self.star_n[i], 0)
        told = (self.star[i] == self.sign[j]) | (self.star[j] == self.sign[i])  # the pivot's own answer was no
        may = linked(self.share, most, self.n[i], self.n[j]) & ~told
        i, j, least = i[may], j[may], least[may]
        return i, j, linked(self.share, least, self.n[i], self.n[j])


def _lists(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Whole index lists from sorted batches: columns cut at changes of the first one; the last list waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        held = [c[last:] for c in columns]
        if last:
            yield [c[:last] for c in columns]
    if held is not None and len(held[0]):
        yield held


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    """Distinct pairs, the smaller signature first, with sizes, the number of lists in common and whether the link is certain."""
    x, y, nx, ny, sure = (np.concatenate(c) for c in zip(*found))
    swap = x > y
    u, v, nu, nv = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny)
    order = np.lexsort((v, u))
    u, v, nu, nv, sure = u[order], v[order], nu[order], nv[order], sure[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(first)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (u[at], v[at], nu[at], nv[at], np.diff(np.append(at, len(u))), np.logical_or.reduceat(sure, at))], names=["u", "v", "nu", "nv", "c", "sure"])


def _across(labelled: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs in different components that may still be linked: (u, v, sure); see ``_Entries`` for the bounds.

    A class's lists are marked in a bitmap of 256 bits: two classes have no more lists in common than
    their bitmaps have bits, but for lists that share a bit. With the common lists counted, the same
    bound is put to the pair once more.
    """
    order = ["key", "n", "at", "sign"]
    names = ["key", "at", "sign", "n", "root", "m", "own", "star", "known", "star_n", *_MARKS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for columns in _lists(batches, names):
            entries = _Entries(columns, share)
            for i, j in entries.pairs():
                for a in range(0, len(i), 1 << 17):
                    x, y, sure = entries.open(i[a : a + (1 << 17)], j[a : a + (1 << 17)])
                    if len(x):
                        found.append((entries.sign[x], entries.sign[y], entries.n[x], entries.n[y], sure))
                        held += len(x)
                    if held > 200_000:
                        yield _pairs(found)
                        found, held = [], 0
        if found:
            yield _pairs(found)

    # long lists are cut into blocks by class, and each pair of blocks is dealt to a place of its own
    cut = labelled.withColumn("own", F.pmod(F.xxhash64("sign"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # two blocks meet once: the key names them in order; a block alone is its pair with itself
    key = F.when(F.col("blocks") == 1, F.col("e")).otherwise(F.xxhash64("e", F.least("own", "with"), F.greatest("own", "with")))
    dealt = cut.withColumn("key", key).repartition("key").sortWithinPartitions(*order).select(*names)
    counted = dealt.mapInArrow(run, "u long, v long, nu long, nv long, c long, sure boolean").groupBy("u", "v").agg(F.sum("c").alias("c"), F.min("nu").alias("nu"), F.min("nv").alias("nv"), F.max("sure").alias("sure"))
    num, den = share
    behind = lambda n: F.ceil(F.lit(num) * F.col(n) / den).cast("long") - common(share)
    most = F.col("c") + F.greatest(behind("nu"), behind("nv"), F.lit(0))
    return counted.where("sure or " + f"c >= {common(share)}").where(F.col("sure") | linked(share, most, F.col("nu"), F.col("nv"))).select("u", "v", "sure")


def _central(kept: DataFrame, answers: DataFrame, roots: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) in different components, v being one of the classes of a list that are most similar to what they were compared with."""
    similarity = F.col("both") / (F.col("nu") + F.col("nv") - F.col("both"))
    sides = answers.select(F.col("u").alias("sign"), similarity.alias("s")).unionByName(answers.select(F.col("v").alias("sign"), similarity.alias("s")))
    order = written(sides.groupBy("sign").agg((-F.avg("s")).alias("h")), "order")
    part = F.when(F.col("blocks") > 1, 1 + F.pmod(F.xxhash64("sign"), F.col("blocks"))).otherwise(0).cast("int")
    ordered = kept.join(_light(order), "sign", "left").withColumns({"h": F.coalesce("h", F.lit(0.0)), "part": part})
    counted = written(_counted(_with_hubs(ordered, share), share), "counted")
    of = _light(roots)
    both = counted.join(of.select(F.col("node").alias("u"), F.col("root").alias("a")), "u", "left").join(of.select(F.col("node").alias("v"), F.col("root").alias("b")), "v", "left")
    out = written(both.where(F.coalesce("a", "u") != F.coalesce("b", "v")).select("u", "v"), "central")
    discard(order, counted)
    return out


def _mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (e, sign, n, at) of the lists that have classes of more than one component, with ``root`` and the number of ``blocks`` of their list; written."""
    rooted = written(lists.join(_light(roots.withColumnRenamed("node", "sign")), "sign", "left").withColumn("root", F.coalesce("root", "sign")), "rooted")
    mixed = written(rooted.groupBy("e").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks")).where("a < b").select("e", "blocks"), "mixed")
    kept = written(rooted.join(_light(mixed), "e"), "kept")
    discard(rooted, mixed)
    return kept


def _labelled(kept: DataFrame, answers: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``kept`` with each class's lists, marks and best answer. A class that is on fewer lists than linked sets share is left out."""
    bit = [F.expr(f"bit_or(if((e >> 6) & 3 = {k}, shiftleft(1L, cast(e & 63 as int)), 0L))").alias(name) for k, name in enumerate(_MARKS)]
    shared = kept.groupBy("sign").agg(F.count("*").alias("m"), *bit).where(F.col("m") >= common(share))
    best = answers.groupBy(F.col("u").alias("sign")).agg(F.max_by(F.struct(F.col("v").alias("star"), F.col("both").alias("known"), F.col("nv").alias("star_n")), F.struct("both", "v")).alias("a")).select("sign", "a.*")
    own = {"known": F.coalesce("known", F.col("n").cast("long")), "star_n": F.coalesce("star_n", F.col("n").cast("long")), "star": F.coalesce("star", "sign")}
    of_class = written(shared.join(best, "sign", "left"), "classes")
    return kept.join(_light(of_class), "sign").withColumns(own)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, share: tuple[int, int] = (9, 10)) -> DataFrame:
    """One row for each row of ``docs``: ``key``, ``n_shingles``, ``class_id`` (signature of its set), ``component_id`` (least key of its component)."""
    spark = docs.sparkSession
    signed = written(_signed(docs, key, text, n), "signatures")
    rarity = spark.sparkContext.broadcast(_rarity(signed))
    rows = signed.where("chunk is null").select("key", "n", "sign")
    lists = written(_with_hubs(_entries(docs, text, n, share, rarity).withColumn("h", F.lit(0)), share), "lists")
    rarity.destroy()
    counted, dense = written(_counted(lists, share), "counted"), _dense(lists)
    signs = written(counted.select(F.explode(F.array("u", "v")).alias("sign")).unionByName(dense).distinct(), "signs")
    wanted = spark.sparkContext.broadcast(bitmap(signs, "sign", bits_for(4 * signs.count())))
    sets = written(_sets(docs, text, n, wanted), "sets")
    wanted.destroy()
    answers = written(_compared(counted, sets), "answers")
    roots = components(_links(answers, share), BROADCAST_ROWS)
    kept = _mixed(lists.join(_light(dense), "sign", "left_semi").select("e", "sign", "n", "at"), roots)
    discard(lists, counted, dense, signs)
    if not kept.isEmpty():
        central = _central(kept, answers, roots, share)
        more = written(_compared(central, sets), "answers")
        answers = answers.unionByName(more)
        discard(central)
        roots = extended(roots, _links(more, share), BROADCAST_ROWS)
        first, kept = kept, _mixed(kept.select("e", "sign", "n", "at"), roots)
        discard(first)
        open_ = written(_across(_labelled(kept, answers, share), share), "open")
        more = written(_compared(open_.where("not sure").select("u", "v"), sets), "answers")
        roots = extended(roots, _links(more, share).unionByName(open_.where("sure").select("u", "v")), BROADCAST_ROWS)
        discard(open_, more)
    discard(kept, sets, answers)
    classes = rows.where("n > 0").groupBy("sign").agg(F.min("key").alias("least"))
    named = written(classes.join(roots.withColumnRenamed("node", "sign"), "sign", "left").withColumn("root", F.coalesce("root", "sign")), "named")
    least = written(named.groupBy("root").agg(F.min("least").alias("component")), "least")  # null keys don't count
    components_of = written(named.join(least, "root").select("sign", "component"), "components")
    discard(named, least, roots)
    out = rows.join(components_of, "sign", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("sign").alias("class_id"), F.coalesce("component", "key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, share: tuple[int, int] = (8, 10)) -> DataFrame:
    """``docs`` without near copies: of each component the row with the least (key, hash of text) stays, nulls first.

    Rows are told apart by key and text, so repeated and null keys do no harm; of rows that repeat
    wholly one stays. Rows without words are linked with nothing and all stay. Columns are unchanged.
    Only what goes is looked up: by a broadcast of at most ``BROADCAST_ROWS`` rows; beyond, a bitmap of
    their hashes says which rows go to the join, and the others stay where they are read.
    """
    names = docs.columns
    row, k, h = spare(docs, "row", "k", "h")
    mark = F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`")).alias("h"))
    found = jaccard_components(docs.select(mark.alias("row"), F.col(f"`{text}`").alias("text")), "row", "text", n, share)
    counted = found.where("n_shingles > 0").groupBy("row").agg(F.count("*").alias("n"), F.min(F.col("component_id") == F.col("row")).alias("stays"))
    special = written(counted.where("not stays or n > 1").select(F.col("row.k").alias(k), F.col("row.h").alias(h), "stays"), "special")
    split = docs.withColumns({k: F.col(f"`{key}`"), h: F.xxhash64(F.col(f"`{text}`"))})
    on = lambda side: split[k].eqNullSafe(side[k]) & (split[h] == side[h])
    clear = None
    if special.count() > BROADCAST_ROWS:
        (mark,) = spare(split, "mark")
        marked = place(split, h, written(places(special, h), "places"), mark)
        clear, split = marked.where(~F.col(mark)).drop(mark), marked.where(mark).drop(mark)
    plain = split.join(_light(special), on(special), "left_anti")
    repeated = special.where("stays")
    once = split.join(_light(repeated), on(repeated), "left_semi").dropDuplicates([k, h])
    kept = plain.unionByName(once)
    return (kept if clear is None else clear.unionByName(kept)).select(*[F.col(f"`{c}`") for c in names])
