"""Substring deduplication by Rabin-Karp hashes of all windows of a fixed number of words.

1. Each window's *anchor* is the least hash among the shorter word runs inside it. Equal windows have
   equal anchors in different places, so a window whose anchor occurs in one place only can't repeat.
   Anchor places are an eighth of all places; Spark counts their hashes.
2. Rolling hashes of the windows whose anchor repeats are counted in Spark; those that start once are
   noted with their place. Which anchors repeat is held in a bitmap with 16 places for each of them, up
   to 128 MB; beyond that more windows go through to the count, and nothing else changes.
3. A text's windows whose anchor repeats, less the ones that start once, are merged into maximal
   intervals: the words to remove.

Windows are judged on the input: every occurrence goes, in the same text or in another. A window is
told by two rolling hashes of different bases, 128 bits together, over 64-bit hashes of its words.

Defined results: null and empty texts have no words and keep the empty text; rows that repeat count
as further occurrences; rows are told apart by a 64-bit hash of key and text, so null and repeated
keys do no harm; an empty table gives no rows; columns of the input with a result's name are replaced,
and others of any name are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import NOT_BLANK, Tokens, append, discard, rolling, slices, spare, text_bytes, written, _OTHER_POWERS, _WORD_POWERS, mix


def _least(values: np.ndarray, span: int, pick) -> np.ndarray:
    """Sliding minimum (or maximum) over ``span`` values from each place on, by doubling."""
    out, reach = values, 1
    while reach < span:
        step = min(reach, span - reach)
        out = pick(out[: len(out) - step], out[step:])
        reach += step
    return out


def _windows(part: pa.RecordBatch, column: str, width: int, gram: int):
    """Per slice: tokens, window starts, window hashes (two), anchor hash of each window, anchor places' hashes."""
    data, offsets = text_bytes(part.column(part.schema.get_field_index(column)))
    tokens = Tokens(data, offsets, NOT_BLANK)
    hashes = tokens.hashes()
    empty = np.zeros(0, np.uint64)
    if len(hashes) < width:
        return tokens, np.zeros(0, np.int64), (empty, empty), empty, empty
    whole, at = tokens.windows(hashes, width)
    other, _ = tokens.windows(hashes, width, _OTHER_POWERS)
    places = np.arange(len(hashes) - gram + 1)
    grams = mix(rolling(hashes, places, places + gram, _WORD_POWERS))
    span = width - gram + 1
    least = _least(grams, span, np.minimum)[: len(hashes) - width + 1]
    # a place is an anchor's if it holds the least hash of some window that covers it (windows of one row only)
    valid = np.zeros(len(least), bool)
    valid[at] = True
    reach = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(span - 1, np.uint64), reach, np.zeros(span - 1, np.uint64)])
    most = _least(padded, span, np.maximum)[: len(grams)]
    return tokens, at, (whole, other), least[at], grams[most == grams]


def _anchors(docs: DataFrame, text: str, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found, n = np.unique(_windows(part, text, width, gram)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def bits_for(count: int, least: int = 18, most: int = 30) -> int:
    """Bits of a bitmap's width for so many hashes: 16 places for each, 128 MB at most."""
    return min(most, max(least, (16 * max(1, count)).bit_length()))


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap (at most 2**bits bits, whatever the input) of the low bits of 64-bit hashes."""
    words = hashes.select(F.expr(f"cast((`{column}` & {(1 << bits) - 1}) >> 6 as int)").alias("w"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def kept_text(tokens: Tokens, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each row joined by single spaces: bytes and row offsets."""
    lengths = (tokens.stops - tokens.starts)[keep]
    starts = tokens.starts[keep]
    at = np.cumsum(lengths + 1) - (lengths + 1)
    sums = np.concatenate([[0], np.cumsum(keep)])
    first = sums[tokens.first]
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    target = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[target + np.repeat(at, lengths)] = tokens.data[target + np.repeat(starts, lengths)]
    return out, np.append(at, len(out))[first]


def _single_windows(docs: DataFrame, row: str, text: str, width: int, gram: int, table) -> DataFrame:
    """Of the windows that the bitmap lets through, those that start once: (row hash, word places).

    One aggregation counts them and, where the count is one, has the place: nothing is joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                tokens, at, (whole, other), anchor, _ = _windows(part, "t", width, gram)
                hit = np.flatnonzero(in_bitmap(table.value, anchor)) if len(at) else np.zeros(0, np.int64)
                order = hit[np.lexsort((other[hit], whole[hit]))]  # stable: the first place leads
                fresh = np.ones(len(order), bool)
                fresh[1:] = (whole[order[1:]] != whole[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
                lead = np.flatnonzero(fresh)
                first, n = order[lead], np.diff(np.append(lead, len(order)))
                word = at[first]
                of = tokens.row_of(word)
                yield pa.RecordBatch.from_arrays([pa.array(whole[first].view(np.int64)), pa.array(other[first].view(np.int64)), pa.array(n), part.column(0).take(pa.array(of)), pa.array((word - tokens.first[of]).astype(np.int32))], names=["h", "g", "n", "k", "at"])

    windows = docs.select(F.col(f"`{row}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, "h long, g long, n long, k long, at int")
    counted = windows.groupBy("h", "g").agg(F.sum("n").alias("n"), F.min("k").alias("k"), F.min("at").alias("at"))
    return counted.where("n = 1").groupBy("k").agg(F.collect_list("at").alias("single"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35, gram: int = 20, keep: list[str] | None = None, texts: bool = True) -> DataFrame:
    """Add ``n_words``, ``n_removed``, ``kept_sha256`` and, unless ``texts`` is false, ``removed`` (word intervals) and ``kept``.

    ``width`` is the length of a window in words; ``gram`` (shorter) that of the runs that anchors
    are chosen from, and has no bearing on the result. Of the texts only those with a window that may
    repeat are shuffled, to meet their single windows.
    """
    spark = docs.sparkSession
    gram = min(gram, width)
    row, single, waiting = spare(docs, "row", "single", "waiting")
    anchors = written(_anchors(docs, text, width, gram), "anchors")
    table = spark.sparkContext.broadcast(bitmap(anchors, "h", bits_for(anchors.count())))
    discard(anchors)
    marked = docs.withColumn(row, F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")))
    fields = RESULT + [T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept", T.StringType())] * texts
    names = {f.name for f in fields}
    held = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]

    def results(tokens: Tokens, gone: np.ndarray) -> dict[str, pa.Array]:
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = sums[tokens.first[1:]] - sums[tokens.first[:-1]]
        out, at = kept_text(tokens, ~gone)
        raw = out.tobytes()
        bodies = [raw[a : max(a, b - 1)] for a, b in zip(at.tolist(), at[1:].tolist())]
        new = {"n_words": pa.array(tokens.counts.astype(np.int64)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string())}
        if texts:
            runs = []
            for a, b in zip(tokens.first.tolist(), tokens.first[1:].tolist()):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8))).tolist()
                runs.append([[x, y] for x, y in zip(edge[::2], edge[1::2])])
            new |= {"removed": pa.array(runs, pa.list_(pa.list_(pa.int32()))), "kept": pa.array([b.decode() for b in bodies], pa.string())}
        return new

    def first(part: pa.RecordBatch) -> dict[str, pa.Array]:
        """Rows without a window that may repeat are done; the others keep their text for the join."""
        tokens, at, _, anchor, _ = _windows(part, text, width, gram)
        open_ = np.zeros(part.num_rows, bool)
        if len(at):
            open_[tokens.row_of(at[in_bitmap(table.value, anchor)])] = True
        column = part.column(part.schema.get_field_index(text))
        left = column.take(pa.array(np.arange(part.num_rows), mask=~open_))
        return results(tokens, np.zeros(len(tokens.starts), bool)) | {waiting: left}

    def second(part: pa.RecordBatch) -> dict[str, pa.Array]:
        """The windows that may repeat, less those that start once, cover what goes."""
        tokens, at, _, anchor, _ = _windows(part, waiting, width, gram)
        change = np.zeros(len(tokens.starts) + 1, np.int64)
        begin = at[in_bitmap(table.value, anchor)] if len(at) else at
        lists = part.column(part.schema.get_field_index(single))
        rows = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        begin = np.setdiff1d(begin, tokens.first[rows] + lists.flatten().to_numpy(zero_copy_only=False))
        change[begin] += 1
        change[begin + width] -= 1
        gone = np.cumsum(change[:-1]) > 0
        new = results(tokens, gone)
        waited = part.column(part.schema.get_field_index(waiting)).is_valid().to_numpy(zero_copy_only=False)
        pick = pa.array(np.arange(part.num_rows) + np.where(waited, 0, part.num_rows))
        return {n: pa.concat_arrays([new[n].cast(old.type), old]).take(pick) for n in new for old in [part.column(part.schema.get_field_index(n))]}

    started = append(marked, first, [*fields, T.StructField(waiting, T.StringType())], text, [*held, row])
    found = _single_windows(marked, row, text, width, gram, table).withColumnsRenamed({"k": row, "single": single})
    joined = started.join(found, row, "left")
    return append(joined, second, fields, waiting, [*held, *[f.name for f in fields], single]).select(*[F.col(f"`{c}`") for c in held], *[f.name for f in fields])
