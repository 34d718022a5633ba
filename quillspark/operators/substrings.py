"""Which of very many strings a text contains: an index of the strings by their rarest run of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch

LONGEST = 32  # bytes of the longest runs; runs have lengths of powers of two
_BITS = 26  # bits of the number of places in the largest bitmap: 8 MB
_SLICE = 1 << 19  # bytes of text that are hashed together
_RNG = np.random.Generator(np.random.PCG64(77))
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(1, 1 << 63, 8, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` bytes, a power of two: runs of twice the length from pairs of runs."""
    h = _VALUES[data]
    for level in range(width.bit_length() - 1):
        k = 1 << level
        h = h[:-k] * _FACTORS[level] + h[k:]
    return h * _FACTORS[7] + np.uint64(width)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with the bytes of their strings and the offsets of these; a slice has one row or up to ``_SLICE`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        floor = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, floor + _SLICE, side="right")))
        part = batch.slice(begin, stop - begin)
        raw = b"".join(s.encode() for s in pc.fill_null(part.column(column), "").to_pylist())
        yield part, np.frombuffer(raw, np.uint8), np.concatenate([[0], ends[begin:stop] - floor])
        begin = stop


def _runs(needles: DataFrame) -> DataFrame:
    """(_id, _width, _gram): the hashes of all runs of each needle of the length that is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in _slices(batch, 1):
                for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    width = 1 << (min(b - a, LONGEST).bit_length() - 1)
                    grams = np.unique(_hashes(data[a:b], width)).view(np.int64)
                    ids = pa.array(np.full(len(grams), part.column(0)[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(grams), width, np.int32)), pa.array(grams)], names=["_id", "_width", "_gram"])

    return needles.select("_id", "_needle").mapInArrow(run, "_id long, _width int, _gram long")


def _bitmaps(runs: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length of runs the bits of a place's number, and a bitmap of the places that runs have: at most 2 ** ``_BITS`` bits."""
    out = {}
    for width, n in sorted(map(tuple, runs.groupBy("_width").agg(F.count("*")).collect())):  # at most six lengths
        bits = min(_BITS, max(13, (16 * n).bit_length()))
        place = F.shiftrightunsigned("_gram", 64 - bits)
        words = runs.where(F.col("_width") == width).groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_gram, {64 - bits}) & 63 as int))")).alias("b")).toArrow()
        taken = np.zeros(1 << (bits - 6), np.int64)
        taken[words.column("w").to_numpy()] = words.column("b").to_numpy()
        out[width] = bits, taken.view(np.uint8)
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _held(rows: DataFrame, bitmaps: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """(_key, _gram): the distinct runs of each text that have a place in the bitmaps; one narrow stage."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in _slices(batch, 1):
                for width, (bits, taken) in shared.value.items():
                    if len(data) < width:
                        continue
                    grams = _hashes(data, width)
                    place = grams >> np.uint64(64 - bits)
                    hit = np.flatnonzero(taken[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                    row = np.searchsorted(at, hit, side="right") - 1
                    inside = hit + width <= at[row + 1]  # not across the end of a text
                    found = np.unique(np.stack([row[inside], grams[hit[inside]].view(np.int64)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1])], names=["_key", "_gram"])

    return rows.select("_key", "_text").mapInArrow(run, T.StructType([rows.schema["_key"], T.StructField("_gram", T.LongType())]))


def first_contained(texts: DataFrame, key: str, text: str, needles: DataFrame, needle: str, order: str, name: str) -> DataFrame:
    """Add the least ``order`` of the needles that the text contains, null where there is none; ``key`` tells texts apart.

    A needle is looked for under one of its runs of bytes (as long as the greatest power of two that its length and ``LONGEST``
    allow), the one that the fewest texts have; texts that have it are compared. Needles are a table of any size: a bitmap of
    bounded size tells which runs of a text may be a needle's, only these leave the text, and no text meets a needle that it
    shares no such run with. An empty needle is in every text but null; null needles and orders take no part.
    """
    known = needles.select(F.col(needle).alias("_needle"), F.col(order).alias("_order")).dropna().groupBy("_needle").agg(F.min("_order").alias("_order"))
    known = _written(known.withColumn("_id", F.monotonically_increasing_id()), "needles")
    everywhere = known.where("_needle = ''").agg(F.min("_order").alias("_every"))
    out = texts.join(everywhere).withColumn("_every", F.when(F.col(text).isNotNull(), F.col("_every")))
    runs = _written(_runs(known.where("_needle <> ''")), "runs")
    bitmaps = _bitmaps(runs)
    if not bitmaps:
        return out.withColumn(name, F.col("_every")).drop("_every")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    met = _written(_held(rows, bitmaps).join(runs.select("_gram").distinct(), "_gram", "left_semi"), "met")
    counts = met.groupBy("_gram").agg(F.count("*").alias("_texts"))
    # a needle that has a run which no text has is in no text
    rarest = runs.join(counts, "_gram", "left").groupBy("_id").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "_gram")).alias("g"))
    index = rarest.where("g.n > 0").select("_id", F.col("g._gram").alias("_gram"))
    # written tables have a known size: where they are small, texts meet them without a shuffle
    pairs = _written(met.join(index, "_gram").join(known, "_id").select("_key", "_needle", "_order"), "pairs")
    found = _written(pairs.join(rows, "_key").where(F.contains("_text", "_needle")).groupBy("_key").agg(F.min("_order").alias("_found")), "found")
    out = out.join(found, out[key] == found["_key"], "left").drop("_key")
    return out.withColumn(name, F.least("_found", "_every")).drop("_found", "_every")
