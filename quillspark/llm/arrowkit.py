"""Arrow and numpy helpers shared by the operators that work on batches of text.

Everything here works on bounded slices of a record batch (``SLICE_BYTES`` of text, or one row if a
single text is longer), so the memory of a Python worker does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 2 << 20

U64 = np.uint64


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets (rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    at = at.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows that hold at most ``most`` bytes of ``text`` each."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        floor = ends[begin - 1] if begin else 0
        stop = min(begin + rows, max(begin + 1, int(np.searchsorted(ends, floor + most, side="right"))))
        yield batch.slice(begin, stop - begin)
        begin = stop


def release() -> None:
    """Give memory that a task has freed back to the system: workers stay for later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` but for those that an operator is about to write (Spark compares without case)."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that clash with none of ``df`` (compared without case)."""
    taken = {n.lower() for n in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def append(df: DataFrame, compute: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField], text: str, keep: list[str] | None = None, choose: Callable | None = None) -> DataFrame:
    """Add columns computed from slices of record batches; one narrow stage, no shuffle.

    ``keep`` names the input columns to return (all by default). An input column that has the name of
    a new one is replaced by it. ``choose`` maps the new columns to a boolean mask of rows to keep.
    """
    fresh = [f.name for f in fields]
    kept = [c for c in (without(df, fresh) if keep is None else keep) if c.lower() not in {n.lower() for n in fresh}]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                new = compute(part)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                columns += [pa.array(new[f.name], arrow.field(f.name).type) if not isinstance(new[f.name], pa.Array) else new[f.name] for f in fields]
                out = pa.RecordBatch.from_arrays(columns, names=[*kept, *fresh])
                yield out.filter(pa.array(choose(new), pa.bool_())) if choose else out
        release()

    need = list(dict.fromkeys([*kept, text, *(c for c in (keep or []) if c not in kept)]))
    return df.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that every bit depends on every other."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def rolling(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, powers: Powers) -> np.ndarray:
    """Rabin-Karp: the polynomial hash of ``values[s:e]`` for each s, e, from one prefix sum."""
    up, down = powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[stops] - total[starts]) * down[starts]


_RNG = np.random.Generator(np.random.PCG64(20240117))
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
_WORD_POWERS = Powers(0xD6E8FEB86659FD93)
_OTHER_POWERS = Powers(0xA0761D6478BD642F)


class Tokens:
    """Words of many texts at once.

    ``starts`` and ``stops`` are byte positions in ``data``; ``first`` (rows + 1) says which words
    belong to which row. ``member`` is a table of 256 booleans: the bytes that words consist of.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = member[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        self.inside = inside
        self.starts, self.stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; ``fold`` maps bytes first (to lower case, say)."""
        table = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
        if not len(self.starts):
            return np.zeros(0, U64)
        return mix(rolling(table[self.data], self.starts, self.stops, _BYTE_POWERS) + (self.stops - self.starts).astype(U64))

    def windows(self, hashes: np.ndarray, width: int, powers: Powers = _WORD_POWERS) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of each run of ``width`` words within one row, and the index of its first word."""
        last = np.repeat(self.first[1:], self.counts) - width
        at = np.flatnonzero(np.arange(len(hashes)) <= last)
        return mix(rolling(hashes, at, at + width, powers)), at

    def row_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, side="right") - 1


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A membership table of the given byte ranges, ends included."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def shared_path(spark, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder, which all executors share.

    The setting is read from the session. Where it is absent a default is set for a local master, as in
    tests; a cluster has no folder that would do.
    """
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quillspark/" in file:
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
