"""Running values over keys of any size: a prefix scan in two levels.

A window by key puts all rows of the key into one task. Here rows are dealt to ranges of (key, order), so a key
with very many rows is spread over several ranges. Windows run within a range; of each range one row goes on to
the next: what its last key has summed up, and its last row's values. What is carried is as long as the list of ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch


class Scan:
    """Rows dealt by ranges of ``keys`` and ``order`` (both ascending, nulls first), and running values over them.

    ``order`` should tell the rows of a key apart: rows that tie keep no order among them. Null keys are a key.
    The dealt rows are written once, so a lost executor changes no bounds. Names that begin with ``_scan`` are taken.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None):
        names = [*keys, *order]
        dealt = df.repartitionByRange(ranges, *names) if ranges else df.repartitionByRange(*names)
        path = scratch(df.sparkSession, "scan")
        ready = dealt.withColumn("_scan_range", F.spark_partition_id())
        ready.write.parquet(path)
        self.df = df.sparkSession.read.schema(ready.schema).parquet(path)
        self.keys, self.order = keys, order

    def _next(self, df: DataFrame) -> Scan:
        out = object.__new__(Scan)
        out.df, out.keys, out.order = df, self.keys, self.order
        return out

    def with_columns(self, columns: dict[str, Column]) -> Scan:
        return self._next(self.df.withColumns(columns))

    def _carry(self, total: list[Column], last: list[Column]) -> DataFrame:
        """One row a range: its first key, and what the ranges before it hand to that key (``_scan_sums``, ``_scan_last``)."""
        key = F.struct(*[F.col(c) for c in self.keys])
        edges = self.df.groupBy("_scan_range").agg(F.min(key).alias("_scan_first"), F.max(key).alias("_scan_key"))
        tails = self.df.join(F.broadcast(edges), "_scan_range").where(key.eqNullSafe(F.col("_scan_key")))  # only a range's last key goes on
        ends = tails.groupBy("_scan_range", "_scan_first", "_scan_key").agg(
            F.struct(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(total)], F.count("*").alias("rows")).alias("sums"),
            F.max_by(F.struct(*last, F.lit(True).alias("any")), F.struct(*[F.col(c) for c in self.order])).alias("last"),
        )
        ends = ends.select("_scan_range", "_scan_first", F.struct("_scan_key", "sums", "last").alias("end"))
        same = Window.partitionBy("end._scan_key").orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, 0)
        sums = F.struct(*[F.sum(f"end.sums.s{i}").over(same).alias(f"s{i}") for i in range(len(total))], F.lit(True).alias("any"))
        ends = ends.select("_scan_range", "_scan_first", F.col("end._scan_key").alias("k"), sums.alias("s"), F.col("end.last").alias("l"))
        before = Window.orderBy("_scan_range")  # as many rows as there are ranges
        goes_on = F.lag("k").over(before).eqNullSafe(F.col("_scan_first")) & (F.lag("_scan_range").over(before).isNotNull())
        return ends.select("_scan_range", "_scan_first", F.when(goes_on, F.lag("s").over(before)).alias("_scan_sums"), F.when(goes_on, F.lag("l").over(before)).alias("_scan_last")).where("_scan_sums is not null")

    def _joined(self, total: list[Column], last: list[Column]) -> tuple[DataFrame, Column]:
        carry = self._carry(total, last)
        rows = self.df.join(F.broadcast(carry), "_scan_range", "left")
        return rows, F.struct(*[F.col(c) for c in self.keys]).eqNullSafe(F.col("_scan_first"))

    def running(self, sums: dict[str, Column]) -> Scan:
        """Add the sums of each key's rows up to and with the row; nulls add nothing, and rows before the first value have 0."""
        filled = self.with_columns({f"_scan_s{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())})
        rows, own = filled._joined([F.col(f"_scan_s{i}") for i in range(len(sums))], [])
        local = Window.partitionBy("_scan_range", *self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)
        carried = [F.coalesce(F.when(own, F.col(f"_scan_sums.s{i}")), F.lit(0)) for i in range(len(sums))]
        rows = rows.withColumns({name: F.sum(f"_scan_s{i}").over(local) + carried[i] for i, name in enumerate(sums)})
        return self._next(rows.drop("_scan_first", "_scan_sums", "_scan_last", *[f"_scan_s{i}" for i in range(len(sums))]))

    def previous(self, columns: dict[str, Column], first: str | None = None) -> Scan:
        """Add values of the key's row before, null at the first; ``first`` names a column that says which rows are first."""
        held = self.with_columns({f"_scan_v{i}": c for i, c in enumerate(columns.values())})
        names = [f"_scan_v{i}" for i in range(len(columns))]
        rows, own = held._joined([], [F.col(n).alias(f"v{i}") for i, n in enumerate(names)])
        local = Window.partitionBy("_scan_range", *self.keys).orderBy(*self.order)
        rows = rows.withColumn("_scan_head", F.lag(F.lit(True)).over(local).isNull())
        handed = F.col("_scan_head") & own
        new = {name: F.when(handed, F.col(f"_scan_last.v{i}")).otherwise(F.lag(f"_scan_v{i}").over(local)) for i, name in enumerate(columns)}
        if first:
            new[first] = F.col("_scan_head") & F.coalesce(~(own & F.col("_scan_last").isNotNull()), F.lit(True))
        return self._next(rows.withColumns(new).drop("_scan_first", "_scan_sums", "_scan_last", "_scan_head", *names))

    def rows(self) -> DataFrame:
        return self.df.drop("_scan_range")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Add the running number (from 1) of each row within its key."""
    return Scan(df, keys, order, ranges).running({name: F.lit(1).cast("long")}).rows()


def offsets(df: DataFrame, keys: list[str], order: list[str], length: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Add the sum of the lengths of the key's rows before each row."""
    held = Scan(df.withColumn("_length", length), keys, order, ranges).running({name: F.col("_length")}).rows()
    return held.withColumn(name, F.col(name) - F.coalesce(F.col("_length"), F.lit(0))).drop("_length")


def islands(df: DataFrame, keys: list[str], order: list[str], before: dict[str, Column], joins: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Add the number (from 1) of the run that a row belongs to.

    ``before`` names values of the row before; ``joins`` says in terms of them whether a row goes on with its run (null: no).
    """
    held = Scan(df, keys, order, ranges).previous(before, first="_head")
    starts = F.when(F.col("_head") | ~F.coalesce(joins, F.lit(False)), 1).otherwise(0).cast("long")
    return held.with_columns({"_starts": starts}).running({name: F.col("_starts")}).rows().drop("_starts", "_head", *before)


def joined_text(df: DataFrame, keys: list[str], order: list[str], value: Column, separator: str, name: str, block: int = 4096, ranges: int | None = None) -> DataFrame:
    """One text a key: its values in order with a separator between. Blocks of rows are joined apart, then the blocks of a key."""
    held = numbered(df.select(*keys, *[c for c in order if c not in keys], value.cast("string").alias("_text")).where("_text is not null"), keys, order, "_place", ranges)
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_text"))), lambda s: s["_text"]), separator)
    parts = held.groupBy(*keys, F.expr(f"(_place - 1) div {block}").alias("_block")).agg(part.alias("_text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_text"))), lambda s: s["_text"]), separator)
    return df.select(*keys).distinct().join(parts.groupBy(*keys).agg(whole.alias(name)), keys, "left") if len(keys) else parts.agg(whole.alias(name))


def runs(df: DataFrame, keys: list[str], order: list[str], active: Column, least: int = 3, gap: int = 5, ranges: int | None = None) -> DataFrame:
    """Runs [begin, end) of rows (counted from 0) that are active: those of ``least`` rows or more, joined over gaps of up to ``gap`` rows."""
    on = F.coalesce(active, F.lit(False))
    scan = Scan(df.select(*keys, *[c for c in order if c not in keys], on.alias("_on")), keys, order, ranges).previous({"_was": F.col("_on")})
    scan = scan.running({"_place": F.lit(1).cast("long"), "_run": F.when(F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False)), 1).otherwise(0).cast("long")})
    found = scan.rows().where("_on").groupBy(*keys, "_run").agg((F.min("_place") - 1).alias("begin"), F.max("_place").alias("end")).where(F.col("end") - F.col("begin") >= least)
    near = F.col("begin") - F.col("_end") <= gap
    joined = islands(found, keys, ["begin"], {"_end": F.col("end")}, near, "_joined", ranges)
    return joined.groupBy(*keys, "_joined").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_joined")


#: Keys are counted by buckets of a hash; those of a bucket with no more bounds than this, or than 16 times the mean, have theirs in an array.
FEW = 4096
_BUCKETS = 1 << 20


def interval_of(points: DataFrame, keys: list[str], value: str, bounds: DataFrame, bound: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the index (from 0) of the interval between neighbouring bounds of the key that holds the value, ends included.

    On a bound between two intervals the first holds it. Null for values outside of all, and where the key has fewer than two
    bounds. Keys with few bounds have them in an array that their points meet by a join; of the others points and bounds are
    sorted together, so an interval's index is the number of bounds passed.
    """
    spark = points.sparkSession
    path = scratch(spark, "bounds")
    marks = bounds.select(*keys, F.col(bound).cast("double").alias("_at")).where("_at is not null")
    marks.write.parquet(path)
    marks = spark.read.schema(marks.schema).parquet(path)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).cast("int")
    limit = max(FEW, 16 * marks.count() // _BUCKETS)
    path = scratch(spark, "buckets")
    marks.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_bucket").write.parquet(path)
    many = spark.read.schema("_bucket int").parquet(path)
    if many.isEmpty():
        return _interval_by_array(points, keys, value, marks, name)
    split = lambda df, how: df.withColumn("_bucket", bucket).join(many, "_bucket", how).drop("_bucket")
    by_array = _interval_by_array(split(points, "left_anti"), keys, value, split(marks, "left_anti"), name)
    return by_array.unionByName(_interval_by_scan(split(points, "left_semi"), keys, value, split(marks, "left_semi"), name, ranges))


def _with_key(points: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """Points with the row of their key, null keys being a key."""
    per = per.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & points[k].eqNullSafe(per[f"_key{i}"])
    return points.join(per, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def _interval_by_array(points: DataFrame, keys: list[str], value: str, marks: DataFrame, name: str) -> DataFrame:
    held = _with_key(points, marks.groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_bounds")), keys)
    at = F.col(value).cast("double")
    passed, size = F.size(F.filter("_bounds", lambda b: b < at)), F.size("_bounds")
    index = F.when(at == F.get("_bounds", F.lit(0)), 0).when(passed > 0, passed - 1)
    return held.withColumn(name, F.when((passed < size) & (size > 1), index).cast("int")).drop("_bounds")


def _interval_by_scan(points: DataFrame, keys: list[str], value: str, marks: DataFrame, name: str, ranges: int | None) -> DataFrame:
    both = points.withColumn("_at", F.col(value).cast("double")).withColumn("_kind", F.lit(0)).unionByName(marks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    passed = Scan(both, keys, ["_at", "_kind"], ranges).running({"_passed": F.col("_kind").cast("long")}).rows().where("_kind = 0")
    held = _with_key(passed, marks.groupBy(*keys).agg(F.count("*").alias("_bounds"), F.min("_at").alias("_least")), keys)
    index = F.when(F.col("_at") == F.col("_least"), 0).when(F.col("_passed") > 0, F.col("_passed") - 1)
    inside = (F.col("_passed") < F.col("_bounds")) & (F.col("_bounds") > 1)
    return held.withColumn(name, F.when(inside, index).cast("int")).drop("_at", "_kind", "_passed", "_bounds", "_least")
