"""Joins that Spark has no keyword for: ranges, bands, nearest values, substrings, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within_range(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, index: str, width: float) -> DataFrame:
    """Each point with the least ``index`` of the ranges that hold it, ends included; null where there is none.

    A range join as an equi-join: ranges are dealt to every cell of ``width`` that they touch, points to
    their own, so the join hashes on cells and never compares all with all. The match is chosen in
    the aggregation of (cell, point value), before it meets the points.
    """
    cell = lambda c: F.floor(c / width)
    dealt = ranges.select(F.col(low).alias("_lo"), F.col(high).alias("_hi"), F.col(index).alias("_ix"), F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))).alias("_cell"))
    values = points.select(F.col(point).alias("_p")).where("_p is not null").distinct().withColumn("_cell", cell(F.col("_p")))
    match = values.join(dealt, "_cell").where("_lo <= _p and _p <= _hi").groupBy("_p").agg(F.min("_ix").alias(index))
    return points.join(match, points[point] == match["_p"], "left").drop("_p")


#: Rows of a cell that one task compares with the rows of another.
BLOCK = 1 << 14


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on ``on`` for rows that meet very many others.

    The pairs are the work, however few bytes the rows have: rows are dealt to a fixed number of tasks, which neither a
    broadcast nor the merging of small partitions undoes. Right rows of a key are dealt to blocks of about
    ``BLOCK`` rows, and left rows to each of them, so a hot key is spread and what a task holds is bounded.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    many = right.groupBy(*on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).where("_blocks > 1")
    number = F.coalesce("_blocks", F.lit(1))
    dealt = right.join(many, on, "left").withColumn("_block", F.pmod(F.xxhash64(*right.columns), number).cast("int")).drop("_blocks")
    asked = left.join(many, on, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), number - 1))).drop("_blocks")
    by = [*on, "_block"]
    return asked.repartition(tasks, *by).join(dealt.repartition(tasks, *by).hint("merge"), by).drop("_block")


def _cell(value: Column, width: float) -> Column:
    """Numbers of cells just wider than half of ``width``: values no further apart than that, as doubles have it, lie in cells at most two apart."""
    number = value / (width / 2 * (1 + 1e-6))
    return F.floor(F.greatest(F.least(number, F.lit(4e18)), F.lit(-4e18)))  # infinite values have a cell too


def band(left: DataFrame, a: str, right: DataFrame, b: str, width: float) -> DataFrame:
    """Pairs with abs(a - b) <= width: each left row meets five cells of the right side only."""
    cells = left.withColumn("_cell", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda k: _cell(F.col(a), width) + k)))
    return _met(cells, right.withColumn("_cell", _cell(F.col(b), width)), ["_cell"]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_cell")


def band_within(df: DataFrame, keys: list[str], order: str, value: str, width: float) -> DataFrame:
    """Pairs (``a``, ``b``) of one table's ``order``, a < b, of equal ``keys`` and with values no further apart than ``width``.

    Each row meets its own cell and the two above it, so a pair of two cells is met once, from below.
    """
    cells = df.select(*keys, F.col(order).alias("_o"), F.col(value).alias("_v"), _cell(F.col(value), width).alias("_cell"))
    below = cells.select(*keys, F.col("_o").alias("_p"), F.col("_v").alias("_w"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("_cell") + k)).alias("_up", "_cell"))
    met = _met(below, cells, [*keys, "_cell"]).where((F.abs(F.col("_v") - F.col("_w")) <= width) & ((F.col("_p") < F.col("_o")) | ((F.col("_up") > 0) & (F.col("_p") > F.col("_o")))))
    return met.select(F.least("_p", "_o").alias("a"), F.greatest("_p", "_o").alias("b"))


def nearest_value(points: DataFrame, point: str, values: Column) -> DataFrame:
    """The value of a sorted literal array nearest to each point, the first on ties (``nearest``)."""
    best = F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - F.col(point)).alias("d"), i.alias("i"))))
    return points.withColumn("nearest", F.get(values, best["i"]))


def cyclic(records: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` rows that go round the records in order: row i has record i mod count. Column ``i`` from 0."""
    from pyspark.sql import Window

    # rows beyond the first n are never asked for: only these are numbered
    numbered = records.orderBy(order).limit(n).withColumn("_k", F.row_number().over(Window.orderBy(order)) - 1)
    rows = records.sparkSession.range(n).withColumnRenamed("id", "i")
    rows = rows.withColumn("_k", (F.col("i") % F.lit(max(1, numbered.count()))).cast("int"))
    return rows.join(numbered, "_k").drop("_k")


def overlapping(left: DataFrame, lb: str, le: str, right: DataFrame, rb: str, re: str, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals [begin, end) of one key that share a place; the other columns of both sides must differ in name.

    Both sides are dealt to the cells of ``width`` that they touch; a pair that meets in several is taken in the first of
    these. Nothing is collected by key, and an interval meets only those near it. Empty intervals meet nothing.
    """

    def dealt(df: DataFrame, b: str, e: str, cell: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(b) / width), F.floor((F.col(e) - 1) / width))
        return df.where(F.col(b) < F.col(e)).withColumn("_cell", F.explode(cells)).withColumn(cell, F.floor(F.col(b) / width))

    met = dealt(left, lb, le, "_first_l").join(dealt(right, rb, re, "_first_r"), [*keys, "_cell"])
    return met.where((F.col("_cell") == F.greatest("_first_l", "_first_r")) & (F.col(lb) < F.col(re)) & (F.col(rb) < F.col(le))).drop("_cell", "_first_l", "_first_r")
