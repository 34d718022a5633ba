"""Exact interpolated percentiles of groups of any size, without a buffer that holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch
from .scans import Scan

#: Cells of a group's histogram.
CELLS = 1024


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def percentiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """One row a group (one in all without keys): keys and, for each name, the value at that share of the way from least to greatest.

    Three passes over the rows. The first finds each group's number of values, least and greatest; the second counts its
    values in cells of equal width, of which a window over cells picks those that hold the ranks asked for; the third
    counts the different values in these cells only, and a scan over them finds the ranks. Each pass combines rows before the shuffle.
    However the values are spread, the rows of a full cell are dealt by ranges. Nulls don't count; a group of nulls has null.
    Values are doubles; infinite ones share a cell with all others, and NaN is greater than any.
    """
    rows = df.select(*keys, value.cast("double").alias("_v"))
    limits = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if not keys:
        limits = limits.withColumn("_one", F.lit(1))
        rows, keys, single = rows.withColumn("_one", F.lit(1)), ["_one"], True
    else:
        single = False
    limits = _kept(limits, "limits")
    wide = F.col("_hi") - F.col("_lo")
    cell = F.when((wide > 0) & (wide < float("inf")), F.least(F.lit(CELLS - 1), F.floor((F.col("_v") - F.col("_lo")) / wide * CELLS))).otherwise(F.lit(0)).cast("int")
    placed = rows.where("_v is not null").join(limits, _same(rows, limits, keys)).select(*[rows[k] for k in keys], "_v", cell.alias("_cell"))
    held = placed.groupBy(*keys, "_cell").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as cells
    held = _kept(held.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))), "cells")

    at = [(F.lit(s) * (F.col("_n") - 1)) for s in shares.values()]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a).cast("long"), F.ceil(a).cast("long")) for a in at])))
    asked = limits.where("_n > 0").select(*keys, F.explode(ranks).alias("_rank"))
    cells = asked.join(held, _same(asked, held, keys)).where("_before <= _rank and _rank < _before + _c").select(*[asked[k] for k in keys], "_cell", "_rank", "_before")
    cells = _kept(cells, "ranks")
    chosen = cells.select(*keys, "_cell").distinct()
    values = placed.join(chosen, _same(placed, chosen, keys) & (placed["_cell"] == chosen["_cell"]), "left_semi").groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_c"))
    upto = Scan(values, [*keys, "_cell"], ["_v"]).running({"_upto": F.col("_c")}).rows()
    hit = upto.join(cells, _same(upto, cells, keys) & (upto["_cell"] == cells["_cell"])).where("_rank - _before >= _upto - _c and _rank - _before < _upto")
    found = hit.groupBy(*[upto[k] for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"))  # two ranks a share
    out = limits.join(found, _same(limits, found, keys), "left")

    def share(a: Column) -> Column:
        low, high = F.element_at("_values", F.floor(a).cast("long")), F.element_at("_values", F.ceil(a).cast("long"))
        return F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a)))

    named = [share(a).alias(name) for a, name in zip(at, shares)]
    return out.select(*([] if single else [limits[k] for k in keys]), *named)
