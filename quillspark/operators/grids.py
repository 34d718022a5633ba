"""Words into the cells of tables whose boundaries are each page's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import interval_of


def cells(words: DataFrame, keys: list[str], columns: DataFrame, rows: DataFrame, edge: str, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """The text of each cell that holds a word: keys, row, column, text.

    Words have text, left, top, width and height; ``columns`` and ``rows`` have the keys and a boundary in ``edge``, as many as there are.
    A word belongs to the first column and row that hold its centre, ends included (``x`` and ``y``, where these are known
    exactly); outside of all it is left out. A cell's words are joined by blanks in order of whole top, whole left and text.
    """
    centred = words.withColumns({"_x": F.col("left") + F.col("width") / 2 if x is None else x, "_y": F.col("top") + F.col("height") / 2 if y is None else y})
    placed = interval_of(interval_of(centred, keys, "_x", columns, edge, "column").drop(edge), keys, "_y", rows, edge, "row").where("`row` is not null and `column` is not null")
    entry = F.struct(F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"), F.col("text"))
    return placed.groupBy(*keys, "row", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda w: w["text"]), " ").alias("text"))


def dense(found: DataFrame, keys: list[str], columns: DataFrame, rows: DataFrame, edge: str) -> DataFrame:
    """Every cell of every page's grid, empty ones with an empty text."""
    count = lambda df, name: df.where(F.col(edge).isNotNull()).groupBy(*keys).agg((F.count("*") - 1).cast("int").alias(name))
    grid = count(rows, "_rows").join(count(columns, "_columns"), keys).where("_rows > 0 and _columns > 0")
    grid = grid.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("_columns") - 1)))
    return grid.drop("_rows", "_columns").join(found, [*keys, "row", "column"], "left").withColumn("text", F.coalesce("text", F.lit("")))
