"""Names that resemble each other, by Ratcliff-Obershelp ratio, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extract import similarity


def _letters(name: Column) -> Column:
    """The multiset of a name's letters as a set: each letter with the number of its occurrence."""
    each = F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0))
    return F.flatten(F.transform(F.array(each), lambda c: F.transform(c, lambda x, i: F.concat(x, F.size(F.filter(F.slice(c, F.lit(1), i + 1), lambda y: y == x)).cast("string")))))


def similar(values: DataFrame, value: str, known: DataFrame, name: str, least: float = 0.72) -> DataFrame:
    """All pairs of a value and a known name whose ratio is at least ``least``: value, known, ratio. Equal ones are one.

    The ratio is 2 M / (m + n), and M, the letters in matching blocks, is at most what both have in common as multisets.
    So lengths bound partners (m at least ``least`` / (2 - ``least``) of n), and of a name's letters, rarest first, a
    prefix must hold one of the partner's. Names meet on letters of their prefixes only, those with too few letters in common go,
    and the ratio itself is computed for the rest. Nulls and empty names are similar to nothing. Names are short: a name costs the
    square of its length.
    """
    part = least / (2 - least)
    one = lambda df, c, side: df.select(F.col(c).cast("string").alias("s")).where("s <> ''").distinct().withColumn("side", F.lit(side))
    names = one(values, value, 0).unionByName(one(known, name, 1)).withColumn("letters", _letters(F.col("s"))).withColumn("n", F.size("letters"))
    spread = names.select("s", "side", "n", F.explode("letters").alias("letter"))
    counts = spread.groupBy("letter").agg(F.count("*").alias("c"))
    rarest = Window.partitionBy("s", "side").orderBy("c", "letter")  # as many rows as a name has letters
    prefix = spread.join(counts, "letter").withColumn("r", F.row_number().over(rarest)).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * part - 1e-9) + 1)
    a = prefix.where("side = 0").select("letter", F.col("s").alias("a"), F.col("n").alias("na"))
    b = prefix.where("side = 1").select("letter", F.col("s").alias("b"), F.col("n").alias("nb"))
    near = (F.col("nb") >= F.col("na") * part - 1e-9) & (F.col("na") >= F.col("nb") * part - 1e-9)
    pairs = a.join(b, "letter").where(near).select("a", "b").distinct()
    held = names.select("s", "side", "letters")
    both = pairs.join(held.where("side = 0").select(F.col("s").alias("a"), F.col("letters").alias("la")), "a").join(held.where("side = 1").select(F.col("s").alias("b"), F.col("letters").alias("lb")), "b")
    enough = 2.0 * F.size(F.array_intersect("la", "lb")) >= least * (F.size("la") + F.size("lb")) - 1e-9
    scored = both.where(enough).select("a", "b", similarity("a", "b").alias("ratio"))
    return scored.where(F.col("ratio") >= least).select(F.col("a").alias("value"), F.col("b").alias("known"), "ratio")


def resolved(values: DataFrame, value: str, known: DataFrame, name: str, out: str, least: float = 0.72) -> DataFrame:
    """Add the known name that resembles each value most (of equal ones the least), null where none does enough."""
    best = similar(values, value, known, name, least).groupBy("value").agg(F.min_by("known", F.struct(-F.col("ratio"), "known")).alias("_best"))
    return values.join(best.withColumnRenamed("value", "_value"), F.col(value).cast("string") == F.col("_value"), "left").withColumnRenamed("_best", out).drop("_value")
