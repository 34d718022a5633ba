"""Conditions of degradation benchmarks and balanced training cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the conditions that benchmarks are run under.
CONDITIONS = ["clean", "rotation_1_5deg", "gaussian_blur", "gaussian_noise", "low_contrast", "directional_shadow", "jpeg_compression", "combined_moderate"]


def catalogue(spark: SparkSession) -> DataFrame:
    """(pos, condition)."""
    return spark.createDataFrame(list(enumerate(CONDITIONS)), "pos int, condition string")


def under_conditions(rows: DataFrame) -> DataFrame:
    """Each row under each condition; a fixed list, so a projection and not a join."""
    return rows.select("*", F.explode(F.array(*[F.lit(c) for c in CONDITIONS])).alias("condition"))


def balanced(rows: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """``n`` rows of each class, going round the class's rows in order; ``copy`` numbers the rounds.

    Only a class's first ``n`` rows are ever numbered: they are chosen in parts (by a hash of the order)
    and then among the parts' first ``n``, so that no class meets whole in one task.
    """
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n")).withColumnRenamed(label, "_label")
    part = F.pmod(F.xxhash64(order), F.lit(64))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy(label, part).orderBy(order))).where(F.col("_k") <= n)
    numbered = first.withColumn("_k", F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1)
    joined = numbered.join(sizes, F.col(label) == F.col("_label")).drop("_label")
    rounds = F.floor((F.lit(n - 1) - F.col("_k")) / F.col("_n")).cast("int")
    return joined.where(F.col("_k") < n).withColumn("copy", F.explode(F.sequence(F.lit(0), rounds))).drop("_k", "_n")


def draws(rows: DataFrame, key: str, low: float, high: float, seed: int) -> DataFrame:
    """A uniform number for each row that depends on its key and the seed only."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) / float(1 << 52)
    return rows.withColumn("draw", low + (high - low) * u)
