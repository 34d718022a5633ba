"""Metric tables: grouped means, guarded rates, grains, macro scores, crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate


def means(df: DataFrame, keys: list[str], columns: dict[str, Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """Row count and rounded means (booleans count as 0 and 1) by keys; no keys: one row."""
    aggs = [F.count("*").alias("n")] + [F.round(F.avg(c.cast("double")), 6).alias(name) for name, c in columns.items()]
    aggs += [F.round(F.sum(c), 2).alias(name) for name, c in (sums or {}).items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def grains(df: DataFrame, fine: list[str], coarse: list[str], columns: dict[str, Column]) -> DataFrame:
    """The same means at two grains in one pass (GROUPING SETS); ``is_total`` marks the coarse one."""
    dropped = [c for c in fine if c not in coarse]
    sets = [[F.col(c) for c in fine], [F.col(c) for c in coarse]]
    return df.groupingSets(sets, *[F.col(c) for c in fine]).agg((F.grouping(dropped[0]) == 1).alias("is_total"), F.count("*").alias("n"), *[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in columns.items()])


DETECTION_METRICS = ["precision", "recall", "f1", "redaction_coverage", "missed_redaction_rate", "false_redaction_rate", "action_accuracy", "mean_containment", "mean_latency"]


def detection_scores(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Detection and redaction metrics; null keys are kept.

    Input: ``expected`` and ``predicted`` (booleans), ``expected_action`` and ``predicted_action`` (null
    where there is none), ``containment`` and ``latency``. Coverage is the share of expected redactions
    that are found and redacted (1 where none is expected), its complement is what is missed; false
    redactions are counted among predicted ones; actions are right or wrong on all expected entities.
    """
    e, p = F.col("expected"), F.col("predicted")
    redact, redacted = e & (F.col("expected_action") == "redact"), F.coalesce(F.col("predicted_action") == "redact", F.lit(False))
    right = p & F.coalesce(F.col("predicted_action") == F.col("expected_action"), F.lit(False))
    counts = {"tp": e & p, "fp": ~e & p, "fn": e & ~p, "to_redact": redact, "covered": redact & p & redacted, "redacted": redacted, "wrongly": ~e & redacted, "right": e & right, "wanted": e}
    sums = [F.count_if(c).alias(name) for name, c in counts.items()]
    means = [F.coalesce(F.avg(F.when(e & p, F.col("containment"))), F.lit(0.0)).alias("mean_containment"), F.avg("latency").alias("mean_latency")]
    counted = outcomes.groupBy(*keys).agg(F.count("*").alias("rows"), *sums, *means)
    c = F.col
    precision, recall, coverage = rate(c("tp"), c("tp") + c("fp")), rate(c("tp"), c("tp") + c("fn")), rate(c("covered"), c("to_redact"), 1.0)
    rates = {"precision": precision, "recall": recall, "redaction_coverage": coverage, "missed_redaction_rate": 1 - coverage, "false_redaction_rate": rate(c("wrongly"), c("redacted")), "action_accuracy": rate(c("right"), c("wanted"), 1.0)}
    scored = counted.withColumns(rates).withColumn("f1", rate(2 * c("precision") * c("recall"), c("precision") + c("recall")))
    return scored.select(*keys, "rows", "tp", "fp", "fn", *DETECTION_METRICS)


def weighted(scores: DataFrame, keys: list[str], metrics: list[str], weight: str) -> DataFrame:
    """Means of group metrics weighted by rows; not pooled."""
    w = F.col(weight)
    aggs = [F.round(F.sum(F.col(m) * w) / F.greatest(F.sum(w), F.lit(1)), 6).alias(m) for m in metrics]
    return scores.groupBy(*keys).agg(F.sum(w).alias(weight), *aggs) if keys else scores.agg(F.sum(w).alias(weight), *aggs)


def macro_f1(df: DataFrame, expected: str, predicted: str, labels: list) -> DataFrame:
    """Accuracy and macro-F1 over a given list of labels, one pass over the rows."""
    e, p = F.col(expected), F.col(predicted)
    f1 = [rate(2.0 * F.count_if((e == x) & (p == x)), F.count_if(e == x) + F.count_if(p == x)) for x in labels]
    return df.agg(F.count("*").alias("n"), F.round(rate(F.count_if(e == p), F.count("*")), 6).alias("accuracy"), F.round(sum(f1[1:], f1[0]) / len(labels), 6).alias("macro_f1"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with one column for each of the given values, 0 where there is none."""
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def status_histogram(df: DataFrame, key: str) -> DataFrame:
    """Counts by value as one map."""
    counts = df.groupBy(key).count()
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("count").alias("n"))))).alias("status_counts"))


def latency_buckets(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """A cumulative histogram: one pass, then one row for each bound."""
    counts = df.groupBy(*keys).agg(*[F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)])
    return counts.select(*keys, F.inline(pairs))
