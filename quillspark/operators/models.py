"""Linear classification of feature vectors with balanced classes: split, fit, kept models, scores."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(rows: DataFrame, group: Column, held_out: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, rows held out): one group of ``held_out`` is held out, by its checksum, so no group is on both sides."""
    out = F.crc32(F.coalesce(group.cast("string"), F.lit(""))) % held_out == 0
    return rows.where(~out), rows.where(out)


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def _training(train: DataFrame, vector: str, label: str) -> DataFrame:
    """Features, labels and weights (``_w``), spread over all cores.

    Classes are few, so their weights are broadcast: a shuffled join would leave as many parts as there are shuffle
    partitions, each of them a task of every pass of every class.
    """
    sizes = train.groupBy(label).agg(F.count("*").alias("_c"))  # as many rows as classes
    totals = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weights = sizes.join(totals).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("_w"))
    parts = max(train.sparkSession.sparkContext.defaultParallelism, train.rdd.getNumPartitions())
    weighted = train.select(vector, label).repartition(parts).join(F.broadcast(weights), label)
    return _vectors(weighted, vector).withColumn("label", F.col(label).cast("double"))


def fit(train: DataFrame, vector: str, label: str, **options) -> PipelineModel:
    """One-against-rest linear support vectors, classes weighted by their inverse frequency; labels are numbers from 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest

    svc = LinearSVC(**{"maxIter": 20, "regParam": 0.01, **options})
    return Pipeline(stages=[OneVsRest(classifier=svc, weightCol="_w", parallelism=4)]).fit(_training(train, vector, label))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify(model: PipelineModel, rows: DataFrame, vector: str) -> DataFrame:
    """Add ``prediction``, ``confidence`` (the softmax of the best decision) and ``margin`` (best less second; 0 with one class)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_vectors(rows, vector)).withColumn("_s", F.sort_array(vector_to_array("rawPrediction"), asc=False))
    best = F.get("_s", F.lit(0))
    weight = F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    margin = best - F.coalesce(F.get("_s", F.lit(1)), best)
    return scored.withColumns({"confidence": 1 / weight, "margin": margin}).drop("_s", "features", "rawPrediction")
