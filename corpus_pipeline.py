"""A corpus pipeline of five operators: each stage works on all rows that its predecessor kept.

``run`` applies the stages to ``documents``; between stages the rows are written as Parquet and read
again. Stages keep the columns of ``documents`` (``n_chars`` follows the text) but for the last one,
which gives the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, ngram_join, pieces, quality, secrets
from quillspark.llm.arrowkit import written
from quillspark.llm.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    scorer = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, scorer, keep=docs.columns, only_kept=True).select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, share=(8, 10))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.where("not contaminated").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    masked = secrets.mask_secrets(secrets.find_secrets(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; the round trip is checked for each."""
    import public_tokenizers

    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source", "n_chars"])
    return coded.select("doc_id", "lang", "source", "n_chars", "n_pieces", "ids_sha256", "round_trip", "piece_ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: A fitted classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
