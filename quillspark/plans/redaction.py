"""Redaction: detectors, policy, deduplication, masks, audit and verification over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import redact
from .registry import query, table

_FOUND = " UNION ALL ".join(
    rf"SELECT doc_id, n_chars, {i} AS d, '{kind}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS detected_text, unnest(generate_series(1, len(regexp_extract_all(text, '{p}')))) AS k FROM documents"
    for i, (kind, p) in enumerate([("EMAIL", patterns.EMAIL), ("PHONE_NUMBER", patterns.PHONE), ("PERSON", patterns.ASCII_PERSON)])
)
_POLICY = "(VALUES ('EMAIL', 'redact', 0.9), ('PHONE_NUMBER', 'redact', 0.9), ('PERSON', 'redact', 0.75)) p(entity_type, rule_action, least)"
_RESOLVED = f"""SELECT doc_id, entity_type, detected_text, d, k, confidence, CASE WHEN confidence < least THEN 'review' ELSE rule_action END AS action, confidence < least OR confidence < 0.72 AS needs_review
    FROM (SELECT *, 0.7 + (n_chars % 30) / 100.0 AS confidence FROM ({_FOUND})) JOIN {_POLICY} USING (entity_type)"""


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    confidence = 0.7 + F.col("n_chars") % 30 / 100.0
    return redact.detect(docs, "text", confidence, redact.DOCUMENT_DETECTORS).drop("text", "n_chars")


@query(f"""SELECT entity_type, action, count(*) AS n, count(DISTINCT doc_id) AS docs, count(*) FILTER (needs_review) AS reviews, sha256(min(detected_text)) AS first_sha256
    FROM ({_RESOLVED} QUALIFY row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY confidence DESC, d, k) = 1) GROUP BY 1, 2""")
def w4_redaction_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Detect, deduplicate, resolve by policy, count. Texts are left behind at the scan; what is shuffled are matches."""
    best = redact.keep_best(_detected(spark, sf), ["doc_id", "entity_type"])
    resolved = redact.resolve(best)
    return resolved.groupBy("entity_type", "action").agg(
        F.count("*").alias("n"),
        F.count_distinct("doc_id").alias("docs"),
        F.count_if("needs_review").alias("reviews"),
        F.sha2(F.min("detected_text"), 256).alias("first_sha256"),
    )


@query(f"SELECT doc_id, entity_type, action, count(*) AS n FROM ({_RESOLVED}) GROUP BY 1, 2, 3")
def prj16_policy(spark: SparkSession, sf: str) -> DataFrame:
    return redact.resolve(_detected(spark, sf)).groupBy("doc_id", "entity_type", "action").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, entity_type, sha256(detected_text) AS text_sha256, CASE WHEN length(t) = 0 THEN '' WHEN length(t) <= 2 THEN repeat('*', length(t)) ELSE t[1] || repeat('*', least(length(t) - 2, 12)) || t[-1:] END AS masked_text
    FROM (SELECT *, trim(detected_text) AS t FROM ({_FOUND}))""")
def prj19_audit(spark: SparkSession, sf: str) -> DataFrame:
    return redact.audit(_detected(spark, sf)).select("doc_id", "entity_type", "text_sha256", "masked_text")


@query(f"SELECT doc_id, arg_max(detected_text, k) AS detected_text FROM ({_FOUND}) WHERE entity_type = 'PERSON' GROUP BY 1")
def a26_regex_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    persons = redact.detect(table(spark, sf, "documents").select("doc_id", "text"), "text", F.lit(1.0), [("PERSON", patterns.ASCII_PERSON)]).drop("text")
    return redact.keep_last(persons, ["doc_id"]).select("doc_id", "detected_text")


@query()
def w4_verification(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    best = redact.resolve(redact.keep_best(_detected(spark, sf), ["doc_id", "entity_type"]))
    boxes = best.join(docs, "doc_id").select("doc_id", "entity_type", "action", F.col("detected_text").alias("target"), F.col("text").alias("before"), redact.redact_text(F.col("text"), redact.DOCUMENT_DETECTORS).alias("after"))
    return redact.verify(boxes).groupBy("action").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


@query("""SELECT c_custkey % 5 AS k, count(*) AS n FROM customer WHERE c_custkey % 5 < 3 GROUP BY 1""")
def w4_field_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Detection by what fields mean: empty fields of a known type go to review."""
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, "db_inv_zip").when(k == 1, "irb_name").when(k == 2, "topmost.appFirm[0]").otherwise("title")
    body = F.when(k == 0, "MA 02115").when(k == 1, "").otherwise(F.col("c_name"))
    fields = table(spark, sf, "customer").select("c_custkey", name.alias("field_name"), body.alias("ocr_text"), F.lit(0.9).alias("ocr_confidence"))
    found = redact.keep_best(redact.detect_fields(fields), ["c_custkey", "entity_type", "field_name"])
    return found.groupBy((F.col("c_custkey") % 5).alias("k")).agg(F.count("*").alias("n"))

