"""Page classification by ordered rules, and the gate between rules and an image model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns, text


def by_rules(body: Column, table_score: Column) -> Column:
    """struct(label, confidence): forms by their titles, then ruled tables, then protocols."""
    upper = F.upper(text.squeeze(body))
    out = None
    for label, titles in patterns.FORMS:
        hits = sum((upper.rlike("(?s)" + p).cast("int") for p in titles[1:]), upper.rlike("(?s)" + titles[0]).cast("int"))
        found = F.struct(F.lit(label).alias("label"), F.when(hits == len(titles), 0.99).otherwise(0.93).alias("confidence"))
        out = F.when(hits > 0, found) if out is None else out.when(hits > 0, found)
    ruled = (table_score >= 0.62) | ((table_score >= 0.45) & upper.rlike(patterns.TABLE_LANGUAGE))
    out = out.when(ruled, F.struct(F.lit("CLINICAL_TABLE").alias("label"), F.least(F.lit(0.97), 0.62 + 0.35 * table_score).alias("confidence")))
    title = F.when(F.contains(upper, F.lit("CLINICAL STUDY PROTOCOL")), 0.92).otherwise(0.84)
    out = out.when(upper.rlike(patterns.PROTOCOL_LANGUAGE), F.struct(F.lit("CLINICAL_PROTOCOL").alias("label"), title.alias("confidence")))
    return out.otherwise(F.struct(F.lit("UNKNOWN").alias("label"), F.lit(0.25).alias("confidence")))


def gate(rule: Column, image_label: Column, image_confidence: Column, margin: Column, rule_least: float = 0.80, margin_least: float = 0.05) -> Column:
    """struct(label, confidence, source): the rule if it is sure, else the image model unless its two best are close."""
    sure = (rule["label"] != "UNKNOWN") & (rule["confidence"] >= rule_least)
    answer = lambda label, conf, source: F.struct(label.alias("label"), conf.alias("confidence"), F.lit(source).alias("source"))
    return F.when(sure, answer(rule["label"], rule["confidence"], "rule")).when(margin < margin_least, answer(F.lit("NEEDS_REVIEW"), image_confidence, "image_low_margin")).otherwise(answer(image_label, image_confidence, "image_fallback"))
