"""Entity detection, policy, masking, audit and verification as DataFrame transforms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, patterns, spans, text
from .joins import overlapping


@dataclass(frozen=True)
class Policy:
    """Actions and thresholds by entity type, read from a nested mapping."""

    rules: tuple  # (entity_type, action, minimum_confidence)
    default_action: str
    review_below: float

    @staticmethod
    def from_mapping(config: dict) -> Policy:
        review_below = float((config.get("human_review") or {}).get("confidence_below", 0.80))
        rules = []
        for section in (config.get("pii"), config.get("cci")):
            if isinstance(section, dict):
                default = section.get("default_action", "review")
                named = {k: v for k, v in section.items() if isinstance(v, dict) and k not in ("default_action", "keywords", "regex_patterns")}
                rules += [(k, str(v.get("action", default)), float(v.get("minimum_confidence", review_below))) for k, v in named.items()]
        return Policy(tuple(rules), str((config.get("cci") or {}).get("default_action", "review")), review_below)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rules), "entity_type string, rule_action string, minimum_confidence double")


#: The shipped policy.
DEFAULT_POLICY = Policy.from_mapping({
    "pii": {
        "PERSON": {"action": "redact", "minimum_confidence": 0.75},
        "ADDRESS": {"action": "redact", "minimum_confidence": 0.78},
        "SENSITIVE_FACILITY": {"action": "review", "minimum_confidence": 0.75},
        "EMAIL": {"action": "redact", "minimum_confidence": 0.90},
        "PHONE_NUMBER": {"action": "redact", "minimum_confidence": 0.90},
        "DATE": {"action": "review", "minimum_confidence": 0.80},
    },
    "cci": {
        "default_action": "review",
        "CCI_PROTOCOL_ID": {"action": "redact", "minimum_confidence": 0.80},
        "CCI_STUDY_TITLE": {"action": "review", "minimum_confidence": 0.75},
        "CCI_SPONSOR": {"action": "redact", "minimum_confidence": 0.80},
    },
    "human_review": {"confidence_below": 0.72},
})

REGEX_DETECTORS = [("PERSON", patterns.PERSON), ("DATE", patterns.DATE), ("ADDRESS", patterns.POSTAL), ("CCI_PROTOCOL_ID", patterns.PROTOCOL)]
DOCUMENT_DETECTORS = [("EMAIL", patterns.EMAIL), ("PHONE_NUMBER", patterns.PHONE), ("PERSON", patterns.ASCII_PERSON)]


def detect(df: DataFrame, body: str, confidence: Column, detectors: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each match: the input's columns, entity_type, seq, detected_text, confidence. No shuffle."""
    typed = lambda kind: lambda m: F.struct(F.lit(kind).alias("entity_type"), m.alias("detected_text"))
    found = [F.transform(F.regexp_extract_all(F.col(body), F.lit(p), F.lit(0)), typed(kind)) for kind, p in (detectors or REGEX_DETECTORS)]
    rows = df.select("*", F.posexplode(F.concat(*found)).alias("seq", "m"))
    return rows.select(*df.columns, "m.entity_type", "seq", "m.detected_text", confidence.alias("confidence"))


def field_types(name: Column) -> Column:
    """Entity types that a field's name speaks of, in fixed order."""
    low = F.lower(name)
    hits = [F.when(_any([F.contains(low, F.lit(w)) for w in words]), F.lit(kind)) for kind, words in patterns.FIELD_TYPES]
    return F.array_compact(F.array(*hits))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def expected_types(name: Column, value: Column) -> Column:
    protocol = F.when(value.rlike(patterns.PROTOCOL), F.array(F.lit("CCI_PROTOCOL_ID"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(field_types(name), protocol))


_PLACES = "array<struct<begin:int,end:int>>"


def _places(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))


def detect_fields(fields: DataFrame) -> DataFrame:
    """Detection that knows what fields mean. Input: field_name, ocr_text, ocr_confidence and whatever else.

    Adds seq, entity_type, detected_text, confidence, method and ``places`` (code points, end exclusive): what the detection rests
    on, none for one of the whole field. Persons are found by the token rule, and by the pattern where the rule finds none; all of
    them make one detection. A field of a known type whose text is empty goes to review. Of several detections of one type in
    one field the most confident stays (the caller deduplicates with ``keep_best``).
    """
    kinds = field_types(F.col("field_name"))
    body, conf = F.col("ocr_text"), F.col("ocr_confidence")
    blank = F.trim(F.coalesce(body, F.lit(""))) == ""
    none = F.array().cast(_PLACES)

    def entry(kind, found: Column, c: Column, method: str, places: Column = none) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("entity_type"), found.alias("detected_text"), c.cast("double").alias("confidence"), F.lit(method).alias("method"), places.cast(_PLACES).alias("places"))

    on = lambda kind: F.array_contains(kinds, kind)
    semantic = numbers.detector_confidence("SEMANTIC", conf)
    first = lambda pattern, kind, fallback: spans.bound(F.slice(spans.spans(body, pattern), 1, 1), lambda s: F.when(F.size(s) > 0, entry(kind, s[0]["text"], semantic, "field_semantics", _places(s))).otherwise(fallback))
    persons = spans.bound(spans.spans(body, patterns.PERSON_RULE), lambda s: F.when(F.size(s) > 0, _places(s)).otherwise(_places(spans.spans(body, patterns.PERSON))))
    person = spans.bound(persons, lambda p: F.when(F.size(p) > 0, entry("PERSON", body, numbers.detector_confidence("PERSON", conf), "field_semantics", p)))
    address = entry("ADDRESS", body, semantic, "field_semantics")
    found = [
        F.when(on("PERSON"), person),
        F.when(on("ADDRESS"), F.when(F.contains(F.lower("field_name"), F.lit("zip")), first(patterns.POSTAL, "ADDRESS", address)).otherwise(address)),
        *[F.when(on(k), entry(k, body, semantic, "field_semantics")) for k in ("SENSITIVE_FACILITY", "CCI_STUDY_TITLE", "CCI_SPONSOR")],
        F.when(on("DATE"), first(patterns.DATE, "DATE", F.lit(None))),
    ]
    protocols = F.transform(spans.spans(body, patterns.PROTOCOL), lambda m: entry("CCI_PROTOCOL_ID", m["text"], numbers.detector_confidence("PROTOCOL", conf), "regex", _places(F.array(m))))
    empty = F.transform(kinds, lambda k: entry(k, F.lit(""), F.lit(0.40), "ocr_empty"))
    every = F.when(blank, empty).otherwise(F.concat(F.array_compact(F.array(*found)), protocols))
    return fields.select("*", F.posexplode(every).alias("seq", "m")).select(*fields.columns, "seq", "m.*")


def with_boxes(detected: DataFrame, tokens: DataFrame, keys: list[str], whole: Column) -> DataFrame:
    """Add ``box``: the least box around the boxes of all tokens that a detection's places touch, ``whole`` where none is touched.

    ``tokens`` has the keys of a field, token_begin, token_end and token_box (x0, y0, x1, y1). ``keys``, entity_type and seq tell
    detections apart. Places and tokens meet by cells, so a long field costs in proportion to its length.
    """
    own = [*keys, "entity_type", "seq"]
    placed = detected.select(*own, F.explode("places").alias("_p")).select(*own, F.col("_p.begin").alias("_b"), F.col("_p.end").alias("_e"))
    met = overlapping(placed, "_b", "_e", tokens.select(*keys, "token_begin", "token_end", "token_box"), "token_begin", "token_end", keys, 64)
    sides = [f(f"token_box.{c}").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    boxes = met.groupBy(*own).agg(F.struct(*sides).alias("_box"))
    return detected.join(boxes, own, "left").withColumn("box", F.coalesce("_box", whole)).drop("_box").select(*detected.columns, "box")


def resolve(detected: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Add ``action`` and ``needs_review``; the policy is a handful of rows, joined by broadcast."""
    rules = policy.frame(detected.sparkSession)
    known = detected.join(F.broadcast(rules), "entity_type", "left")
    least = F.coalesce("minimum_confidence", F.lit(policy.review_below))
    action = F.coalesce("rule_action", F.lit(policy.default_action))
    low = F.col("confidence") < least
    return known.withColumn("action", F.when(low, "review").otherwise(action)).withColumn("needs_review", low | (F.col("confidence") < policy.review_below)).drop("rule_action", "minimum_confidence")


def keep_best(detected: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one of the greatest confidence, the first on ties."""
    rest = [c for c in detected.columns if c not in keys]
    return detected.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("confidence", -F.col("seq"))).alias("_s")).select(*keys, "_s.*").select(*detected.columns)


def keep_last(detected: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in detected.columns if c not in keys]
    return detected.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_s")).select(*keys, "_s.*")


def audit(resolved: DataFrame) -> DataFrame:
    """The audit record: digest and mask instead of the text."""
    return resolved.withColumns({"text_sha256": F.sha2("detected_text", 256), "masked_text": text.mask(F.col("detected_text"))}).drop("detected_text")


def redact_text(body: Column, detectors: list[tuple[str, str]]) -> Column:
    """The text with every match of the detectors replaced by its type."""
    for kind, pattern in detectors:
        body = F.regexp_replace(body, pattern, f"[{kind}]")
    return body


def verify(records: DataFrame) -> DataFrame:
    """Whether redactions hold. Input: action, target, before, after (texts in the box). An empty target is nowhere."""
    t, before, after = (text.verification_form(F.coalesce(c, F.lit(""))) for c in ("target", "before", "after"))
    there, still = (t != "") & F.contains(before, t), (t != "") & F.contains(after, t)
    passed = F.when(F.col("action") == "redact", there & ~still).when(F.col("action") == "review", after != "").otherwise(F.lit(True))
    return records.withColumns({"present_before": there, "present_after": still, "passed": passed})


def override(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Review decisions over policy actions; the last of several decisions on an item counts (order: ``seq``)."""
    last = decisions.groupBy(key).agg(F.max_by("action", "seq").alias("_decided"))
    return items.join(last, key, "left").withColumn("action", F.coalesce("_decided", "action")).drop("_decided")
