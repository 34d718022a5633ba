"""Fields from text: label-anchored extraction, validation by field name, resolution against known records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns, text

_EDGE = r"^[ :;|\n]+|[ :;|\n]+$"


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\s+", " "), _EDGE, "")


def _found(body: Column, pattern: str | Column, group: int = 1) -> Column:
    hit = F.regexp_extract(body, pattern, group) if isinstance(pattern, str) else F.call_function("regexp_extract", body, pattern, F.lit(group))
    return F.when(hit != "", _clean(hit))


def cover_fields(df: DataFrame, body: str) -> DataFrame:
    """Add the fields of a protocol's cover page and ``warnings`` (what is missing, in order).

    The amendment's date is looked for under the amendment's own number if that was found.
    """
    compact = _clean(F.col(body))
    out = df.withColumns({name: _found(compact, pattern) for name, pattern in patterns.COVER})
    label, date = patterns.AMENDMENT_DATE
    any_date = label + r"\d+" + date
    own = F.concat(F.lit(label), F.col("amendment_number"), F.lit(date))
    title = _found(compact, patterns.COVER_TITLE)
    out = out.withColumn("amendment_date", F.when(F.col("amendment_number").isNull(), _found(compact, any_date)).otherwise(_found(compact, own)))
    out = out.withColumn("protocol_title", title)
    phase = F.regexp_extract("protocol_title", patterns.COVER_PHASE, 1)
    out = out.withColumn("phase", F.when(phase != "", F.concat(F.lit("Phase "), F.regexp_replace(phase, r"\s+", ""))))
    order = [name for name, _ in patterns.COVER] + ["amendment_date", "protocol_title", "phase"]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in order]))
    out = out.withColumn("warnings", missing)
    out = out.withColumn("nct_id", F.translate(F.upper("nct_id"), "O", "0"))
    return _canonical(out)


def labelled(df: DataFrame, body: str, labels: dict[str, str], strict: bool = False) -> DataFrame:
    """A column for the first match of each label's pattern (null if none) and ``missing``, the labels without one; ``strict`` makes these an error."""
    out = df.withColumns({name: F.nullif(F.regexp_extract(body, pattern, 1), F.lit("")) for name, pattern in labels.items()})
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in labels]))
    if strict:
        missing = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("no value: "), F.array_join(missing, ", "))).cast("array<string>")).otherwise(missing)
    return out.withColumn("missing", missing)


def _canonical(df: DataFrame) -> DataFrame:
    """One sponsor's name and town in their usual spelling."""
    sponsor = F.when(F.contains(text.normalize(F.col("sponsor_name")), F.lit(patterns.SPONSOR)), F.lit(patterns.SPONSOR_AS)).otherwise(F.col("sponsor_name"))
    town = F.regexp_replace("sponsor_address", patterns.TOWN, patterns.TOWN_AS)
    return df.withColumns({"sponsor_name": sponsor, "sponsor_address": town})


COVER_FIELDS = ["nct_id", "protocol_number", "sponsor_name", "sponsor_address", "amendment_number", "amendment_date", "protocol_title", "phase"]


def resolve_known(extracted: DataFrame, known: DataFrame) -> DataFrame:
    """Fields of a known record where the normalised protocol numbers agree, else what was read.

    Of several records of one normalised number the one of the least protocol number counts.
    """
    fields = [c for c in COVER_FIELDS if c in known.columns]
    least = known.groupBy(text.normalize(F.col("protocol_number")).alias("_key")).agg(F.min_by(F.struct(*fields), F.struct("protocol_number", *fields)).alias("_r"))
    records = least.where("_key <> ''").select("_key", *[F.col(f"_r.{c}").alias(f"_{c}") for c in fields])
    joined = extracted.withColumn("_key", text.normalize(F.col("protocol_number"))).join(records, "_key", "left")
    return _canonical(joined.withColumns({c: F.coalesce(f"_{c}", c) for c in COVER_FIELDS if c in known.columns}).select(*extracted.columns))


def validated(name: Column, value: Column, sponsor: Column | None = None, similarity: Column | None = None) -> Column:
    """A field's value after the rules for its name; a rule that fails passes on to the next."""
    v, low = text.clean_artifacts(value), F.lower(name)
    digits, letters = F.regexp_replace(v, r"\D", ""), F.upper(F.regexp_replace(v, "[^A-Za-z]", ""))
    date = r"(\d{1,2})\D+(\d{1,2})\D+(\d{4})"
    part = lambda g: F.regexp_extract(v, date, g)
    rules = [
        F.when((F.contains(low, F.lit("zip")) | F.contains(low, F.lit("postal"))) & (F.length(digits) >= 5), F.substring(digits, 1, 5)),
        F.when((low.endswith("state") | F.contains(low, F.lit("_state"))) & (F.length(letters) >= 2), F.substring(letters, 1, 2)),
        F.when(F.contains(low, F.lit("date")) & v.rlike(date), F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))),
    ]
    if sponsor is not None and similarity is not None:
        rules.append(F.when(F.contains(low, F.lit("appfirm")) & (F.coalesce(sponsor, F.lit("")) != "") & (similarity >= 0.72), sponsor))
    return F.coalesce(*rules, v)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; no built-in says the same. Arrow batches."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
