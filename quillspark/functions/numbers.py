"""Small numeric expressions with the roundings and guards that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, and ``empty`` where whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(empty))


def detector_confidence(kind: str, ocr: Column) -> Column:
    """Confidence of a detector from that of the OCR."""
    base = {"PERSON": 0.70, "SEMANTIC": 0.72, "PROTOCOL": 0.76}.get(kind)
    if kind == "REGEX":
        return F.greatest(F.lit(0.55), ocr)
    return F.least(F.lit(0.99), base + (1 - base) * ocr)


def checkbox_confidence(ratio: Column, threshold: Column) -> Column:
    return F.least(F.lit(0.99), 0.55 + 4 * F.abs(ratio - threshold))


def softmax(values: Column) -> Column:
    """Softmax of an array. Greatest value and sum are bound once, not taken anew for each component."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    e = once(F.array_max(values), lambda most: F.transform(values, lambda x: F.exp(x - most)))
    return once(e, lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total)))


def page_progress(page: Column, pages: Column) -> Column:
    """Per cent done when a page (from 1) begins."""
    return 15 + F.floor(60 * (page - 1) / pages).cast("int")


def elapsed_seconds(begin: Column, end: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_micros(end) - F.unix_micros(begin)) / 1e6


def written_map(pairs: Column) -> Column:
    """A map as text, ``key=value`` by key."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ";")


def united(first: Column, second: Column) -> Column:
    """The union of two maps, keys in order; where both have a key the second's value counts."""
    rest = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(rest), F.map_entries(second))))
