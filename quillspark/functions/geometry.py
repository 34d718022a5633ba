"""Boxes and boundaries as expressions: overlap, clustering, matching. JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return wide * high


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; 0 where there is no union."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def containment(predicted: Column, expected: Column) -> Column:
    """The share of the predicted box that lies in the expected one."""
    return intersection(predicted, expected) / F.greatest(area(predicted), F.lit(1e-9))


def prf(matched: Column, predicted: Column, expected: Column) -> Column:
    """struct(precision, recall, f1); all 1 when nothing is expected and nothing predicted."""
    empty = (predicted == 0) & (expected == 0)
    p = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(matched, predicted), F.lit(0.0)))
    r = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(matched, expected), F.lit(0.0)))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def greedy_pairs(candidates: Column) -> Column:
    """One-to-one pairs taken in order from an array of structs with ``pi`` and ``ri``."""
    start = F.struct(F.array().cast("array<int>").alias("p"), F.array().cast("array<int>").alias("r"))

    def take(acc: Column, c: Column) -> Column:
        used = F.array_contains(acc["p"], c["pi"]) | F.array_contains(acc["r"], c["ri"])
        return F.when(used, acc).otherwise(F.struct(F.array_append(acc["p"], c["pi"]).alias("p"), F.array_append(acc["r"], c["ri"]).alias("r")))

    return F.aggregate(candidates, start, take)


def _crossed(a: Column, b: Column, pair) -> Column:
    n = F.size(a)
    m = F.size(b)
    left = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    right = F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(left, lambda i: F.transform(right, lambda j: pair(i, j))))


def boundary_matches(predicted: Column, expected: Column, tolerance: float = 8.0) -> Column:
    """How many boundaries match one to one within the tolerance, nearest first."""
    near = _crossed(predicted, expected, lambda i, j: F.struct(F.abs(F.get(predicted, i) - F.get(expected, j)).alias("d"), i.alias("pi"), j.alias("ri")))
    return F.size(greedy_pairs(F.array_sort(F.filter(near, lambda c: c["d"] <= tolerance)))["p"])


def box_matches(predicted: Column, expected: Column, least: float = 0.7) -> Column:
    """How many boxes match one to one with at least the given overlap, largest first (ties: later ones first)."""
    over = _crossed(predicted, expected, lambda i, j: F.struct(iou(F.get(predicted, i), F.get(expected, j)).alias("iou"), i.alias("pi"), j.alias("ri")))
    return F.size(greedy_pairs(F.sort_array(F.filter(over, lambda c: c["iou"] >= least), asc=False))["p"])


def representatives(values: Column, tolerance: float) -> Column:
    """Sorted values, each more than the tolerance away from the last one kept."""
    return F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (F.abs(x - F.element_at(acc, -1)) > tolerance), F.array_append(acc, x)).otherwise(acc))


def padded_boundaries(values: Column, length: Column, gap: float = 12.0) -> Column:
    """Boundaries with the outer edges added where the first or last is far from it; none stays none."""
    first = F.when(F.element_at(values, 1) > gap, F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    last = F.when(length - 1 - F.element_at(values, -1) > gap, F.array((length - 1).cast("double"))).otherwise(F.array().cast("array<double>"))
    return F.when(F.size(values) == 0, values).otherwise(F.concat(first, values, last))


def to_pixels(rect: Column, dpi: int, padding: float = 1.5) -> Column:
    """A box in points as pixels, padded; half values round to even."""
    scale = dpi / 72.0
    edge = lambda v, sign: F.bround((v + sign * padding) * scale, 0).cast("int")
    return F.struct(F.greatest(F.lit(0), edge(rect["x0"], -1)).alias("x0"), F.greatest(F.lit(0), edge(rect["y0"], -1)).alias("y0"), edge(rect["x1"], 1).alias("x1"), edge(rect["y1"], 1).alias("y1"))


def clip(box: Column, width: Column, height: Column) -> Column:
    """A box within an image; null where nothing of it is inside."""
    x0, y0 = F.greatest(F.lit(0), box["x0"]), F.greatest(F.lit(0), box["y0"])
    x1, y1 = F.least(width, box["x1"]), F.least(height, box["y1"])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def to_points(box: Column, dpi: int, upscaled: Column) -> Column:
    """Pixels back to points; pixels of an upscaled crop count half."""
    scale = F.when(upscaled, F.lit(0.5)).otherwise(F.lit(1.0)) * 72.0 / dpi
    return F.struct(*[(box[c] * scale).alias(c) for c in ("x0", "y0", "x1", "y1")])


def table_score(row_rules: Column, column_rules: Column) -> Column:
    return F.least(F.lit(1.0), 0.55 * row_rules / 5 + 0.45 * column_rules / 4)


def active_runs(active: Column, least: int = 3, gap: int = 5) -> Column:
    """Runs [begin, end) of true values at least ``least`` long, joined over gaps of at most ``gap``."""
    start = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<begin:int,end:int>>").alias("runs"))
    closed = F.concat(active, F.array(F.lit(False)))
    indexed = F.transform(closed, lambda on, i: F.struct(on.alias("on"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        opens = x["on"] & (acc["open"] < 0)
        ends = ~x["on"] & (acc["open"] >= 0)
        run = F.struct(acc["open"].alias("begin"), x["i"].alias("end"))
        runs = F.when(ends & (x["i"] - acc["open"] >= least), F.array_append(acc["runs"], run)).otherwise(acc["runs"])
        return F.struct(F.when(opens, x["i"]).when(ends, F.lit(-1)).otherwise(acc["open"]).alias("open"), runs.alias("runs"))

    runs = F.aggregate(indexed, start, step)["runs"]

    def join(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        near = (F.size(acc) > 0) & (r["begin"] - F.coalesce(last["end"], F.lit(-1)) <= gap)
        longer = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(last["begin"].alias("begin"), r["end"].alias("end")))
        return F.when(near, longer).otherwise(F.array_append(acc, r))

    empty = F.array().cast("array<struct<begin:int,end:int>>")
    return F.aggregate(runs, empty, lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).otherwise(join(acc, r)))
