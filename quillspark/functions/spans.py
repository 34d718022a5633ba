"""Places of matches in texts, tokens under spans, words in cells. JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 256


def spans(body: Column, pattern: str) -> Column:
    """array<struct<begin, end, text>> of all matches, in code points, end exclusive.

    Places are running sums of the pieces between matches and of the matches, formed in chunks, so that
    many matches cost in proportion to their number.
    """
    gaps = F.transform(F.split(body, pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    met = bound(found, lambda m: F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, t: F.struct(g.alias("gap"), t.alias("text"))))
    return bound(met, _placed)


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(pairs: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int"))
    width = lambda p: p["gap"] + F.length(p["text"])
    none = F.array().cast("array<struct<begin:int,end:int,text:string>>")

    def place(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        one = F.struct(begin.alias("begin"), (begin + F.length(p["text"])).alias("end"), p["text"].alias("text"))
        return F.struct((acc["at"] + width(p)).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def from_chunks(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, p: a + width(p)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        base = F.aggregate(sums, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, base, lambda c, b: F.aggregate(c, F.struct(b.alias("at"), none.alias("out")), place, lambda acc: acc["out"])))

    chunks = F.transform(numbers, lambda i: F.slice(pairs, i * _CHUNK + 1, F.lit(_CHUNK)))
    return F.when(F.size(pairs) > 0, bound(chunks, from_chunks)).otherwise(none)


def under(span: Column, tokens: Column) -> Column:
    """The tokens (structs with begin and end) that a span touches."""
    return F.filter(tokens, lambda t: (t["end"] > span["begin"]) & (t["begin"] < span["end"]))


def boxes_union(tokens: Column) -> Column:
    """The least box around the boxes of tokens (x0, y0, x1, y1); null without tokens."""
    side = lambda best, name: best(F.transform(tokens, lambda t: t["box"][name]))
    box = F.struct(side(F.array_min, "x0").alias("x0"), side(F.array_min, "y0").alias("y0"), side(F.array_max, "x1").alias("x1"), side(F.array_max, "y1").alias("y1"))
    return F.when(F.size(tokens) > 0, box)


def _band(center: Column, bounds: list[float]) -> Column:
    """The first of the bands between neighbouring bounds, ends included, that holds a value; null where none does."""
    hits = [F.when((center >= a) & (center <= b), F.lit(i)) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    return F.coalesce(*hits) if hits else F.lit(None).cast("int")


def words_to_matrix(words: DataFrame, keys: list[str], x: list[float], y: list[float]) -> DataFrame:
    """Words (text, left, top, width, height) into the cells of a grid: one dense matrix of texts for each key.

    A word belongs to the first column and row that hold its centre; a cell's words are joined by blanks
    in order of top, left and text; cells without words are empty. Words outside the grid are left out.
    """
    column, row = _band(F.col("left") + F.col("width") / 2, x), _band(F.col("top") + F.col("height") / 2, y)
    placed = words.withColumns({"_c": column, "_r": row}).where("_c is not null and _r is not null")
    entry = F.struct(F.col("top").cast("int").alias("top"), F.col("left").cast("int").alias("left"), F.col("text"))
    cells = placed.groupBy(*keys, "_r", "_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda w: w["text"]), " ").alias("text"))
    held = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("_r", "_c").alias("k"), F.col("text")))).alias("held"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(len(y) - 2)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(len(x) - 2)), lambda c: F.coalesce(F.try_element_at("held", F.struct(r.alias("_r"), c.alias("_c"))), F.lit(""))))
    return held.select(*keys, grid.alias("matrix"))
