"""Boundaries to codecs that aren't part of this library: PDF, raster images, OCR.

Each reader states the rows it gives; a codec is a function from bytes to such rows, registered by
name. Without one, reading raises ``CodecUnavailable``, never a silent empty result. What follows the
codec (cleaning, ordering, offsets) is DataFrame code and works on rows from anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CodecUnavailable(RuntimeError):
    """No codec of this name is registered."""


_CODECS: dict[str, Callable[[bytes], list[dict]]] = {}

#: What each codec gives for one file.
SCHEMAS = {
    "pdf_pages": "page int, width_pt double, height_pt double, image binary",
    "pdf_text": "page int, text string",
    "pdf_info": "page_count int, encrypted boolean, title string, creator string, producer string, has_xfa boolean, form_field_count int",
    "pdf_widgets": "name string, page int, x0 double, y0 double, x1 double, y1 double, kind string",
    "pdf_tables": "page int, table_index int, x_lines array<double>, y_lines array<double>, matrix array<array<string>>",
    "image": "height int, width int, channels int, data binary",
    "ocr_words": "page int, block int, par int, line int, word_num int, left int, top int, width int, height int, conf string, text string",
}


def register(name: str, codec: Callable[[bytes], list[dict]]) -> None:
    if name not in SCHEMAS:
        raise ValueError(f"unknown kind of codec: {name}")
    _CODECS[name] = codec


def engine(name: str) -> Callable[[bytes], list[dict]]:
    try:
        return _CODECS[name.strip().casefold()]
    except KeyError:
        raise CodecUnavailable(f"no codec is registered for {name!r}") from None


def decode(files: DataFrame, name: str) -> DataFrame:
    """Rows of a codec over (path, content): one Arrow stage, a file at a time."""
    codec = engine(name)
    columns = [c.split()[0] for c in SCHEMAS[name].replace("array<array<string>>", "x").split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                rows = codec(bytes(content))
                if rows:
                    yield pd.DataFrame([{"path": path} | r for r in rows], columns=["path", *columns])

    return files.select("path", "content").mapInPandas(run, f"path string, {SCHEMAS[name]}")


def clean_words(words: DataFrame) -> DataFrame:
    """OCR words that have text and a confidence of 0 or more; ``conf`` becomes a number."""
    return words.withColumn("conf", F.try_cast("conf", "double") if hasattr(F, "try_cast") else F.expr("try_cast(conf as double)")).where("trim(text) <> '' and conf >= 0")


def mean_confidence(conf: Column) -> Column:
    return F.coalesce(F.avg(F.when(conf >= 0, conf)), F.lit(0.0))


def token_offsets(words: DataFrame, document: list[str]) -> DataFrame:
    """Words in reading order with the offsets they have in the joined text (one separator between words)."""
    order = Window.partitionBy(*document).orderBy("line_top", "line_left", "left", "word_num")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    line = Window.partitionBy(*document, "block", "par", "line")
    placed = words.withColumns({"line_top": F.min("top").over(line), "line_left": F.min("left").over(line)})
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return placed.withColumns({"start": start, "end": start + F.length("text")}).drop("line_top", "line_left")


def page_text(words: DataFrame, document: list[str]) -> DataFrame:
    """Words to lines by blanks, lines to text by line ends, in reading order."""
    line = words.groupBy(*document, "block", "par", "line").agg(
        F.min("top").alias("t"), F.min("left").alias("l"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "word_num", "text"))), lambda w: w["text"]), " ").alias("s"),
    )
    lines = F.array_sort(F.collect_list(F.struct("t", "l", "s")))
    return line.groupBy(*document).agg(F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("text"))


def recognition(result: Column) -> Column:
    """struct(text, confidence 0-100) of a recogniser's JSON result, single or plural, under any number of ``res`` objects; an unknown form is an error.

    A fold goes into ``res`` as long as it is an object; there can't be more of them than opening braces.
    """
    braces = F.length(result) - F.length(F.replace(result, F.lit("{"), F.lit("")))

    def inward(value: Column, _: Column) -> Column:
        inner = F.try_variant_get(value, "$.res", "variant")
        return F.when(F.schema_of_variant(inner).startswith("OBJECT"), inner).otherwise(value)

    innermost = F.aggregate(F.sequence(F.lit(0), braces), F.try_parse_json(result), inward)

    def either(one: str, many: str) -> Column:
        found = [F.try_variant_get(innermost, f"$.{name}", "variant") for name in (one, many)]
        return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in found])

    said, scored = either("rec_text", "rec_texts"), either("rec_score", "rec_scores")
    texts, scores = F.try_variant_get(said, "$", "array<string>"), F.try_variant_get(scored, "$", "array<double>")
    text = F.coalesce(F.array_join(F.filter(texts, lambda t: F.trim(t) != ""), "\n"), F.try_variant_get(said, "$", "string"))
    mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, b: a + b), F.size(scores))
    value = F.coalesce(mean, F.try_variant_get(scored, "$", "double"), F.lit(0.0))
    percent = F.when(value <= 1, value * 100).otherwise(value)
    return F.when(text.isNull(), F.raise_error(F.lit("the recogniser's result has no text")).cast("struct<text:string,confidence:double>")).otherwise(F.struct(F.trim(text).alias("text"), percent.alias("confidence")))


@F.pandas_udf(T.DoubleType())
def ink_ratio(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Share of dark pixels in the inner half of a grey crop; the cut-off follows the crop's own background."""
    import numpy as np

    def one(data: bytes, w: int, h: int) -> float:
        gray = np.frombuffer(data, np.uint8).reshape(h, w)
        my, mx = max(1, round(h * 0.25)), max(1, round(w * 0.25))
        inner = gray[my : h - my, mx : w - mx]
        inner = inner if inner.size else gray
        cut = min(160.0, max(0.0, float(np.percentile(inner, 85)) - 35.0))
        return float((inner < cut).mean())

    return pd.Series([one(*x) for x in zip(pixels, width, height)], dtype="float64")


def gradient_histograms(image, cell: int = 16, bins: int = 9):
    """Histograms of oriented gradients of a grey image with 2 x 2 blocks, clipped norms; a numpy array."""
    import numpy as np

    g = np.sqrt(image.astype(np.float64))
    dy, dx = np.zeros_like(g), np.zeros_like(g)
    dy[1:-1], dx[:, 1:-1] = g[2:] - g[:-2], g[:, 2:] - g[:, :-2]
    size, turn = np.hypot(dx, dy), np.rad2deg(np.arctan2(dy, dx)) % 180
    rows, cols = g.shape[0] // cell, g.shape[1] // cell
    part = np.minimum((turn * bins / 180).astype(int), bins - 1)
    y, x = np.indices(g.shape)
    keep = (y < rows * cell) & (x < cols * cell)
    at = ((y // cell) * cols + x // cell) * bins + part
    cells = np.bincount(at[keep], size[keep], rows * cols * bins).reshape(rows, cols, bins) / cell**2
    blocks = np.concatenate([cells[:-1, :-1], cells[:-1, 1:], cells[1:, :-1], cells[1:, 1:]], 2).reshape(-1, 4 * bins)
    blocks = np.minimum(blocks / np.sqrt((blocks**2).sum(1, keepdims=True) + 1e-10), 0.2)
    return (blocks / np.sqrt((blocks**2).sum(1, keepdims=True) + 1e-10)).ravel().astype(np.float32)


def degrade(gray, contrast: float = 1.0, shadow: float = 0.0, angle: float = 0.0, sigma: float = 0.0, seed: int = 0):
    """Contrast, a directional shadow and seeded noise on a grey image (numpy)."""
    import numpy as np

    if not 0 < contrast <= 1.5:
        raise ValueError("contrast must be in (0, 1.5]")
    out = (gray.astype(np.float64) - 127.5) * contrast + 127.5
    h, w = gray.shape
    y, x = np.mgrid[0:h, 0:w]
    slope = x * np.cos(np.deg2rad(angle)) + y * np.sin(np.deg2rad(angle))
    slope = (slope - slope.min()) / max(float(np.ptp(slope)), 1e-9)
    out *= 1 - shadow * slope
    out += np.random.Generator(np.random.PCG64(seed)).normal(0, sigma, gray.shape) if sigma else 0
    return np.clip(np.round(out), 0, 255).astype(np.uint8)
