"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything that isn't a letter becomes a blank, and runs of one to three
characters are hashed into ``WIDTH`` buckets. Document frequencies are counted over all rows that may
be learnt from. The model is fitted by follow-the-regularised-leader with elastic-net penalties on a
bounded sample of them (``per_language`` rows of each language, chosen by a hash of the key), and a
fifth of that sample sets the temperature of the probabilities.

Defined results: null text and text without a letter give ``und`` with score 0; rows without a
language teach nothing; with nothing to learn from every row is ``und``; equal rows give equal results;
languages of equal probability go by name; an empty table gives no rows; input columns with the name
of a result are replaced. Memory is bounded by bytes and by rows of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import U64, append, mix, slices
from .ftrl import Ftrl, softmax, temperature

WIDTH = 1 << 14
_SLICE, _ROWS = 256 << 10, 128  # counters are an array of rows x WIDTH: 16 MB
_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000)
_K = U64(0x9E3779B97F4A7C15)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nonzero counts of hashed n-grams: (rows, buckets, counts), and which texts have a letter."""
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) for t in lowered], np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    letter = _LETTER[np.minimum(codes, 0xFFFF)]
    if (high := codes >= 0x10000).any():
        rare, which = np.unique(codes[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in rare.tolist()])[which]
    lettered = np.zeros(len(texts), bool)
    lettered[row[letter]] = True
    a = np.where(letter, codes, 32).astype(U64)
    counts = np.zeros(len(texts) * WIDTH, np.int64)
    h = mix(a + U64(1))
    term = h
    for n in range(1, 4):
        if n > 1:
            h = h[:-1] * _K + term[n - 1 :]
        inside = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
        blank = (a[: len(h)] == U64(32)) & (a[n - 1 :] == U64(32)) if n != 2 else np.zeros(len(h), bool)
        keep = inside & ~blank
        bucket = (mix(h[keep]) >> U64(50)).astype(np.int64)
        counts += np.bincount(row[: len(h)][keep] * WIDTH + bucket, minlength=len(counts))
    at = np.flatnonzero(counts)
    return at // WIDTH, at % WIDTH, counts[at], lettered


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    heat: float

    def scores(self, rows: np.ndarray, buckets: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        x = features(self.idf, buckets, counts)
        out = np.zeros((n, len(self.languages)))
        norm = np.sqrt(np.maximum(np.bincount(rows, x * x, n), 1e-12))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(rows, x * self.weights[buckets, k], n) / norm
        return out + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        rows, buckets, counts, lettered = grams(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = softmax(self.scores(rows, buckets, counts, len(texts)) / self.heat)
        best = p.argmax(1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, p[np.arange(len(texts)), best], 0.0)


def features(idf: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[buckets]


def _frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """Document frequency of each bucket over all rows: one partial sum for each task, then one sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, text, _SLICE, _ROWS):
                _, buckets, _, lettered = grams(part.column(0).to_pylist())
                seen[:WIDTH] += np.bincount(buckets, minlength=WIDTH)
                n += int(lettered.sum())
        seen[WIDTH] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    sums = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WIDTH + 1, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out[:WIDTH], int(out[WIDTH])


def fit(docs: DataFrame, key: str, text: str, language: str, per_language: int = 1500, epochs: int = 3) -> Model:
    """Learn from all rows of ``docs``; see the module's head for what is sampled and what isn't.

    ``per_language`` bounds the rows of each language that the weights are fitted on.
    """
    known = docs.where(F.col(f"`{language}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(f"`{language}`").count().collect()}
    if not totals:
        return Model([], np.zeros(WIDTH), np.zeros((WIDTH, 0)), np.zeros(0), 1.0)
    df, n = _frequencies(known, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.lit(0.0)
    for name, count in totals.items():
        share = F.when(F.col(f"`{language}`") == name, F.lit(min(1.0, per_language / count))).otherwise(share)
    h = F.xxhash64(F.lit("language"), F.col(f"`{key}`"), F.col(f"`{text}`"))
    drawn = known.where(F.pmod(h, F.lit(1 << 30)) / float(1 << 30) < share)
    # rows of equal key and text share a draw and take part once
    picked = drawn.select(F.col(f"`{language}`").alias("language"), F.col(f"`{text}`").alias("text"), h.alias("h")).dropDuplicates(["language", "h"]).select("language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE, _ROWS):
                rows, buckets, counts, _ = grams(part.column(1).to_pylist())
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                pair = [(buckets[a:b].astype("<u2").tobytes(), np.minimum(counts[a:b], 65535).astype("<u2").tobytes()) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p[0] for p in pair], pa.binary()), pa.array([p[1] for p in pair], pa.binary())], names=["language", "at", "counts"])

    sample = picked.mapInArrow(run, "language string, at binary, counts binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["language"], r["at"], r["counts"]))
    languages = sorted(totals)
    rows, truth = [], []
    for r in sample:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        if len(at):
            x = features(idf, at, np.frombuffer(r["counts"], "<u2").astype(np.float64))
            rows.append((np.append(at, WIDTH), np.append(x / np.sqrt((x * x).sum()), 1.0)))
            truth.append(languages.index(r["language"]))
    truth = np.array(truth, np.int64)
    held = np.arange(len(rows)) % 5 == 0
    target = np.eye(len(languages))[truth] if len(rows) else np.zeros((0, len(languages)))
    learner = Ftrl(WIDTH + 1, len(languages), alpha=0.3, l1=0.02, l2=0.02)
    weights = learner.fit([r for r, h in zip(rows, held) if not h], target[~held], epochs)
    scores = np.array([x @ weights[at] for (at, x), h in zip(rows, held) if h]).reshape(-1, len(languages))
    heat = temperature(scores, truth[held])
    return Model(languages, idf, weights[:WIDTH], weights[WIDTH], heat)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``. One narrow stage; the model is of fixed size for a number of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        names, scores = [], []
        for piece in slices(part.select([text]), text, _SLICE, _ROWS):
            a, b = shared.value.predict(piece.column(0).to_pylist())
            names += a
            scores.append(b)
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(np.concatenate([np.zeros(0), *scores]))}

    return append(docs, compute, fields, text, keep)


def held_out(key: Column) -> Column:
    """Rows that are never learnt from: CRC-32 of the key's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
