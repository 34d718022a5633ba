"""Quality classifier: a weak-label model and a hashed linear scorer.

Two questions are asked of a text: is it *sound* prose, and is it *safe*? For each, several heuristic
labellers vote yes, no or not at all; each looks at something of its own (signs, stutter, capitals,
words of contempt, names called, address), they overlap and err. Expectation-maximisation over their
votes estimates how each labeller votes on good and on bad texts, and from that the probability of yes
for each text. With these posteriors as targets a linear scorer over hashed features (words, beginnings
of words, shape statistics) is trained by follow-the-regularised-leader; it then scores every text.

Annotations (tables of labels) take part as labellers of their own, where there are any. The fit is on
a bounded sample, about ``sample_rows`` documents chosen by a hash of key and text: half of them from all
documents, a quarter from those that an annotation calls bad and a quarter from those that none does,
as far as there are any; of the texts that share an annotated key one takes part by its annotation, and
rows with equal key and text take part once. Scoring covers all rows.

Defined results: null and empty texts, and texts without words, are rejected with score 0; rows
without annotations are scored all the same; labels that match no document, or are empty or null, count
as none; without any row to fit on every text with words is kept with score 0.5; equal rows give equal
results; an empty table gives no rows; input columns with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import LOWER, NOT_BLANK, U64, Tokens, _BYTE_POWERS, _BYTE_VALUES, append, byte_set, mix, release, rolling, slices, text_bytes
from .ftrl import Ftrl, temperature

WIDTH = 1 << 18
SLICE = 1 << 19  # bytes of text that are looked at together: what is computed of them takes many times as much
_LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: English words of contempt (what somebody is like) and names that people call others; no word is on both lists.
CONTEMPT = ["disgusting", "dumb", "filthy", "hateful", "pathetic", "stupid", "useless", "vile", "worthless"]
NAMES = ["bastard", "clown", "coward", "creep", "fool", "idiot", "jerk", "loser", "moron", "scum", "trash"]
#: Words by which English addresses a reader.
ADDRESS = ["you", "your", "yours", "yourself"]
YES, NO, NONE = 0, 1, 2


class Batch:
    """Everything that labellers and scorer ask of a slice of texts, computed in numpy."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_bytes(column)
        self.rows = len(self.offsets) - 1
        self.words = Tokens(self.data, self.offsets, NOT_BLANK)
        self.letters = Tokens(self.data, self.offsets, _LETTERS)
        self.word_hash, self.letter_hash = self.words.hashes(), self.letters.hashes(LOWER)
        size = np.maximum(np.diff(self.offsets), 1)
        per = lambda table: self._sums(table[self.data]) / size
        n = np.maximum(self.words.counts, 1)
        distinct = np.array([len(np.unique(self.word_hash[a:b])) for a, b in zip(self.words.first.tolist(), self.words.first[1:].tolist())]) if self.rows else np.zeros(0)
        self.stats = np.stack([
            per(byte_set((0x21, 0x21), (0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x40), (0x5B, 0x60), (0x7B, 0x7E))),  # signs that prose has few of
            1 - distinct / n,  # words that have occurred before
            per(byte_set((0x41, 0x5A))),  # capitals
            per(byte_set((0x30, 0x39))),  # digits
            self._sums((self.words.stops - self.words.starts), self.words.first) / n,  # length of words
            self._sums(self._single(), self.words.first) / n,  # words of one sign, such as rules of tables
            self._sums(self._repeats(), self.words.first) / n,  # words that repeat the one before
            np.log1p(self.words.counts),
        ], 1) if self.rows else np.zeros((0, 8))

    def _sums(self, values: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = self.offsets if at is None else at
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[at[1:]] - total[at[:-1]]).astype(np.float64)

    def _single(self) -> np.ndarray:
        w = self.words
        return (w.stops - w.starts == 1) & ~_LETTERS[self.data[w.starts]] & ~byte_set((0x30, 0x39))[self.data[w.starts]]

    def _repeats(self) -> np.ndarray:
        same = np.zeros(len(self.word_hash), bool)
        same[1:] = self.word_hash[1:] == self.word_hash[:-1]
        inner = self.words.first[:-1]
        same[inner[inner < len(same)]] = False
        return same

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, bucket) pairs, sorted: words, beginnings of four to six bytes, and shape statistics in steps."""
        t = self.letters
        row = np.repeat(np.arange(self.rows), t.counts)
        found = [(row, self.letter_hash)]
        length = t.stops - t.starts
        for k in (4, 5, 6):
            long = length >= k
            h = rolling(_BYTE_VALUES[LOWER][self.data], t.starts[long], t.starts[long] + k, _BYTE_POWERS)
            found.append((row[long], mix(h + U64(1000 + k))))
        steps = np.minimum(np.floor(self.stats * np.array([50, 20, 20, 20, 1, 20, 20, 1])), 60).astype(np.int64)
        for s in range(steps.shape[1]):
            found.append((np.arange(self.rows), mix((steps[:, s] + 1000 * (s + 1)).astype(U64))))
        key = np.concatenate([r * WIDTH + (h >> U64(46)).astype(np.int64) for r, h in found])
        key = np.unique(key)
        return key // WIDTH, key % WIDTH

    def count(self, words: list[str]) -> np.ndarray:
        """How many words of each text are among the given lower-case ones."""
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        wanted = Tokens(raw, np.concatenate([[0], ends]).astype(np.int64), _LETTERS).hashes(LOWER)
        return self._sums(np.isin(self.letter_hash, wanted), self.letters.first)


def heuristic_votes(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Votes on soundness (rows x labellers) and on safety. Every labeller can vote both ways."""
    signs, repeated, capitals, digits, length, single, stutter, size = batch.stats.T
    vote = lambda no, yes: np.where(no, NO, np.where(yes, YES, NONE))
    sound = np.stack([
        vote(signs > 0.06, signs < 0.02),
        vote(stutter > 0.2, stutter < 0.05),
        vote(repeated > 0.85, repeated < 0.6),
        vote(capitals > 0.4, capitals < 0.15),
        vote(single > 0.2, single < 0.05),
        vote((length < 2.5) | (length > 14), (length > 3.5) & (length < 9)),
        vote(digits > 0.3, digits < 0.05),
        vote(size < np.log1p(3), size > np.log1p(20)),
    ], 1)
    words = np.maximum(batch.letters.counts, 1)
    enough = batch.letters.counts >= 5
    contempt, names, address = (batch.count(x) for x in (CONTEMPT, NAMES, ADDRESS))
    safe = np.stack([
        vote(contempt > 0, enough),
        vote(names > 0, enough),
        vote((address / words > 0.12) & (address > 2), enough & (address / words < 0.04)),
    ], 1)
    return sound, safe


def posterior(votes: np.ndarray, theta: np.ndarray, prior: float) -> np.ndarray:
    """Probability of yes by the votes' likelihoods: ``theta[j, y, v]`` is how often labeller j, where it votes, votes v (YES, NO) on texts of truth y (1: yes)."""
    odds = np.full(len(votes), np.log(prior / (1 - prior)))
    for j, column in enumerate(votes.T):
        for v in (YES, NO):
            odds += (column == v) * np.log(theta[j, 1, v] / theta[j, 0, v])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def weak_labels(votes: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation: the probability of yes for each row, each labeller's accuracy, and its ``theta``.

    ``votes`` is rows x labellers of YES, NO and NONE; a labeller that doesn't vote says nothing. The
    start and a few pseudo-votes have it that a good text has hardly ever the fault that a labeller looks
    for, and that a bad text has every third of them; no labeller's vote is ever taken for its opposite.
    It stops when probabilities rest.
    """
    n, k = votes.shape
    pseudo = np.array([[2.67, 1.33], [3.96, 0.04]])  # on bad texts: YES, NO; on good ones
    theta, prior = np.tile(pseudo / 4, (k, 1, 1)), 0.5
    p = posterior(votes, theta, prior)
    for _ in range(rounds):
        for j, column in enumerate(votes.T):
            counts = pseudo + [[((1 - p) * (column == v)).sum() for v in (YES, NO)], [(p * (column == v)).sum() for v in (YES, NO)]]
            shares = counts / counts.sum(1, keepdims=True)
            if shares[1, YES] < shares[0, YES]:  # an inverted labeller says nothing
                shares[:] = counts.sum(0) / counts.sum()
            theta[j] = shares
        prior = float(np.clip((p.sum() + 4) / (n + 5), 0.02, 0.98))
        new = posterior(votes, theta, prior)
        moved = np.abs(new - p).max() if n else 0.0
        p = new
        if moved < 1e-5:
            break
    cast = np.maximum((votes != NONE).sum(0), 1)
    agree = ((votes == YES) * p[:, None] + (votes == NO) * (1 - p)[:, None]).sum(0)
    return p, agree / cast, theta


@dataclass
class Scorer:
    """Two linear scores over hashed features: log-odds of sound and of safe."""

    weights: np.ndarray  # WIDTH + 1 x 2
    heat: tuple[float, float]
    labellers: tuple[np.ndarray, np.ndarray]

    def probabilities(self, batch: Batch) -> np.ndarray:
        row, bucket = batch.features()
        out = np.stack([np.bincount(row, self.weights[bucket, c], batch.rows) + self.weights[WIDTH, c] for c in (0, 1)], 1)
        return 1 / (1 + np.exp(-np.clip(out / np.array(self.heat), -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame | None, key: str, text: str, rows: int) -> DataFrame:
    """About ``rows`` documents with their annotations (null where there are none), whatever the size of the tables."""
    chance = lambda word, *of: F.pmod(F.xxhash64(F.lit(word), *of), F.lit(1 << 30)) / float(1 << 30)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text"))
    every = chance("any", "key", "h") < rows / (2 if labels is not None else 1) / max(1, docs.count())
    none = F.lit(None).cast("int")
    if labels is None:
        return texts.where(every).dropDuplicates(["key", "h"]).select("key", "text", none.alias("quality"), none.alias("toxic"))
    notes = labels.select(F.col(f"`{key}`").alias("key"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("key is not null")
    bad = F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))
    count = {r[0]: r[1] for r in notes.groupBy(bad.alias("bad")).count().collect()}
    # about half of ``rows`` pass, whatever the size of the table: that bounds what is broadcast
    share = {b: min(1.0, rows / 4 / max(1, count.get(b, 0))) for b in (True, False)}
    notes = notes.where(chance("quality", "key") < F.when(bad, F.lit(share[True])).otherwise(F.lit(share[False])))
    notes = notes.groupBy("key").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    one = texts.select("key", "h").join(F.broadcast(notes.select("key")), "key").groupBy("key").agg(F.min("h").alias("own"))
    joined = texts.join(F.broadcast(notes.join(one, "key")), "key", "left")
    return joined.where(F.coalesce(F.col("h") == F.col("own"), F.lit(False)) | every).dropDuplicates(["key", "h"]).select("key", "text", "quality", "toxic")


def fit(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id", text: str = "text", sample_rows: int = 12000, epochs: int = 4) -> Scorer:
    """Fit on about ``sample_rows`` documents, a documented bound; annotations, if any, are one more labeller.

    ``labels`` has ``key``, ``quality`` (1 good) and ``toxic`` (1 bad); either may be null.
    """
    picked = _sample(docs, labels, key, text, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                b = Batch(part.column(1))
                sound, safe = heuristic_votes(b)
                row, bucket = b.features()
                cuts = np.searchsorted(row, np.arange(b.rows + 1))
                blobs = [bucket[x:y].astype("<u4").tobytes() for x, y in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(2), part.column(3), pa.array(sound.tolist(), pa.list_(pa.int32())), pa.array(safe.tolist(), pa.list_(pa.int32())), pa.array(blobs, pa.binary())], names=["key", "quality", "toxic", "sound", "safe", "at"])
        release()

    scorer = _trained(picked.mapInArrow(run, "key string, quality int, toxic int, sound array<int>, safe array<int>, at binary").toArrow(), epochs)
    release()  # the sample has been the driver's
    return scorer


def _trained(table: pa.Table, epochs: int) -> Scorer:
    """Weak labels and linear scores of the sample's votes, annotations and features."""
    if not table.num_rows:
        return Scorer(np.zeros((WIDTH + 1, 2)), (1.0, 1.0), (np.zeros(0), np.zeros(0)))
    table = table.set_column(0, "key", pc.fill_null(table.column("key"), "")).sort_by([("key", "ascending"), ("at", "ascending")])  # whatever order tasks end in
    examples = [np.append(np.frombuffer(blob.as_buffer(), "<u4"), np.uint32(WIDTH)) for blob in table.column("at")]
    table = table.drop_columns(["key", "at"])
    note = {c: np.array([-1 if v is None else v for v in table.column(c).to_pylist()]) for c in ("quality", "toxic")}
    votes = {c: np.array(table.column(c).to_pylist(), np.int64) for c in ("sound", "safe")}
    annotated = {"sound": np.where(note["quality"] == 1, YES, np.where(note["quality"] == 0, NO, NONE)), "safe": np.where(note["toxic"] == 0, YES, np.where(note["toxic"] == 1, NO, NONE))}
    held = np.arange(table.num_rows) % 5 == 0
    weights, heat, tables = [], [], []
    for question in ("sound", "safe"):
        p, accuracy, _ = weak_labels(np.concatenate([annotated[question][:, None], votes[question]], 1))
        target = np.stack([1 - p, p], 1)
        learner = Ftrl(WIDTH + 1, 2, alpha=0.05, l1=0.3, l2=1.0)
        w = learner.fit_sets([e for e, h in zip(examples, held) if not h], target[~held], epochs)
        scores = np.array([w[at].sum(0) for at, h in zip(examples, held) if h]).reshape(-1, 2)
        heat.append(temperature(scores, (p[held] >= 0.5).astype(np.int64)))
        weights.append(w[:, 1] - w[:, 0])
        tables.append(accuracy)
    return Scorer(np.stack(weights, 1).astype(np.float64), (heat[0], heat[1]), (tables[0], tables[1]))


RESULT = [T.StructField("quality_score", T.DoubleType()), T.StructField("p_sound", T.DoubleType()), T.StructField("p_safe", T.DoubleType()), T.StructField("keep", T.BooleanType())]


def score(docs: DataFrame, scorer: Scorer, text: str = "text", keep: list[str] | None = None, only_kept: bool = False) -> DataFrame:
    """Add ``p_sound``, ``p_safe``, ``quality_score`` (the lesser of them) and ``keep`` (score of at least a half). One narrow stage.

    ``only_kept`` leaves out the rows that are rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def compute(part: pa.RecordBatch) -> dict[str, pa.Array]:
        found = []
        for piece in slices(part, text, SLICE):
            batch = Batch(piece.column(piece.schema.get_field_index(text)))
            found.append(shared.value.probabilities(batch) * (batch.words.counts > 0)[:, None])
        p = np.concatenate(found) if found else np.zeros((0, 2))
        least = p.min(1) if len(p) else np.zeros(0)
        return {"quality_score": pa.array(least), "p_sound": pa.array(p[:, 0]), "p_safe": pa.array(p[:, 1]), "keep": pa.array(least >= 0.5)}

    return append(docs, compute, RESULT, text, keep, choose=(lambda new: new["keep"]) if only_kept else None)
