"""Text expressions: normalisation, error rates, masks, digests. Column in, Column out, JVM only but for the distance of long texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters outside ASCII that case folding turns into ASCII letters, by the rule of Unicode as Python has it.
FOLDED = {chr(c): re.sub("[^a-z0-9]", " ", chr(c).casefold()) for c in range(0x80, 0x10000) if re.search("[a-z]", chr(c).casefold())}


def folded(text: Column) -> Column:
    """The text with ligatures and the like in ASCII letters; other characters stay."""
    out = text
    for char, letters in FOLDED.items():
        out = F.replace(out, F.lit(char), F.lit(letters))
    return F.when(text.rlike("[" + "".join(FOLDED) + "]"), out).otherwise(text)


def normalize(text: Column) -> Column:
    """Case-folded text with everything but ASCII letters and digits squeezed to single blanks."""
    return F.trim(F.regexp_replace(F.lower(folded(text)), "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    """White space, form feeds included, squeezed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def verification_form(text: Column) -> Column:
    """The form in which redacted and remaining text are compared: lower case, letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def cer(reference: Column, prediction: Column) -> Column:
    """Character error rate of normalised texts without blanks."""
    r, h = (F.replace(normalize(x), F.lit(" "), F.lit("")) for x in (reference, prediction))
    return F.levenshtein(r, h) / F.greatest(F.lit(1), F.length(r))


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of tokens: rows of the table as a fold."""
    first = F.sequence(F.lit(0), F.size(b))

    def next_row(previous: Column, token: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            cost = F.when(token == F.get(b, j - 1), 0).otherwise(1)
            return F.concat(row, F.array(F.least(F.get(previous, j - 1) + cost, F.get(row, j - 1) + 1, F.get(previous, j) + 1)))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.get(previous, F.lit(0)) + 1), cell)

    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, first, next_row), -1))


def edit_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two token sequences of any length: a row of the table is two bit vectors (Myers, Hyyrö)."""
    if not len(a) or not len(b):
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | 1 << i
    every, last, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0  # where a row's value is one more or one less than the value before it
    for token in b:
        equal = places.get(token, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more, less = down | (every & ~(horizontal | up)), up & horizontal
        distance += bool(more & last) - bool(less & last)
        more, less = more << 1 | 1, less << 1
        up, down = every & (less | ~(vertical | more)), every & more & vertical
    return distance


@F.pandas_udf(T.IntegerType())
def long_token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """``token_distance`` for arrays of any length, whose table is too large for a fold. Arrow batches."""
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


def wer(reference: Column, prediction: Column) -> Column:
    """Word error rate of whole texts."""
    r, h = tokens(reference), tokens(prediction)
    return long_token_distance(r, h) / F.greatest(F.lit(1), F.size(r))


def score_field(reference: Column, prediction: Column) -> Column:
    """struct(exact, cer, accuracy) of a predicted field."""
    rate = cer(reference, prediction)
    return F.struct((normalize(reference) == normalize(prediction)).alias("exact"), rate.alias("cer"), F.greatest(F.lit(0.0), 1 - rate).alias("accuracy"))


def mask(text: Column) -> Column:
    """First and last character with up to twelve stars between; short texts only stars."""
    t = F.trim(text)
    n = F.length(t)
    inner = F.repeat(F.lit("*"), F.least(n - 2, F.lit(12)))
    return F.when(n == 0, F.lit("")).when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(t, 1, 1), inner, F.substring(t, -1, 1)))


def stable_seed(text: Column, base: int, modulus: int = 2**31 - 1) -> Column:
    """A seed from the first eight hex digits of SHA-256, offset by ``base``."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") + base) % modulus


def document_id(stem: Column, digest: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` of the stem (32 at most) and sixteen digits of the digest; ``document`` if nothing is left."""
    clean = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", ""), 1, 32)
    return F.concat(F.when(clean == "", F.lit("document")).otherwise(clean), F.lit("-"), F.substring(digest, 1, 16))


def clean_artifacts(text: Column) -> Column:
    """OCR rests: line ends, runs of blanks, rules at the end, a doubled letter in one product token."""
    out = squeeze(text)
    out = F.trim(F.regexp_replace(out, r"\s*[|_]+\s*$", ""))
    return F.regexp_replace(out, r"\bmMRNA\b", "mRNA")


def route(path: Column) -> Column:
    """A request path with identifiers replaced, so that metrics have few labels."""
    trimmed = F.concat(F.lit("/"), F.regexp_replace(path, "^/+|/+$", ""))
    return F.regexp_replace(trimmed, "(?<=/)(documents|jobs|batches|artifacts)/[^/]+", "$1/{id}")


def flat_matrix(matrix: Column) -> Column:
    """Cells of a matrix that aren't null or blank, trimmed and joined by blanks."""
    return F.array_join(F.filter(F.transform(F.flatten(matrix), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), " ")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
