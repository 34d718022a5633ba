"""Finds the rows of a table that some other table names, without shuffling the table.

Rows are named by 64-bit hashes. The names become a bitmap that is itself a small table, (word, bits),
of at most ``WORDS`` rows whatever the number of names, so that it may always be broadcast. A row whose
bit is not set is certainly not named; one whose bit is set may be, and only such rows need go on to a
join or an exact test. SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowkit import spare

#: Words of 64 bits in a bitmap: some 40 MB when broadcast and full.
WORDS = 1 << 20


def _word(name: str) -> Column:
    return F.shiftright(F.col(f"`{name}`"), 6).bitwiseAND(F.lit(WORDS - 1).cast("long"))


def _bit(name: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(`{name}` & 63 as int))")


def places(named: DataFrame, name: str, flags: str | None = None) -> DataFrame:
    """The bitmap of a column of hashes; with ``flags`` each word also has the union of its rows' flags (a long)."""
    union = [F.bit_or(F.col(f"`{flags}`")).alias("flags")] if flags else []
    return named.where(F.col(f"`{name}`").isNotNull()).groupBy(_word(name).alias("word")).agg(F.bit_or(_bit(name)).alias("bits"), *union)


def place(df: DataFrame, name: str, bitmap: DataFrame, mark: str) -> DataFrame:
    """Add ``mark``: whether a row may be named or, of a bitmap with flags, the flags it may have (0: none)."""
    word, bits, flags = spare(df, "word", "bits", "flags")
    table = bitmap.withColumnsRenamed({"word": word, "bits": bits, "flags": flags})
    joined = df.withColumn(word, _word(name)).join(F.broadcast(table), word, "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(_bit(name)) != 0, F.lit(False))
    if flags in table.columns:
        hit = F.when(hit, F.col(flags)).otherwise(F.lit(0).cast("long"))
    return joined.withColumn(mark, hit).drop(word, bits, flags)
