"""Greedy one-to-one matching of weighted pairs without an order of all pairs in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def greedy(pairs: DataFrame, left: list[str], right: list[str], order: list[Column]) -> DataFrame:
    """The pairs that are taken when all are gone through in order and each end is taken once: columns left and right.

    A pair that comes first for both its ends is taken whatever comes before it elsewhere. So each round takes all
    these at once and drops the pairs that share an end with them, until none is left; ties are broken by ``left``, then
    ``right``, as they would be in one list. A round is two aggregations, combined before the shuffle, so an end of very
    many pairs is no hot key; rounds are as many as the longest chain of pairs that wait for one another. Null ends match nothing.
    """
    ends = F.struct(*[F.col(c) for c in left]), F.struct(*[F.col(c) for c in right])
    known = pairs.dropna(subset=[*left, *right]).select(ends[0].alias("l"), ends[1].alias("r"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("o"))
    open_, taken = _kept(known, "pairs"), []
    while True:
        by_left = open_.groupBy("l").agg(F.min(F.struct("o", "l", "r")).alias("b"))
        by_right = open_.groupBy("r").agg(F.min(F.struct("o", "l", "r")).alias("b"))
        first = by_left.select("b").join(by_right.select("b"), "b").select("b.l", "b.r")
        taken.append(_kept(first, "taken"))
        if taken[-1].isEmpty():
            break
        open_ = _kept(open_.join(taken[-1].select("l"), "l", "left_anti").join(taken[-1].select("r"), "r", "left_anti"), "pairs")
    out = taken[0]
    for t in taken[1:-1]:
        out = out.unionByName(t)
    return out.select("l.*", "r.*")
