"""Repair of the turn structure of conversations at the least cost.

Rows get fault flags from running windows, are collected in order as small structs, and one higher-order
``aggregate`` walks over them: it carries four (cost, audit) structs, one for each state that the roles given so
far can be in (none, system, user, assistant), and takes ``least`` of what the edits of a row make of them. Two
audits of one state and cost never continue one another (more edits would have cost more), so the least so far is
the least in the end, ties included.

A conversation is folded in blocks of ``BLOCK`` rows, each from all states that it may begin in, and blocks are
joined with their neighbours until one is left; that of a conversation of up to ``BLOCK`` rows is one fold. So no
task and no row holds more of a conversation than a block of flags and the audit itself, and running
numbers come from a scan over ranges, however many rows one conversation has.

Defined results: a null key is a key; a null role or text is one space; rows of one turn go by role, then by the
beginning of the text; null turns come first; a conversation of no rows does not appear; an empty table gives no rows; columns that
aren't named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scans import Scan, numbered
from .arrowkit import written

#: Rows that one fold walks over, and blocks that one joins.
BLOCK = 64

_STATES = ["none", "system", "user", "assistant"]
_PATH = "struct<cost:bigint,audit:string>"
#: Beginnings of texts that order the rows of one turn and role, before their digests do.
_BEGINNING = 64


def damaged(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Canonical rows (key, turn, role, text, copy), damaged by the checksum of ``key:turn``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(f"`{key}`"), F.lit(":"), said("turn"))) % 20
    rows = turns.select(F.col(f"`{key}`").alias("key"), "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("key", "turn", "role", "text", F.explode(copies).alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows with place (from 0), before (initial of the row before), first_of_turn and fault (blank, duplicate, truncated or null)."""
    marked = rows.withColumn("digest", F.sha2("text", 256)).withColumn("beginning", F.substring("text", 1, _BEGINNING))
    seen = numbered(marked, ["key", "role", "digest"], ["turn", "copy"], "nth")
    initial = F.substring("role", 1, 1)
    # bounds of ranges are sampled rows, so they hold no whole texts
    order = ["turn", "role", "beginning", "digest", "copy", "nth"]
    scan = Scan(seen, ["key"], order).running({"number": F.lit(1).cast("long")}).previous({"before": initial, "turn_before": F.col("turn")}, first="head")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return scan.rows().select(
        "key", "turn", "role", "text", (F.col("number") - 1).alias("place"), initial.alias("initial"), "before", fault.alias("fault"),
        (F.col("turn").isNotNull() & (F.col("head") | ~F.col("turn").eqNullSafe(F.col("turn_before")))).alias("first_of_turn"),
    )


def _add(path: Column, cost, edit: str | Column) -> Column:
    edit = F.lit(edit) if isinstance(edit, str) else edit
    return F.when(path.isNotNull(), F.struct((path["cost"] + cost).alias("cost"), F.concat(path["audit"], edit).alias("audit")))


def _vector(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _with_inserts(v: Column) -> Column:
    user = F.least(v["user"], _add(F.least(v["none"], v["system"], v["assistant"]), 2, "I"))
    return _vector(v["none"], v["system"], user, F.least(v["assistant"], _add(user, 2, "I")))


def _step(v: Column, row: Column) -> Column:
    """What a row's edits make of the four paths: delete, keep in place, give another role; then inserts."""
    free = ~row["must_go"]
    late = row["late"]
    ready = F.least(v["none"], v["system"], v["assistant"])
    none = _add(v["none"], 3, "D")
    system = F.least(_add(v["system"], 3, "D"), F.when(free & (row["initial"] == "s"), _add(v["none"], late, "K")))
    user = F.least(_add(v["user"], 3, "D"), F.when(free & (row["initial"] == "u"), _add(ready, late, "K")), F.when(free, _add(ready, late + 2, "R")))
    assistant = F.least(_add(v["assistant"], 3, "D"), F.when(free & (row["initial"] == "a"), _add(v["user"], late, "K")), F.when(free, _add(v["user"], late + 2, "R")))
    return _bound(_vector(none, system, user, assistant), _with_inserts)


def _bound(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _begin(state: str | None) -> Column:
    zero, no = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")), F.lit(None).cast(_PATH)
    path = lambda s: (zero if s == (state or "none") else no).cast(_PATH)
    return _vector(*map(path, _STATES)) if state else _with_inserts(_vector(*map(path, _STATES)))


def _folded(rows: DataFrame) -> DataFrame:
    """For each block of rows (key, block) what becomes of the four paths from each state that it may begin in."""
    must = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    late = F.when(F.col("fault") == "truncated", 1).otherwise(0).cast("long")
    small = F.struct("place", "initial", must.alias("must_go"), late.alias("late"))
    blocks = rows.groupBy("key", F.expr(f"place div {BLOCK}").alias("block")).agg(F.array_sort(F.collect_list(small)).alias("r"))
    kind = "struct<" + ",".join(f"{s}:{_PATH}" for s in _STATES) + ">"

    def fold(state: str | None) -> Column:
        return F.aggregate("r", _begin(state).cast(kind), lambda v, row: _step(v, row).cast(kind))

    first = F.col("block") == 0
    folds = [F.when(first, fold(None)).otherwise(fold("none")).alias("from_none")]
    folds += [F.when(~first, fold(s)).alias(f"from_{s}") for s in _STATES[1:]]
    return blocks.select("key", "block", *folds)


def _together(a: Column, b: Column) -> Column:
    """Paths of one block followed by those of the next: for each state between, both parts; the least of them."""

    def one(v: Column) -> Column:
        ends = [F.least(*[F.when(v[s].isNotNull() & b[f"from_{s}"][e].isNotNull(), F.struct((v[s]["cost"] + b[f"from_{s}"][e]["cost"]).alias("cost"), F.concat(v[s]["audit"], b[f"from_{s}"][e]["audit"]).alias("audit"))) for s in _STATES]) for e in _STATES]
        return F.when(v.isNotNull(), _vector(*ends))

    return F.struct(*[one(a[f"from_{s}"]).alias(f"from_{s}") for s in _STATES])


def _joined(blocks: DataFrame) -> DataFrame:
    """Every ``BLOCK`` neighbouring blocks of a key become one."""
    vectors = [f"from_{s}" for s in _STATES]
    groups = blocks.groupBy("key", F.expr(f"block div {BLOCK}").alias("next")).agg(F.array_sort(F.collect_list(F.struct("block", F.struct(*vectors).alias("m")))).alias("b"))
    rest = F.transform(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), lambda x: x["m"])
    kind = blocks.select(F.struct(*vectors).alias("m")).schema["m"].dataType.simpleString()
    whole = F.aggregate(rest, F.get("b", F.lit(0))["m"].cast(kind), lambda a, m: _together(a, m).cast(kind))
    return groups.select("key", F.col("next").alias("block"), whole.alias("m")).select("key", "block", "m.*")


def audits(rows: DataFrame) -> DataFrame:
    """key, cost and audit of the cheapest repair of each conversation, from rows of ``with_faults``."""
    most = rows.agg(F.max("place")).first()[0] or 0
    blocks, left = _folded(rows), most // BLOCK
    while left:
        blocks, left = _joined(written(blocks, "blocks")), left // BLOCK
    best = F.least(F.col("from_none.none"), F.col("from_none.assistant"))
    return blocks.select("key", best.alias("b")).select("key", F.col("b.cost").alias("cost"), F.col("b.audit").alias("audit"))


def diagnosis(rows: DataFrame) -> DataFrame:
    """Faults of each conversation: key, gaps, blank, duplicate, truncated, illegal."""
    follows = F.concat("before", "initial").isin("su", "ua", "au")
    found = rows.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("first_of_turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
        F.count_if(F.col("before").isNotNull() & ~follows).alias("illegal"),
    )
    return found


def _stream(rows: DataFrame, repairs: DataFrame, run, schema: str) -> DataFrame:
    """Each conversation's audit, then its rows in order, to one task."""
    turns = rows.select("key", F.lit(None).cast("string").alias("audit"), "place", "role", "text")
    heads = repairs.select("key", "audit", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return heads.unionByName(turns).repartition("key").sortWithinPartitions("key", "place").mapInArrow(run, schema)


class _Replay:
    """The repaired turns of one conversation, as its rows come in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.last = audit, 0, ""

    def _say(self, role: str, text: str) -> tuple[str, str]:
        self.last = role[:1]
        return role, text

    def _due(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._say(self._due(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._say(role if edit == "K" else self._due(), text)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, tuple[str, str] | None]]:
    """(key, turn) for every repaired turn, and (key, None) where a conversation begins."""
    key, replay = None, None
    for batch in batches:
        for k, audit, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if place < 0:
                if replay:
                    yield from ((key, t) for t in replay.inserts())
                key, replay = k, _Replay(audit)
                yield key, None
            else:
                yield from ((key, t) for t in replay.row(role, text))
    if replay:
        yield from ((key, t) for t in replay.inserts())


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(fields: list[T.StructField]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(fields)
    return schema, to_arrow_schema(schema)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired conversations: key, place (from 0), role, text."""
    schema, arrow = _arrow([rows.schema["key"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        place = 0
        for key, turn in _replayed(batches):
            if turn is None:
                place = 0
            else:
                yield key, place, *turn
                place += 1

    return _stream(rows, repairs, lambda batches: _batches(turns(batches), arrow), schema)


def digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """key and repaired_sha256 (of ``role:text``, joined by newlines); a hash takes a conversation in order, so one task does."""
    schema, arrow = _arrow([rows.schema["key"], T.StructField("repaired_sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, digest, empty = None, None, True
        for key, turn in _replayed(batches):
            if turn is None:
                if digest:
                    yield held, digest.hexdigest()
                held, digest, empty = key, hashlib.sha256(), True
            else:
                digest.update(("" if empty else "\n").encode() + f"{turn[0]}:{turn[1]}".encode())
                empty = False
        if digest:
            yield held, digest.hexdigest()

    return _stream(rows, repairs, lambda batches: _batches(hashed(batches), arrow), schema)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the cheapest repair of each conversation of canonical rows (key, turn, role, text, copy)."""
    flagged = written(with_faults(rows), "turns")
    repairs = written(audits(flagged), "audits")
    same = lambda a, b: a["key"].eqNullSafe(b["key"])
    found, hashed = diagnosis(flagged), digests(flagged, repairs)
    out = repairs.join(found, same(repairs, found)).drop(found["key"])
    return out.join(hashed, same(out, hashed)).drop(hashed["key"])


def repair_damaged(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """``repair`` of all conversations after ``damaged``; those that lost all rows have zeros and an empty audit."""
    fixed = repair(damaged(turns, key))
    every = turns.select(F.col(f"`{key}`").alias("original")).distinct()
    out = every.join(fixed, every["original"].eqNullSafe(fixed["key"]), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("original").alias(key), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
