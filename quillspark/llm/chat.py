"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A layout is known by the hash of its nested field paths (``messages[].role`` and so on). Registered
layouts say, as data, where a conversation's turns, roles and texts are; the mapping is turned into
column expressions that give one row for each turn. Columns beside a layout's own don't matter.
``from_json_rows`` does the same for JSON strings whose layout differs from row to row.

The conversation's own column is no part of the layout.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and roles a backslash is
doubled and a backslash goes after the first character of each control string, so that no control
string is left inside; reading back drops each first backslash. Roles also escape line ends.

Turns are dealt by ranges of (conversation, turn), so a conversation with very many turns is spread
over tasks, and written as parts of at most ``part_turns`` turns or ``part_chars`` characters; the
parts of a conversation joined in order are its formatted text. Nothing gathers a conversation.

Defined results: null texts and roles count as empty; rows with a null conversation form one
conversation of their own; turns with equal numbers (nulls first) go by role, then text; repeated
rows are repeated turns; a conversation whose list of messages is null or empty has no turns, and its
formatted text is empty; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates; none overlaps or holds another.
CONTROLS = [OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_BEGINNING = 32
_HEAD = re.compile(r"((?:\\.|[^\\\n])*)\n", re.S)


# ---- layouts ---------------------------------------------------------------------------------


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of all leaves of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return set().union(*(field_paths(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind.fields)) if kind.fields else set()
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return {at.lower()}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, paths) for records with a fixed order of turns; or ``each`` = (array, role, text); or ``rows`` = (turn, role, text) for one row a turn."""

    name: str
    paths: frozenset
    turns: tuple = ()
    each: tuple = ()
    rows: tuple = ()
    roles: dict = field(default_factory=dict, hash=False)

    @property
    def fingerprint(self) -> str:
        return fingerprint(set(self.paths))


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = [
    Layout("turn rows", frozenset({"turn", "role", "text"}), rows=("turn", "role", "text")),
    Layout("messages", frozenset({"messages[].role", "messages[].content"}), each=("messages", "role", "content")),
    Layout("from and value", frozenset({"conversations[].from", "conversations[].value"}), each=("conversations", "from", "value"), roles=_SPEAKERS),
    Layout("instruction with input", frozenset({"instruction", "input", "output"}), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", frozenset({"instruction", "output"}), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt and completion", frozenset({"prompt", "completion"}), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", frozenset({"prompt", "response"}), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", frozenset({"question", "answer"}), turns=(("user", ("question",)), ("assistant", ("answer",)))),
]
REGISTRY = {layout.fingerprint: layout for layout in LAYOUTS}


def select_layout(paths: set[str], registry: dict[str, Layout] | None = None) -> Layout | None:
    """The layout whose fingerprint is that of the paths.

    Paths beside a layout's own don't matter: where the fingerprint of all isn't known, paths that no
    layout has are left out, and then the fingerprints of smaller parts are looked up, largest first.
    """
    registry = registry or REGISTRY
    known = set().union(*(x.paths for x in registry.values()))
    for part in (paths, paths & known):
        if (found := registry.get(fingerprint(part))) is not None:
            return found
    parts = sorted({frozenset(paths & x.paths) for x in registry.values()}, key=lambda p: (-len(p), sorted(p)))
    return next((found for p in parts if (found := registry.get(fingerprint(set(p)))) is not None), None)


def canonical_turns(df: DataFrame, conversation: str, registry: dict[str, Layout] | None = None) -> DataFrame:
    """(conversation, turn, role, text), one row for each turn, from any registered layout.

    A conversation whose list of messages is null or empty gives one row with null turn, role and text;
    in the rows of turns neither role nor text is ever null.
    """
    paths = set().union(*(field_paths(f.dataType, f.name) for f in df.schema.fields if f.name.lower() != conversation.lower()))
    layout = select_layout(paths, registry)
    if layout is None:
        raise ValueError(f"no layout is registered for these fields: {sorted(paths)}")
    key = F.col(f"`{conversation}`").alias("conversation")

    def named(role: Column) -> Column:
        role = F.coalesce(role.cast("string"), F.lit(""))
        for old, new in layout.roles.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return role.alias("role")

    words = lambda c: F.coalesce(c.cast("string"), F.lit("")).alias("text")
    if layout.rows:
        turn, role, text = layout.rows
        return df.select(key, F.col(turn).cast("long").alias("turn"), named(F.col(role)), words(F.col(text)))
    if layout.each:
        path, role, text = layout.each
        flat = df.select(key, F.posexplode_outer(path).alias("turn", "m"))
        said = lambda c, name: F.when(F.col("turn").isNotNull(), c).alias(name)
        return flat.select("conversation", F.col("turn").cast("long"), said(named(F.col(f"m.`{role}`")), "role"), said(words(F.col(f"m.`{text}`")), "text"))
    joined = [F.struct(named(F.lit(role)), F.array_join(F.filter(F.array(*[F.col(p).cast("string") for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n").alias("text")) for role, parts in layout.turns]
    flat = df.select(key, F.posexplode(F.array(*joined)).alias("turn", "m"))
    return flat.select("conversation", F.col("turn").cast("long"), "m.role", "m.text")


def json_paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(json_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(json_paths(v, at + "[]") for v in value)) if value else set()
    return {at.lower()}


def _json_schema(layout: Layout) -> T.StructType:
    if layout.each:
        path, role, text = layout.each
        return T.StructType([T.StructField(path, T.ArrayType(T.StructType([T.StructField(role, T.StringType()), T.StructField(text, T.StringType())])))])
    return T.StructType([T.StructField(p, T.StringType()) for p in sorted(layout.paths)])


def from_json_rows(df: DataFrame, conversation: str, json: str) -> tuple[DataFrame, DataFrame]:
    """Canonical turns of JSON strings of mixed layouts, and the rows whose layout isn't registered."""
    import json as codec

    @F.pandas_udf("string")
    def layout_of(column):
        def one(s):
            try:
                found = select_layout(json_paths(codec.loads(s)))
            except (TypeError, ValueError):
                return None
            return None if found is None else found.fingerprint

        return column.map(one)

    marked = df.select(F.col(f"`{conversation}`").alias("conversation"), F.col(f"`{json}`").alias("body"), layout_of(F.col(f"`{json}`")).alias("print"))
    marked = written(marked, "layouts")  # each text is parsed for its layout once
    turns = None
    for layout in LAYOUTS:
        if layout.rows:
            continue
        rows = marked.where(F.col("print") == layout.fingerprint).select("conversation", F.from_json("body", _json_schema(layout)).alias("j")).select("conversation", "j.*")
        part = canonical_turns(rows, "conversation", {layout.fingerprint: layout})
        turns = part if turns is None else turns.unionByName(part)
    return turns, marked.where(F.col("print").isNull()).select("conversation", "body")


# ---- template --------------------------------------------------------------------------------


def escape(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text and the text's place for each turn of a formatted part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a turn should begin here")
        head = _HEAD.match(formatted, at + len(OPEN))
        stop = formatted.index(CLOSE + "\n", head.end())
        yield unescape(head[1]), unescape(formatted[head.end() : stop]), head.end(), stop
        at = stop + len(CLOSE) + 1


PARTS = T.StructType([
    T.StructField("task", T.IntegerType()),
    T.StructField("part", T.LongType()),
    T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("loss_mask", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])


def format_conversations(turns: DataFrame, learned: str = "assistant", part_turns: int = 256, part_chars: int = 1 << 20) -> DataFrame:
    """Formatted parts of canonical turns: conversation, task, part (order: task, then part), n_turns, formatted, loss_mask.

    ``loss_mask`` holds the places (code points, end exclusive) of the texts whose role is ``learned``.
    A row with neither role nor text (null) says that there is such a conversation: without any turn it
    gives an empty part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([turns.schema["conversation"], *PARTS.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        key, pieces, mask, size, count, serial = None, [], [], 0, 0, 0
        rows: list = []

        def flush() -> None:
            nonlocal pieces, mask, size, count, serial
            if count:
                rows.append((key[0], task, serial, count, "".join(pieces), mask))
                serial += 1
            pieces, mask, size, count = [], [], 0, 0

        def emit() -> pa.RecordBatch:
            columns = list(zip(*rows))
            columns[5] = [[{"begin": a, "end": b} for a, b in m] for m in columns[5]]
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            rows.clear()
            return out

        held = 0
        for batch in batches:
            for conversation, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                fresh, silent = key is None or key[0] != conversation, role is None and text is None
                if fresh or count >= part_turns or size >= part_chars:
                    held += size + 64
                    flush()
                    key = (conversation,)
                    if fresh and silent:
                        rows.append((conversation, task, serial, 0, "", []))
                        serial += 1
                    if held > 4 << 20:
                        yield emit()
                        held = 0
                if silent:
                    continue
                body, begin, end = format_turn(role, text)
                if role == learned:
                    mask.append((size + begin, size + end))
                pieces.append(body)
                size += len(body)
                count += 1
        flush()
        if rows:
            yield emit()

    order = ["conversation", "turn", "role", "text"]
    # beginnings go in the order of the whole; range bounds are sampled on the driver, so they hold no whole texts
    ranges = ["conversation", "turn", F.substring("role", 1, _BEGINNING), F.substring("text", 1, _BEGINNING)]
    return turns.select(*order).repartitionByRange(*ranges).sortWithinPartitions(*order).mapInArrow(run, schema)


DIGEST = [
    T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()),
]


def digest_conversations(parts: DataFrame) -> DataFrame:
    """Read formatted parts back: one row for each conversation with digests of its turns and of the text under the loss mask.

    A conversation's parts pass through one task in order, as a digest must; only hash states and the
    part at hand are in memory.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([parts.schema["conversation"], *DIGEST])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def close() -> None:
            if key is not None:
                rows.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows.clear()
            return out

        for batch in batches:
            conversations, formatted, masks = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conversation", "formatted", "loss_mask"))
            for conversation, body, mask in zip(conversations, formatted, masks):
                if key is None or key[0] != conversation:
                    close()
                    key, state = (conversation,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_turns(body):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for place in mask:
                    learned = unescape(body[place["begin"] : place["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(body)
            if len(rows) >= 5000:
                yield emit()
        close()
        if rows:
            yield emit()

    order = ["conversation", "task", "part"]
    return parts.select(*order, "formatted", "loss_mask").repartition("conversation").sortWithinPartitions(*order).mapInArrow(run, schema)
