"""Best-fit packing of tokenised documents into sequences of bounded length.

Two narrow stages. ``encode_pieces`` turns each document into token ids and cuts those that are longer
than a sequence. ``pack`` places pieces by bounded-space online best-fit: a task keeps a fixed number of
open bins, in lists by free space with a bitset of the free spaces in use, so the tightest bin that still
fits is a shift and a lowest set bit away. Where nothing fits and all bins are open, the fullest closes.
Only numbers of pieces reach the second stage, never texts; no stage shuffles. ``sequences`` gathers the
pieces of each sequence, a group that holds at most ``capacity`` tokens.

Defined results: a null or empty text is the end token alone, one piece of length 1; repeated rows are
packed as often as they occur; ties between bins go to the one that came to its free space last;
an empty table gives no pieces; a column that bears the name of a new one is replaced by it; null keys
are kept. The number of a sequence rests on the written table of pieces and on the task that reads it,
so a task that is run again gives the same numbers.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowkit import release, slices, without, written

#: Fixed value: the split of a byte-level tokenizer, as published with its first vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_letters() -> dict[str, int]:
    """How a byte-level vocabulary writes bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of whole texts as the library gives them for a byte-level vocabulary, as bytes (little-endian, 32 bits each).

    A vocabulary whose merges are numbered in their order is a table of ranks, which is encoded without the library's
    bookkeeping of offsets. Texts that hold an added token's string, and other kinds of vocabulary, go to the library.
    """

    def __init__(self, path: str):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = re.compile("|".join(re.escape(a["content"]) for a in told["added_tokens"]) or r"(?!)")
        self.ranked = self._ranked(told)

    def _ranked(self, told: dict):
        """The vocabulary as ranks, if it is one that they describe."""
        import tiktoken

        pre, model = told["pre_tokenizer"] or {}, told["model"]
        odd = [told["normalizer"], told["post_processor"], pre.get("add_prefix_space"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        if any(odd) or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex"):
            return None
        vocab = {k: v for k, v in model["vocab"].items() if v < len(model["vocab"])}
        added = {a["content"] for a in told["added_tokens"]}
        letters = _bytes_of_letters()
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if vocab.get(a + b) != 256 + i:
                return None
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in added}
        if len(ranks) != 256 + len(model["merges"]):
            return None
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranked is None or self.added.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return array("I", ids).tobytes()


PIECES = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def encode_pieces(docs: DataFrame, path: str, text: str = "text", capacity: int = 1024, end_id: int = 2, keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: piece, start, length, ids_crc32 and, unless ``ids`` is false, ids.

    A document is its token ids and ``end_id``. One that is longer than a sequence is cut from its end, so its
    first piece may be shorter than ``capacity``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = PIECES + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    held = [c for c in without(docs, [f.name for f in fields]) if keep is None or c in keep]
    schema = T.StructType([docs.schema[c] for c in held] + fields)
    arrow = to_arrow_schema(schema)
    end = np.asarray([end_id], "<u4").tobytes()
    whole = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                rows, at, cut = [], [], []
                for row, body in enumerate(texts):
                    coded = encoder.encode(body or "") + end
                    edges = [0, *range(len(coded) % whole or whole, len(coded) + 1, whole)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append(row)
                        at.append((i, a // 4, (b - a) // 4, zlib.crc32(memoryview(coded)[a:b])))
                        if ids:
                            cut.append(coded[a:b])
                columns = [part.column(part.schema.get_field_index(c)).take(pa.array(rows)) for c in held]
                columns += [pa.array(c, arrow.field(f.name).type) for c, f in zip(zip(*at), PIECES)]
                if ids:
                    flat = np.frombuffer(b"".join(cut), "<i4")
                    columns.append(pa.ListArray.from_arrays(np.cumsum([0, *(len(c) // 4 for c in cut)], dtype=np.int32), flat))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
        release()

    return docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*held, text])]).mapInArrow(run, schema)


class Bins:
    """Open bins by free space: ``used`` has a bit for each free space that some open bin has."""

    def __init__(self, capacity: int, most: int, number: int = 0):
        self.capacity, self.most, self.number = capacity, most, number
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used, self.open = 0, 0

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.used ^= 1 << free
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fitting = self.used >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.used & -self.used).bit_length() - 1)
            free, chosen = self.capacity, self.number
            self.number += 1
        left = free - length
        if left:
            self.by_free[left].append(chosen)
            self.used |= 1 << left
            self.open += 1
        return chosen, self.capacity - free


def pack(pieces: DataFrame, capacity: int = 1024, open_bins: int = 4096, task_rows: int = 1 << 18) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with a ``length`` of 1 to ``capacity``.

    A task reads about ``task_rows`` pieces, one batch after the other, longest first within a batch of
    arrivals; it keeps ``open_bins`` bins, whatever it reads.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    held = without(pieces, [f.name for f in fields])
    schema = T.StructType([pieces.schema[c] for c in held] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = Bins(capacity, open_bins, TaskContext.get().partitionId() << 36)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy()
            if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= capacity:
                raise ValueError("a piece has 1 to capacity tokens")
            order = np.argsort(-lengths, kind="stable")
            placed = np.empty((2, len(lengths)), np.int64)
            placed[:, order] = np.array([bins.place(n) for n in lengths[order].tolist()], np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in held], pa.array(placed[0]), pa.array(placed[1])], schema=arrow)

    tasks = max(1, -(-pieces.count() // task_rows))
    return pieces.select(*[F.col(f"`{c}`") for c in held]).coalesce(tasks).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, text: str = "text", capacity: int = 1024, end_id: int = 2, keep: list[str] | None = None, ids: bool = True, open_bins: int = 4096) -> DataFrame:
    """Pieces of all documents with their places; ``sequences`` makes the sequences of them."""
    return pack(written(encode_pieces(docs, path, text, capacity, end_id, keep, ids), "pieces"), capacity, open_bins)


def sequences(placed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a sequence: sequence_id, length, ids (of all its pieces, in order) and parts (key, piece, offset, length)."""
    part = F.struct("offset", "length", F.col(f"`{key}`").alias("key"), "piece", "ids")
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return parts.select(
        "sequence_id",
        F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["key"].alias("key"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("parts"),
    )
