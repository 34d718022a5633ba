"""Secret scans by a trigram inverted index; DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain (alternatives give OR, sequences AND). The index is a table of postings, clustered by trigram:
(trigram, row), a row being named by a 64-bit hash of its text. A query is answered by meeting the
postings of each row: the lists that it is on are united or intersected as the query has it. The rows
found are candidates, and a rule's expression runs only over its candidates, so that two texts of one
hash at worst cost a scan. Rules without mandatory trigrams scan every text. Candidates are brought
to their texts as a bitmap of fixed size, in which each word has the rules of its rows; a text that is
no candidate but falls on one's place costs a scan. No text is ever shuffled.

Offsets come from the pieces between matches: ``split`` gives the texts before and after each match
and ``regexp_extract_all`` the matches themselves, so that running sums of their lengths are the
positions in code points.

Defined results: null and empty texts have no spans; equal rows give equal results; an empty table
gives no rows; an input column that bears the name of a result is replaced, others of any name stay.
Texts with very many spans cost in proportion to their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowkit import discard, spare, written
from .placing import place, places
from .regex_trigrams import All, trigram_query


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; matches where ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The rules of the base contract, in its order.
BASE_RULES = [
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
]
#: Published shapes of further credentials.
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
]
_CHUNK = 256
_WORD = 63  # lists in a bitmap


class TrigramIndex:
    """The trigrams that a set of rules asks for, and the queries over their postings."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.trigrams = sorted({t for q in self.queries.values() if q is not None for t in q.trigrams()})
        if len(self.trigrams) > 64 * 64:
            raise ValueError("too many trigrams for one index; scan the rules in several groups")

    def postings(self, text: Column) -> Column:
        """The numbers of the lists that a text is on."""
        low = F.lower(text)
        return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i).cast("short")) for i, t in enumerate(self.trigrams)]))

    def build(self, texts: DataFrame, row: str, text: str) -> DataFrame:
        """The index of a table: (trigram, row), written to the shared folder. It may be kept and asked again."""
        lists = texts.select(F.col(f"`{row}`").alias("row"), F.explode(self.postings(F.col(f"`{text}`"))).alias("trigram"))
        return written(lists.sortWithinPartitions("trigram", "row"), "postings")

    def candidates(self, lists: DataFrame) -> DataFrame:
        """(row, rules): the rows that rules with a query may match, and the rules as a bitmap of their numbers."""
        words = [F.expr(f"bit_or(if(trigram div {_WORD} = {k}, shiftleft(1L, cast(trigram % {_WORD} as int)), 0L))").alias(f"w{k}") for k in range(-(-len(self.trigrams) // _WORD))]
        held = [F.col(f"w{k}") for k in range(len(words))]
        mask = F.lit(0).cast("long")
        for i, rule in enumerate(self.rules):
            if self.queries[rule.kind] is not None:
                mask = mask.bitwiseOR(F.when(self._answer(rule.kind, held), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        return lists.groupBy("row").agg(*words).select("row", mask.alias("rules")).where("rules <> 0")

    def _answer(self, kind: str, words: list[Column]) -> Column:
        """Whether a row is on the lists that the rule's query needs."""

        def walk(q) -> Column:
            if isinstance(q, str):
                i = self.trigrams.index(q)
                return words[i // _WORD].bitwiseAND(F.lit(1 << (i % _WORD)).cast("long")) != 0
            parts = [walk(x) for x in q.parts]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(q, All) else (out | p)
            return out

        return walk(self.queries[kind])


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<begin, kind, end>> of one rule's matches, those that fail ``least`` left out.

    Running sums are formed within chunks of matches and then over chunks, so a text with very many
    matches costs in proportion to their number.
    """
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    inner = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    both = F.zip_with(F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("gap"), F.length(m).alias("own"))), inner, lambda a, g: F.struct(a["gap"].alias("gap"), a["own"].alias("own"), F.length(g).alias("inner")))
    entry = "array<struct<begin:int,kind:int,end:int,inner:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(entry).alias("out"))

    def one(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + x["own"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("begin"), F.lit(number).alias("kind"), end.alias("end"), x["inner"].alias("inner")))).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / _CHUNK).cast("int")), lambda i: F.aggregate(F.slice(both, i * _CHUNK + 1, F.lit(_CHUNK)), empty, one))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("bases"))
    bases = F.aggregate(chunks, begin, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")))["bases"]
    moved = F.flatten(F.zip_with(chunks, bases, lambda c, base: F.transform(c["out"], lambda s: F.struct((s["begin"] + base).alias("begin"), s["kind"].alias("kind"), (s["end"] + base).alias("end"), s["inner"].alias("inner")))))
    good = F.filter(moved, lambda s: s["inner"] >= rule.least)
    return F.when(F.size(found) > 0, F.transform(good, lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _listed(spans: Column, kinds: list[str]) -> Column:
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.element_at(name, s["kind"] + 1), F.lit(":"), s["begin"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text: str = "text", more: list[Rule] | None = None, keep: list[str] | None = None, lists: DataFrame | None = None) -> DataFrame:
    """Add ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans`` (text) and ``secret_spans`` (array of struct begin, kind, end).

    ``more`` are rules beside the base ones; their spans are added, base spans always stay. ``lists``
    is an index of these texts that ``TrigramIndex.build`` made for the same rules, rows being named by
    ``xxhash64`` of the text (null: empty); without it one is built and deleted.
    """
    more = MORE_RULES if more is None else more
    rules = [*BASE_RULES, *more]
    kinds = [r.kind for r in rules]
    index = TrigramIndex(rules)
    results = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "secret_spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    body, row, rules_of, *spans = spare(docs, "body", "row", "rules", *[f"spans{i}" for i in range(len(rules))])
    texts = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body)).withColumn(row, F.xxhash64(body))
    asked = index.build(texts, row, body) if lists is None else lists
    hits = written(places(index.candidates(asked), "row", "rules"), "candidates")
    if lists is None:
        discard(asked)
    work = place(texts, row, hits, rules_of)
    none = F.array().cast("array<struct<begin:int,kind:int,end:int>>")
    found = {}
    for i, rule in enumerate(rules):
        if index.queries[rule.kind] is not None:
            likely = F.col(rules_of).bitwiseAND(F.lit(1 << i).cast("long")) != 0
        elif rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
            # a full scan asks first whether there is a match long enough: the pattern is one run of a class
            likely = F.col(body).rlike(rule.pattern[:-1] + "{" + str(rule.least) + "}")
        else:
            likely = F.lit(True)
        found[spans[i]] = F.coalesce(F.when(likely, _spans(F.col(body), rule, i)), none)
    work = work.withColumns(found)
    base = F.concat(*[F.col(s) for s in spans[: len(BASE_RULES)]])
    every = F.concat(*[F.col(s) for s in spans])
    counts = {f"n_{r.kind}": F.size(F.col(spans[i])).cast("long") for i, r in enumerate(BASE_RULES)}
    out = work.withColumns(counts | {"base_sha256": F.sha2(_listed(base, kinds), 256), "spans": _listed(every, kinds), "secret_spans": F.array_sort(every)})
    return out.select(*[F.col(f"`{c}`") for c in kept], *results)


def mask_secrets(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace the spans in ``secret_spans`` by ``[SECRET]``; overlapping spans are masked once. Null texts stay null.

    Spans are taken in chunks, each of which looks only at its own stretch of the text.
    """
    body, spans = F.col(f"`{text}`"), F.col("secret_spans")
    numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _CHUNK).cast("int"))
    chunks = F.transform(numbers, lambda i: F.slice(spans, i * _CHUNK + 1, F.lit(_CHUNK)))
    ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
    # where the stretch of each chunk begins and ends
    stretches = F.transform(numbers, lambda i: F.struct(F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0)).alias("a"), F.array_max(F.slice(ends, F.lit(1), i + 1)).alias("b")))

    def step(acc, s):
        fresh = F.when(s["begin"] >= acc["at"], F.concat(F.substring(acc["own"], acc["at"] - acc["a"] + 1, s["begin"] - acc["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(acc["own"].alias("own"), acc["a"].alias("a"), F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], F.array(fresh)).alias("out"))

    def masked(chunk, x):
        begin = F.struct(F.substring(body, x["a"] + 1, x["b"] - x["a"]).alias("own"), x["a"].alias("a"), x["a"].alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(chunk, begin, step, lambda acc: F.array_join(acc["out"], ""))

    last = F.array_max(ends)
    whole = F.concat(F.array_join(F.zip_with(chunks, stretches, masked), ""), F.substring(body, last + 1, F.length(body)))
    return found.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(body))
