"""Operators 11 to 13 against plain statements of what they should say."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from .brute import LOWER, sha

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    return spark.createDataFrame(rows, schema)


# ---- packing -----------------------------------------------------------------------------------

ODD = [None, "", " ", "  a  b\n\n c   ", "it're they'll 'r", "x 　y \x1c z\x85", "<|endoftext|>a <|endoftext|>", "ñandú 日本語 🤦🏼‍♂️", "\x00\x01", "=-" * 300]


def packed(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"]))


def test_pieces_are_the_librarys_ids_and_sequences_are_whole(spark):
    from tokenizers import Tokenizer

    from quillspark.llm.packing import pack_documents, sequences

    rng = random.Random(5)
    texts = ODD + [" ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(1, 1500))) for _ in range(60)] + ["same text"] * 5 + ["a" * 50_000]
    docs = frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).withColumns({"LENGTH": F.lit("clash"), "offset": F.lit(7)})
    placed = pack_documents(docs, PATH).cache()
    library = Tokenizer.from_file(PATH)
    of = defaultdict(list)
    for r in placed.collect():
        of[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        got = sorted(of[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // 1024)))
        assert all(r["length"] == 1024 for r in got[1:]) and got[0]["length"] == (len(ids) - 1) % 1024 + 1
        assert [r["start"] for r in got] == np.cumsum([0, *(r["length"] for r in got)])[:-1].tolist()
        assert sum((r["ids"] for r in got), []) == ids
        assert all(r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) for r in got)
    for s in sequences(placed).collect():
        assert s["length"] == len(s["ids"]) <= 1024
        at = 0
        for part in s["parts"]:
            assert part["offset"] == at
            piece = next(r for r in of[part["key"]] if r["piece"] == part["piece"])
            assert piece["sequence_id"] == s["sequence_id"] and s["ids"][at : at + part["length"]] == piece["ids"]
            at += part["length"]
        assert at == s["length"]
    total = sum(r["length"] for rows in of.values() for r in rows)
    assert len({r["sequence_id"] for rows in of.values() for r in rows}) <= 1.02 * total / 1024 + 1


def test_bins_take_the_tightest_and_close_the_fullest():
    from quillspark.llm.packing import Bins

    rng = random.Random(9)
    bins, open_, number = Bins(50, 4), {}, 0
    for _ in range(3000):
        n = rng.randrange(1, 51)
        chosen, offset = bins.place(n)
        fit = [f for f in open_.values() if f >= n]
        if fit:
            assert open_[chosen] == min(fit) and offset == 50 - min(fit)
            open_[chosen] -= n
        else:
            if len(open_) == 4:
                least = min(open_.values())
                gone = [b for b, f in open_.items() if f == least]
                assert not bins.by_free[least] or len(gone) > 1 or least == 50 - n
                now = set().union(*bins.by_free)
                del open_[next(b for b in gone if b not in now)]
            assert (chosen, offset) == (number, 0)
            number += 1
            open_[chosen] = 50 - n
        if not open_[chosen]:
            del open_[chosen]
        assert bins.open == len(open_) <= 4
        assert sorted(f for f, b in enumerate(bins.by_free) for _ in b) == sorted(open_.values())


def test_packing_of_nothing_null_keys_and_repeats(spark):
    from quillspark.llm.packing import pack, pack_documents

    assert pack_documents(frame(spark, []), PATH).count() == 0
    rows = pack_documents(frame(spark, [(None, None, "x"), (None, None, "x"), (3, "a b", None)]), PATH, ids=False).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 3]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    with pytest.raises(Exception, match="1 to capacity"):
        pack(spark.createDataFrame([(1, 1025)], "doc_id long, length long")).collect()


# ---- collocations ------------------------------------------------------------------------------


def phrases(rows, depth=3, least=10, share=(50, 100), top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            for d in range(1, depth + 1):
                for i in range(len(w) - d + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + d])] += 1
    out = set()
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        found = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        rows = []
        for k, a in found.items():
            inside = [x for x in found if len(x) > len(k) and any(x[i : i + len(k)] == k for i in range(len(x) - len(k) + 1))]
            if any(share[1] * found[x] >= share[0] * a for x in inside):
                continue
            score, _, left, right = min((1000000 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))
            rows.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -s))
    return out


def mined(docs, **options):
    from quillspark.llm.collocations import collocations

    return {tuple(r) for r in collocations(docs, **options).collect()}


def prose(rng, n):
    words = [*"abcdefgh", "The", "über", "x\x1cy", "x y", "日本", "\x00"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "! "]
    return "".join(rng.choice(words) + rng.choice(gaps) for _ in range(n)) + "new york city. " * (n // 40)


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_phrases(spark, monkeypatch, depth):
    from quillspark.llm import collocations

    monkeypatch.setattr(collocations, "PARTS", 3)
    rng = random.Random(depth)
    rows = [(prose(rng, rng.randrange(0, 400)), rng.choice(["en", "de", None])) for _ in range(40)] + [(None, "en"), ("", "fr"), (" ., ", None)] + [("same words again here", "en")] * 12
    docs = frame(spark, [(i, t, g) for i, (t, g) in enumerate(rows)]).repartition(3).withColumns({"PHRASE": F.lit(1), "g": F.lit(2), "n": F.lit(3)})
    assert mined(docs, depth=depth) == phrases(rows, depth)
    assert mined(docs, depth=depth, top=7, least=20) == phrases(rows, depth, 20, top=7)


def test_shards_are_cut_within_long_texts():
    from quillspark.llm import collocations as C

    rng = random.Random(2)
    texts = [prose(rng, 3000), "", prose(rng, 5), "w " * 700]
    want = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", t.translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            want.update((tuple(w[i : i + 3])) for i in range(len(w) - 2))
    C_CHUNK = C._CHUNK
    try:
        C._CHUNK = 64
        whole = [sum((list(p) for p in C.words_of(t)), []) for t in texts]
        C._CHUNK = 1 << 20
        assert whole == [sum((list(p) for p in C.words_of(t)), []) for t in texts]
    finally:
        C._CHUNK = C_CHUNK
    full = np.full(1 << 12, ~np.uint64(0))
    known = C.Words()
    parts = [np.zeros(1, np.int32)]
    for t in texts:
        parts += [known.numbers("en", w) for w in C.words_of(t)] + [np.zeros(1, np.int32)]
    numbers, found = np.concatenate(parts), Counter()
    for at in range(0, len(numbers), 101):
        begin = max(0, at - 2)
        shard = np.concatenate([[0], numbers[begin : at + 101]])
        a = C.Automaton(shard, 3, 1 + at - begin, np.arange(len(known.words), dtype=np.uint64), full)
        for run, n in zip(zip(*(r.tolist() for r in a.runs())), a.count.tolist()):
            found[tuple(known.words[x].decode() for x in run)] += n
    assert found == want


def test_phrases_of_split_shards_and_of_nothing(spark, monkeypatch):
    assert mined(frame(spark, [])) == set()
    assert mined(frame(spark, [(1, None, None), (2, ".", "en")])) == set()
    huge = "alpha beta gamma " * 200_000  # several chunks of one text
    assert mined(frame(spark, [(1, huge, "en")])) == phrases([(huge, "en")])


# ---- repair of conversations -------------------------------------------------------------------


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """All repairs by plain search: (cost, audit, repaired) over states of the roles given."""
    seen, faults = set(), []
    for role, text in turns:
        body = re.sub(r"[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"": (0, "", [])}

    def grow(paths):
        for _ in range(3):
            for state, (c, a, said) in list(paths.items()):
                new = "a" if state == "u" else "u"
                step = (c + 2, a + "I", said + [("assistant" if new == "a" else "user") + ":"])
                if new not in paths or step[:2] < paths[new][:2]:
                    paths[new] = step
        return paths

    best = grow(best)
    for (role, text), fault in zip(turns, faults):
        nxt = {}

        def offer(state, step, nxt=nxt):
            if state not in nxt or step[:2] < nxt[state][:2]:
                nxt[state] = step

        for state, (c, a, said) in best.items():
            offer(state, (c + 3, a + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            late = int(fault == "truncated")
            want = "a" if state == "u" else "u"
            offer(want, (c + 2 + late, a + "R", said + [("assistant" if want == "a" else "user") + ":" + text]))
            if role[:1] == want or role[:1] == "s" and state == "":
                offer(role[:1], (c + late, a + "K", said + [role + ":" + text]))
        best = grow(nxt)
    cost, audit, said = min(best[s] for s in ("", "a") if s in best)
    return faults, cost, audit, said


def repaired(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in hurt(rows):
        groups[conv].append((turn, role, text))
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(groups[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], sha(t[2])))
        faults, cost, audit, said = cheapest([t[1:] for t in turns])
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(said)))
    return out


def fixed(spark, rows):
    from quillspark.llm.repair import repair_damaged

    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("clash"), "place": F.lit(1), "COPY": F.lit(2)})
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in repair_damaged(turns.repartition(3)).collect()}


def talk(rng, n):
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", ""]
    texts = ["Hello there.", "What?", "no end", "", " \t\n", "Fine!  ", None, "Hello there.", "日本。", "a.b", "ok.\x1c"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.randrange(50)}.") for _ in range(n)]


def test_repairs_cost_least(spark):
    rng = random.Random(8)
    rows = []
    for conv in [None, *range(120)]:
        first = rng.randrange(3)
        turns = talk(rng, rng.randrange(0, 9)) or [("user", "alone")]
        rows += [(conv, rng.choice([None, first + i, first + 2 * i, 1]), *t) for i, t in enumerate(turns)]
    rows += [(7, 1, "user", "Hello there.")] * 3 + [(500 + i, 3, "user", "x") for i in range(40)]
    assert fixed(spark, rows) == repaired(rows)


def test_long_conversations_are_folded_in_blocks(spark, monkeypatch):
    from quillspark.llm import repair

    monkeypatch.setattr(repair, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(1, i, *t) for i, t in enumerate(talk(rng, 300))] + [(2, i, *t) for i, t in enumerate(talk(rng, 17))] + [(3, 0, "user", "Hi.")]
    assert fixed(spark, rows) == repaired(rows)


def test_repair_of_nothing_and_repaired_turns(spark):
    from quillspark.llm import repair

    assert fixed(spark, []) == {}
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Yes."), (1, 2, "user", "a"), (None, 1, "user", "Hm."), (2, 0, "user", "")]
    canonical = spark.createDataFrame(rows, "key long, turn long, role string, text string").withColumn("copy", F.lit(0))
    flagged = repair.with_faults(canonical)
    turns = repair.repaired_turns(flagged, repair.audits(flagged)).collect()
    of = defaultdict(list)
    for r in sorted(turns, key=lambda r: r["place"]):
        of[r["key"]].append((r["role"], r["text"]))
    for conv in (1, None, 2):
        said = [f"{a}:{b}" for a, b in of[conv]]
        assert said == cheapest([(r[2], r[3]) for r in rows if r[0] == conv])[3]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[0] for a, _ in of[conv]))
    assert hashlib.sha256(b"").hexdigest() == sha("")
