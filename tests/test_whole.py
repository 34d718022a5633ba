"""Queries return the whole job, by brute force over the tables."""

import random
import re
from collections import defaultdict

import pytest

SF = "/root/testdata/sf0.001"


def run(spark, name):
    from quillspark.plans import registry

    return registry.queries()[name](spark, SF).toArrow().to_pylist()


def given(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toArrow().to_pylist()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row[-1]


def test_edit_distance_is_brute_force():
    from quillspark.functions.text import edit_distance

    draw = random.Random(3)
    for n in (0, 1, 2, 5, 13, 63, 64, 65, 130):
        for m in (0, 1, 4, 12, 64, 129):
            a, b = (["abcd"[draw.randrange(4)] for _ in range(k)] for k in (n, m))
            assert edit_distance(a, b) == distance(a, b)


def test_wer_of_whole_turns(spark):
    words = {(r["conv_id"], r["turn"]): re.findall("[a-z0-9]+", r["text"].replace("ß", "ss").lower()) for r in given(spark, "conversations") if r["text"] is not None}
    pairs = [(k, r, words[k[0], k[1] + 1]) for k, r in words.items() if (k[0], k[1] + 1) in words]
    assert max(len(r) for _, r, _ in pairs) > 12
    found = {(r["conv_id"], r["turn"]): r["wer"] for r in run(spark, "str05_wer")}
    for k, r, h in pairs:
        assert found[k] == pytest.approx(distance(r, h) / max(1, len(r)), abs=1e-6)


def test_softmax_of_whole_vectors(spark):
    import math

    vectors = {r["vec_id"]: r["embedding"] for r in given(spark, "embeddings")}
    found = {r["vec_id"]: r["top"] for r in run(spark, "mth13_softmax")}
    assert max(map(len, vectors.values())) > 5 and set(found) == set(vectors)
    for k, v in vectors.items():
        assert found[k] == pytest.approx(math.exp(max(v)) / sum(map(math.exp, v)), abs=1e-5)


def test_json_round_trip_of_the_whole_table(spark):
    key = lambda r: r["o_orderkey"]
    before, after = given(spark, "orders"), run(spark, "src02_json_round_trip")
    assert sorted(after, key=key) == sorted(before, key=key)


def test_cells_of_all_boundaries(spark):
    sizes = defaultdict(set)
    for r in given(spark, "part"):
        sizes[r["p_brand"]].add(r["p_size"])
    pairs = {b: list(zip(sorted(s), sorted(s)[1:])) for b, s in sizes.items()}
    expected = sorted((b, *x, *y) for b, e in pairs.items() for y in e for x in e)
    assert sorted((r["p_brand"], r["x0"], r["x1"], r["y0"], r["y1"]) for r in run(spark, "w09_adjacent_cells")) == expected


def test_every_candidate_has_a_rank(spark):
    rows = sorted(given(spark, "lineitem"), key=lambda r: (r["l_orderkey"], -r["l_extendedprice"], r["l_linenumber"]))
    expected, seen = [], defaultdict(int)
    for r in rows:
        seen[r["l_orderkey"]] += 1
        expected.append((r["l_orderkey"], r["l_linenumber"], seen[r["l_orderkey"]]))
    assert max(seen.values()) > 2
    assert sorted((r["l_orderkey"], r["l_linenumber"], r["r"]) for r in run(spark, "srt04_candidates")) == sorted(expected)


def test_whole_lists_are_padded(spark):
    lists = defaultdict(list)
    for r in sorted(given(spark, "events"), key=lambda r: r["event_id"]):
        lists[r["user_id"]].append(r["event_type"])
    width = max(map(len, lists.values()))
    assert width > min(map(len, lists.values())) > 3
    assert {r["user_id"]: r["padded"] for r in run(spark, "arr02_padding")} == {u: v + [""] * (width - len(v)) for u, v in lists.items()}


def test_sorts_return_all_rows_in_order(spark):
    parts = sorted((r["p_brand"], r["p_retailprice"], r["p_partkey"]) for r in given(spark, "part"))
    assert len(parts) > 100
    assert [(r["p_brand"], r["p_retailprice"], r["p_partkey"], r["place"]) for r in run(spark, "srt01_multi_key")] == [(*k, i) for i, k in enumerate(parts, 1)]
    suppliers = sorted(((r["s_acctbal"] is None, -(r["s_acctbal"] or 0), r["s_suppkey"]) for r in given(spark, "supplier")))
    assert [r["s_suppkey"] for r in run(spark, "srt02_metric_desc")] == [k for *_, k in suppliers]
    pages = sorted((r["url"], r["page_id"]) for r in given(spark, "pages"))
    assert len(pages) > 20 and [(r["url"], r["page_id"]) for r in run(spark, "srt10_path_order")] == pages
