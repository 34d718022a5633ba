"""The round's findings on core queries: work that is spread, and results that stay."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import joins as J


@pytest.mark.parametrize("block", [1 << 14, 8])
def test_bands_within_a_hot_cell(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, rng.choice("ab"), rng.choice([rng.randrange(5), rng.randrange(50) / 10])) for i in range(150)]
    rows = [(i, k, float(v)) for i, k, v in rows] + [(200, "a", -1e-17), (201, "a", None), (202, None, 1.0), (203, "b", float("nan")), (204, "a", float("inf"))]
    df = spark.createDataFrame(rows, "id long, k string, v double")
    near = lambda x, y: x is not None and y is not None and abs(x - y) <= 1.0
    want = sorted((a, b) for a, k, x in rows for b, m, y in rows if a < b and k == m and k is not None and near(x, y))
    assert (3, 200) in want or any(b == 200 for _, b in want)
    assert sorted(map(tuple, J.band_within(df, ["k"], "id", "v", 1.0).collect())) == want
    left, right = df.select("id", "v"), df.select(F.col("id").alias("other"), F.col("v").alias("w"))
    got = sorted((r["id"], r["other"]) for r in J.band(left, "v", right, "w", 1.0).collect())
    assert got == sorted((a, b) for a, _, x in rows for b, _, y in rows if near(x, y))  # 1.0 and -1e-17 were missed


def test_a_band_join_of_few_bytes_is_spread(spark):
    """A small table was broadcast and all pairs were made by the one task that read it."""
    df = spark.range(0, 400, numPartitions=1).select("id", (F.col("id") % 40).alias("k"), (F.col("id") % 3 / 2).alias("v"))
    pairs = J.band_within(df, ["k"], "id", "v", 1.0)
    assert pairs.count() == 40 * 45
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_substrings_are_found_without_all_runs_of_a_text(spark, monkeypatch):
    """Every run of every text was shuffled; now only runs that may be a needle's leave a text."""
    from quillspark.operators import substrings

    monkeypatch.setattr(substrings, "_SLICE", 100)
    rng = random.Random(4)
    letters = "abcé漢😀 "
    texts = [(i, "".join(rng.choices(letters, k=rng.choice([0, 1, 7, 40, 300])))) for i in range(120)] + [(500, None)]
    words = [t[a : a + n] for _, t in texts if t for a, n in [(rng.randrange(len(t)), rng.choice([1, 2, 3, 5, 9, 40, 90]))]]
    words += ["".join(rng.choices(letters, k=n)) for n in (3, 8, 33, 70) for _ in range(5)] + [None, "ab" * 40]
    df = spark.createDataFrame(texts, "id long, t string").repartition(3)
    dims = spark.createDataFrame([(rng.randrange(1000), w) for w in words] + [(None, "a")], "o long, w string")
    rows = [r for r in dims.collect() if r["o"] is not None and r["w"] is not None]
    for least in (1, 6):  # all needles, or long ones alone
        own = [r for r in rows if len(r["w"]) >= least]
        want = {i: min((r["o"] for r in own if t is not None and r["w"] in t), default=None) for i, t in texts}
        got = substrings.first_contained(df, "id", "t", dims.where(F.length("w") >= least), "w", "o", "first")
        assert {r["id"]: r["first"] for r in got.collect()} == want
    held = substrings._held(df.where("t is not null").select(F.col("id").alias("_key"), F.col("t").alias("_text")), {32: (13, __import__("numpy").zeros(1 << 10, "u1"))})
    assert held.count() == 0


@pytest.mark.parametrize("few", [4096, 3, 0])
def test_intervals_of_few_bounds_need_no_scan(spark, monkeypatch, few):
    from quillspark.operators import scans

    plain, made = scans.Scan.__init__, []
    monkeypatch.setattr(scans, "FEW", few)
    monkeypatch.setattr(scans.Scan, "__init__", lambda self, *a: made.append(a) or plain(self, *a))
    bounds = [(k, float(b)) for k, own in (("a", [0, 2, 5]), ("hot", range(0, 40, 3)), (None, [1, 4]), ("one", [3])) for b in own]
    points = [(i, k, v) for i, (k, v) in enumerate((k, v) for k in ("a", "hot", None, "one", "none") for v in (None, float("nan"), -1.0, 0.0, 1.0, 2.0, 2.5, 4.0, 5.0, 39.0, 40.0))]
    got = scans.interval_of(spark.createDataFrame(points, "id long, k string, x double"), ["k"], "x", spark.createDataFrame(bounds, "k string, b double"), "b", "cell").collect()
    want = {}
    for i, k, v in points:
        own = sorted(b for m, b in bounds if m == k)
        want[i] = next((j for j, (a, b) in enumerate(zip(own, own[1:])) if v is not None and a <= v <= b), None)
    assert {r["id"]: r["cell"] for r in got} == want
    assert len(made) == (few < 4096)  # all pages were sorted by range, written and read again


def test_training_rows_are_not_dealt_to_shuffle_partitions(spark):
    """Every pass of every class had a task for each shuffle partition, however few rows there were."""
    from quillspark.operators import models

    rows = spark.createDataFrame([([float(i), 1.0], i % 3) for i in range(30)], "v array<double>, y int").repartition(2)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("37", "false", "-1")):
            spark.conf.set(k, v)
        data = models._training(rows, "v", "y")
        assert data.count() == 30 and data.where("abs(_w - 1) > 1e-12").count() == 0
        assert data.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
