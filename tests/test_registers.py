"""Names, transactions, models and fields with places, against plain statements of what they should say."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import patterns
from quillspark.operators import models, records, redact, similar
from quillspark.sources import transactions
from quillspark.sources.scratch import scratch

SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_similar_names_are_all_that_brute_force_finds(spark):
    rng = random.Random(7)
    base = ["acme research inc", "northern clinical group", "modernatx inc", "日本 pharma", "a", "ab", "x" * 230]
    names = [*base]
    for b in base * 12:
        letters = list(b)
        for _ in range(rng.randrange(5)):
            letters[rng.randrange(len(letters))] = rng.choice("abcxyz 日")
        names.append("".join(letters[: rng.randrange(1, len(letters) + 1)]))
    left, right = [*names[::2], None, ""], [*names[1::2], None, ""]
    a, b = spark.createDataFrame([(x,) for x in left], "v string"), spark.createDataFrame([(x,) for x in right], "w string")
    got = {(r["value"], r["known"]): r["ratio"] for r in similar.similar(a, "v", b, "w").collect()}
    want = {(x, y): ratio(x, y) for x in left if x for y in right if y and ratio(x, y) >= 0.72}
    assert got == want and len(want) > 30
    best = {r["v"]: r["k"] for r in similar.resolved(a, "v", b, "w", "k").collect()}
    assert best == {x: min(((-ratio(x, y), y) for y in right if x and y and ratio(x, y) >= 0.72), default=(0, None))[1] for x in left}
    assert similar.similar(a.where("false"), "v", b, "w").count() == 0


def test_similar_names_of_parts(spark):
    from quillspark.plans import registry

    parts = {f"{r[0]} {r[1]}" for r in spark.read.parquet(f"{SF}/part.parquet").select("p_name", "p_type").collect()}
    got = {(r["value"], r["known"]) for r in registry.queries()["str13_similar_names"](spark, SF).collect()}
    assert got == {(x, y) for x in parts for y in parts if x != y and ratio(x, y) >= 0.72}


def test_a_transaction_is_seen_whole_or_not_at_all(spark):
    root, private = scratch(spark, "t"), scratch(spark, "p")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "job_id long, x string")
    with pytest.raises(ValueError, match="nothing is published"):
        transactions.read(spark, root, "jobs")
    broken = rows.withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        transactions.publish(spark, root, "one", {"jobs": rows, "events": broken})
    with pytest.raises(ValueError, match="nothing is published"):
        transactions.read(spark, root, "jobs")
    assert transactions.publish(spark, root, "one", {"jobs": rows, "secret": rows}, private, ("secret",))
    assert not transactions.publish(spark, root, "one", {"jobs": rows})
    assert transactions.publish(spark, root, "two", {"jobs": spark.createDataFrame([(2, "c"), (3, "d")], rows.schema)}, replace={"jobs": "job_id"})
    assert sorted(map(tuple, transactions.read(spark, root, "jobs").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    with pytest.raises(ValueError, match="nothing is published"):
        transactions.read(spark, root, "secret")
    assert spark.read.parquet(f"{private}/one/secret").count() == 2
    with pytest.raises(ValueError, match="private folder"):
        transactions.publish(spark, root, "three", {"secret": rows}, hidden=("secret",))
    docs = {r["job_id"]: r["document"] for r in transactions.documents(rows, "job_id").collect()}
    assert docs == {1: '{"job_id":1,"x":"a"}', 2: '{"job_id":2,"x":"b"}'}


def test_a_kept_model_says_what_it_said(spark):
    rng = random.Random(1)
    rows = [(i, i % 40, [rng.gauss(3 * (i % 3 == k), 1) for k in range(3)], i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, g long, v array<double>, y int")
    learn, rest = models.split(df, F.col("g"))
    assert learn.count() + rest.count() == 240 and rest.count() > 20
    assert not {r["g"] for r in learn.collect()} & {r["g"] for r in rest.collect()}
    model, path = models.fit(learn, "v", "y", maxIter=5), scratch(spark, "model")
    models.save(model, path)
    a, b = (sorted(map(tuple, models.classify(m, rest, "v").select("id", "y", "prediction", "confidence", "margin").collect())) for m in (model, models.load(path)))
    assert a == b and sum(y == p for _, y, p, _, _ in a) > 0.85 * len(a)
    assert all(1 / 3 <= c <= 1 and m >= 0 for *_, c, m in a)


def test_records_of_any_shape(spark):
    bodies = ['{"b":1,"a":[{"z":null,"c":"x"},2.5]}', "[]", "nope", None, '"s"', '{"é":{"2":1,"10":2}}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    got = [r[0] for r in df.orderBy("id").select(records.canonical(F.col("body"))).collect()]
    assert got == ['{"a":[{"c":"x","z":null},2.5],"b":1}', "[]", None, None, '"s"', '{"é":{"10":2,"2":1}}']
    paths = {(r["path"], r["kind"]): r["n"] for r in records.field_paths(df, "body").groupBy("path", "kind").agg(F.sum("n").alias("n")).collect()}
    assert paths == {("$", "object"): 2, ("$", "array"): 1, ("$", "string"): 1, ("$.b", "number"): 1, ("$.a", "array"): 1, ("$.a[]", "object"): 1, ("$.a[]", "number"): 1, ("$.a[].z", "null"): 1, ("$.a[].c", "string"): 1, ("$.é", "object"): 1, ("$.é.2", "number"): 1, ("$.é.10", "number"): 1}
    with pytest.raises(ValueError, match="deeper"):
        records.field_paths(df, "body", most=1)


def brute_fields(name, body):
    """Detections of one field by plain search: (type, text, places), in order."""
    import regex

    kinds = [k for k, words in patterns.FIELD_TYPES if any(w in name.lower() for w in words)]
    places = lambda p: [(m.start(), m.end()) for m in regex.finditer(p, body)]
    rule = patterns.PERSON_RULE.replace(r"\p{Punct}", r"[!-/:-@\[-`{-~]")
    person, date, postal, protocol = (p.replace("(?U)", "").replace("(?iU)", "(?i)") for p in (patterns.PERSON, patterns.DATE, patterns.POSTAL, patterns.PROTOCOL))
    out = []
    for kind in ["PERSON", "ADDRESS", "SENSITIVE_FACILITY", "CCI_STUDY_TITLE", "CCI_SPONSOR", "DATE"]:
        if kind not in kinds:
            continue
        if not body.strip():
            out.append((kind, "", []))
        elif kind == "PERSON":
            if found := places(rule) or places(person):
                out.append((kind, body, found))
        elif kind == "DATE" or kind == "ADDRESS" and "zip" in name:
            found = places(date if kind == "DATE" else postal)[:1]
            if found or kind == "ADDRESS":
                out.append((kind, body[slice(*found[0])] if found else body, found))
        else:
            out.append((kind, body, []))
    return out + ([("CCI_PROTOCOL_ID", body[a:b], [(a, b)]) for a, b in places(protocol)] if body.strip() else [])


def test_fields_know_where_what_they_hold_stands(spark):
    rng = random.Random(3)
    bits = ["Ada Lovelace", "MD", "O'Neil Mc-Kay", "JOHN SMITH", "02/03/2024", "12345-6789", "12345", "mRNA-1234-P567", "of", "the", "Émile Zola", "\n", ",", "  "]
    names = ["invest_name", "site_zip", "sigdate", "prot_name_code", "lab_name", "notes", "address_1", "appfirm", "sub_inv_names_sigdate"]
    rows = [(i, rng.choice(names), " ".join(rng.choice(bits) for _ in range(rng.randrange(7))), 0.5) for i in range(150)]
    fields = spark.createDataFrame([*rows, (900, "site_zip", None, 0.5)], "id long, field_name string, ocr_text string, ocr_confidence double")
    found = redact.detect_fields(fields)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["seq"])):
        got.setdefault(r["id"], []).append((r["entity_type"], r["detected_text"], [(p["begin"], p["end"]) for p in r["places"]]))
    want = {i: f for i, n, b, _ in rows if (f := brute_fields(n, b))} | {900: [("ADDRESS", "", [])]}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}

    words = [(i, m.start(), m.end(), (float(m.start()), 1.0, float(m.end()), 2.0)) for i, _, b, _ in rows for m in __import__("re").finditer(r"\S+", b)]
    tokens = spark.createDataFrame(words, "id long, token_begin int, token_end int, token_box struct<x0:double,y0:double,x1:double,y1:double>")
    whole = F.struct(*[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (-1.0, -2.0, -3.0, -4.0))])
    for r in redact.with_boxes(found, tokens, ["id"], whole).collect():
        touched = [box for i, a, b, box in words if i == r["id"] and any(b > p["begin"] and a < p["end"] for p in r["places"])]
        best = (min(t[0] for t in touched), 1.0, max(t[2] for t in touched), 2.0) if touched else (-1.0, -2.0, -3.0, -4.0)
        assert tuple(r["box"]) == best
