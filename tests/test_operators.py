import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import classify, extract, jobs, joins, redact, studies, summaries
from quillspark.sources import codecs, files, rest

COVER = """Sponsor Name: ModernaTX Incorporated   Legal Registered Address: 14 Harbour Row, cambridge ,MA 02142
Medical Monitor: on file
NCT # : nctO1234O67   Protocol Number: XY-77-b
Amendment Number: 2   Date of Amendment 2: 3 Feb 2019   Date of Amendment 1: 30 Dec 2018
Protocol Title: Effects of a phase 1/ 2 programme
 on sleep Protocol Number: XY-77-b"""


def test_cover_fields(spark):
    row = extract.cover_fields(spark.createDataFrame([(COVER,), ("nothing",), (None,)], "t string"), "t").collect()
    full = row[0]
    assert full.nct_id == "NCT01234067" and full.phase == "Phase 1/2" and full.amendment_date == "3 Feb 2019"
    assert full.sponsor_name == "ModernaTX, Inc." and full.sponsor_address == "14 Harbour Row, Cambridge, MA 02142"
    assert full.warnings == []
    assert row[1].warnings[0] == "missing:nct_id" and len(row[1].warnings) == 8


@pytest.mark.parametrize("name, raw, expected", [("zip", "02115", "02115"), ("site_state", "MA :", "MA"), ("x", "mMRNA-1273 study", "mRNA-1273 study"), ("sig_date", "1-2 2026", "01/02/2026"), ("zip", "12", "12")])
def test_validation(spark, name, raw, expected):
    assert spark.range(1).select(extract.validated(F.lit(name), F.lit(raw)).alias("v")).first().v == expected


def test_sponsor_resolution(spark):
    df = spark.createDataFrame([("topmost.appFirm[0]", "ModernaTlX, Inc.", "ModernaTX, Inc.")], "n string, v string, s string")
    df = df.withColumn("r", extract.similarity("v", "s"))
    assert df.select(extract.validated(F.col("n"), F.col("v"), F.col("s"), F.col("r")).alias("o")).first().o == "ModernaTX, Inc."


def test_field_types_and_policy(spark):
    names = [("db_invest_name", ["PERSON"]), ("db_inv_zip", ["ADDRESS"]), ("topmost.appFirm[0]", ["CCI_SPONSOR"]), ("title", [])]
    rows = spark.createDataFrame(names, "n string, e array<string>").select(redact.field_types(F.col("n")).alias("t"), "e").collect()
    assert all(r.t == r.e for r in rows)
    seen = spark.createDataFrame([("PERSON", 0.9), ("DATE", 0.9), ("CCI_PROTOCOL_ID", 0.9), ("PERSON", 0.5), ("NEW", 0.9)], "entity_type string, confidence double")
    found = {(r.entity_type, r.confidence): (r.action, r.needs_review) for r in redact.resolve(seen).collect()}
    assert found == {("PERSON", 0.9): ("redact", False), ("DATE", 0.9): ("review", False), ("CCI_PROTOCOL_ID", 0.9): ("redact", False), ("PERSON", 0.5): ("review", True), ("NEW", 0.9): ("review", False)}


def test_field_detection_fails_safe(spark):
    rows = spark.createDataFrame([("db_invest_name", "", 0.0), ("sigdate", "no date", 0.9), ("db_inv_zip", "MA 02115", 1.0), ("notes", "see mRNA-1273-P203", 0.5)], "field_name string, ocr_text string, ocr_confidence double")
    found = {(r.field_name, r.entity_type): (r.detected_text, r.confidence) for r in redact.detect_fields(rows).collect()}
    assert found[("db_invest_name", "PERSON")] == ("", 0.40)
    assert ("sigdate", "DATE") not in found
    assert found[("db_inv_zip", "ADDRESS")] == ("02115", 0.99)
    assert found[("notes", "CCI_PROTOCOL_ID")][0] == "mRNA-1273-P203"


def test_verification_and_override(spark):
    rows = spark.createDataFrame([("redact", "Ann B", "x Ann B", "x"), ("redact", "Ann B", "x Ann B", "ann b"), ("review", "q", "q", "q"), ("review", "q", "q", "")], "action string, target string, before string, after string")
    assert [r.passed for r in redact.verify(rows).collect()] == [True, False, True, False]
    items = spark.createDataFrame([(1, "redact"), (2, "review")], "id int, action string")
    decisions = spark.createDataFrame([(1, "keep", 1), (1, "review", 2)], "id int, action string, seq int")
    assert {r.id: r.action for r in redact.override(items, decisions, "id").collect()} == {1: "review", 2: "review"}


def test_rules_and_gate(spark):
    rows = spark.createDataFrame([("Form FDA 1572 Statement of Investigator", 0.0), ("form fda 3455", 0.9), ("Schedule of Events", 0.5), ("Clinical Study Protocol", 0.1), ("", 0.0)], "t string, s double")
    found = [(r.r.label, round(r.r.confidence, 4)) for r in rows.select(classify.by_rules(F.col("t"), F.col("s")).alias("r")).collect()]
    assert found == [("FDA_1572", 0.99), ("FDA_3455", 0.93), ("CLINICAL_TABLE", 0.795), ("CLINICAL_PROTOCOL", 0.92), ("UNKNOWN", 0.25)]


def test_macro_f1_of_a_published_confusion(spark):
    labels = ["a", "b", "c", "d", "e"]
    rows = [(x, x) for x in labels[:4] for _ in range(4)] + [("e", "__REVIEW__")] * 4
    s = summaries.macro_f1(spark.createDataFrame(rows, "e string, p string"), "e", "p", labels).first()
    assert s.accuracy == 0.8 and s.macro_f1 == 0.8


def test_jobs(spark):
    log = spark.createDataFrame([(1, 1, "queued", "queued", 0, 0), (1, 2, "preprocessing", "rendering", 10, 1), (1, 3, "completed", "completed", 100, 5), (2, 1, "queued", "queued", 0, 0)], "job_id int, sequence int, status string, stage string, progress int, s int")
    state = jobs.job_state(log.withColumn("created_at", F.timestamp_seconds("s")))
    rows = {r.job_id: r for r in state.collect()}
    assert rows[1].status == "completed" and rows[1].processing_seconds == 4.0 and rows[2].completed_at is None
    assert jobs.operations(state).first().job_count == 2
    empty = jobs.operations(state.where("job_id < 0")).first()
    assert (empty.job_count, empty.success_rate, empty.p95_seconds) == (0, 0.0, 0.0)


def test_range_join_takes_the_first_and_keeps_all(spark):
    points = spark.createDataFrame([(1.0,), (10.0,), (99.0,), (None,)], "p double")
    ranges = spark.createDataFrame([(1, 5.0, 20.0), (0, 0.0, 10.0)], "k int, lo double, hi double")
    found = {r.p: r.k for r in joins.within_range(points, "p", ranges, "lo", "hi", "k", 7.0).collect()}
    assert found == {1.0: 0, 10.0: 0, 99.0: None, None: None}


def test_studies(spark):
    study = {
        "protocolSection": {"identificationModule": {"nctId": "N1"}, "conditionsModule": {"conditions": ["a", "b"]}},
        "resultsSection": {
            "baselineCharacteristicsModule": {"groups": [{"id": "G1", "title": "Arm"}], "measures": [{"title": "Age", "classes": [{"categories": [{"measurements": [{"groupId": "G1", "value": "3"}, {"groupId": "G9", "value": "4"}]}]}]}]},
            "adverseEventsModule": {"seriousEvents": [{"term": "t", "stats": [{"groupId": "X", "numAffected": 2}]}], "otherEvents": []},
        },
    }
    df = spark.createDataFrame([(json.dumps(study),), ("{}",)], "j string").select(F.from_json("j", studies.STUDY).alias("study"))
    assert [r.conditions for r in studies.summary(df).collect()] == ["a; b", ""]
    assert [(r.group, r.value) for r in studies.baseline(df).collect()] == [("Arm", "3"), ("G9", "4")]
    assert [(r.severity, r.group, r.affected) for r in studies.adverse_events(df).collect()] == [("serious", "X", 2)]


def test_codecs(spark):
    with pytest.raises(codecs.CodecUnavailable):
        codecs.engine("ocr_words")
    words = spark.createDataFrame([(1, 1, 1, 1, 2, 50, 5, 1, 1, "90", "world"), (1, 1, 1, 1, 1, 10, 6, 1, 1, "80", "hello"), (1, 1, 1, 2, 1, 10, 20, 1, 1, "-1", "x"), (1, 1, 1, 2, 1, 10, 20, 1, 1, "70", " ")], codecs.SCHEMAS["ocr_words"])
    clean = codecs.clean_words(words)
    assert codecs.page_text(clean, ["page"]).first().text == "hello world"
    assert [(r.start, r.end) for r in codecs.token_offsets(clean, ["page"]).orderBy("start").collect()] == [(0, 5), (6, 11)]
    results = spark.createDataFrame([('{"res": {"rec_text": "a", "rec_score": 0.97}}',), ('{"rec_texts": ["north", "south east"], "rec_scores": [0.25, 0.75]}',)], "j string")
    parsed = [r.r for r in results.select(codecs.recognition(F.col("j")).alias("r")).collect()]
    assert [(p.text, round(p.confidence, 6)) for p in parsed] == [("a", 97.0), ("north\nsouth east", 50.0)]
    with pytest.raises(Exception, match="no text"):
        spark.createDataFrame([("{}",)], "j string").select(codecs.recognition(F.col("j"))).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n02115,"x ""y""\nz"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "*.csv"), "id string, v string").collect()] == [("02115", 'x "y"\nz')]
    (tmp_path / "ids.txt").write_text("# no\n\n NCT1 \n")
    assert [r.value for r in files.read_lines(spark, str(tmp_path / "ids.txt")).collect()] == ["NCT1"]
    html = files.html_table(F.array(F.array(F.lit("<a>"), F.lit(None).cast("string"))))
    assert spark.range(1).select(html.alias("h")).first().h == "<table><tr><td>&lt;a&gt;</td><td></td></tr></table>"
    line = files.exposition(F.lit("jobs"), F.create_map(F.lit("status"), F.lit('a"b')), F.lit(2))
    assert spark.range(1).select(line.alias("h")).first().h == 'jobs{status="a\\"b"} 2'


def test_fetch_tries_again():
    import io
    import urllib.error

    calls = []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise urllib.error.URLError("down")
        return io.BytesIO(b"ok")

    assert rest.fetch("http://x", wait=0, open_=flaky) == b"ok" and len(calls) == 3
    with pytest.raises(urllib.error.URLError):
        calls.clear()
        rest.fetch("http://x", tries=2, wait=0, open_=flaky)


def test_pages_source(spark, tmp_path):
    (tmp_path / "N1").write_text('{"id": "N1"}')
    (tmp_path / "N2").write_text('{"id": "N2"}')
    spark.dataSource.register(rest.StudiesSource)
    rows = spark.read.format("studies").option("url", tmp_path.as_uri()).option("ids", "N1,N2").load().collect()
    assert sorted(r.id for r in rows) == ["N1", "N2"]


def test_store(spark):
    from quillspark.operators import store

    uploads = spark.createDataFrame([("j1", "d1", None, 1), ("j2", "d2", "b", 2)], "job_id string, document_id string, batch_id string, created_at int")
    made, events = store.submitted(uploads)
    assert made.count() == 2 and [r.sequence for r in events.collect()] == [1, 1]
    fresh = spark.createDataFrame([("j1", 10, 5), ("j1", 5, 6), ("j3", 0, 7)], "job_id string, progress int, created_at int")
    more = store.appended(events, fresh, ["created_at"])
    assert sorted((r.job_id, r.sequence) for r in more.collect()) == [("j1", 2), ("j1", 3), ("j3", 1)]
    assert [r.progress for r in store.monotonic_violations(more).collect()] == [5]
    assert store.invalid(more.withColumn("progress", F.lit(101))).count() == 3
    old = spark.createDataFrame([("j1", "a"), ("j1", "b"), ("j2", "c")], "job_id string, name string")
    new = spark.createDataFrame([("j1", "z", 5)], "job_id string, name string, size int")
    assert sorted(r.name for r in store.replaced(old, new).collect()) == ["c", "z"]
    failed = spark.range(1).select(store.failure(F.lit("OSError"), F.lit("x" * 9000)).alias("f")).first().f
    assert (failed.status, len(failed.error_message)) == ("failed", 4000)
    assert store.attempt(made).first().attempt_count == 1


def test_read_studies(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"studies": [{"protocolSection": {"identificationModule": {"nctId": "N1"}}}, {}]}, indent=1))
    assert [r.nct_id for r in studies.summary(files.read_studies(spark, str(tmp_path))).collect()] == ["N1", None]


def test_stream_progress(spark, tmp_path):
    from quillspark.streaming import windows
    from quillspark.streaming.progress import ProgressRows

    spark.range(10).selectExpr("id", "timestamp_seconds(id) as ts").write.parquet(str(tmp_path / "in"))
    seen = []
    listener = ProgressRows(lambda *row: seen.append(row))
    spark.streams.addListener(listener)
    try:
        rows = windows.stream(spark, str(tmp_path / "in"), "id long, ts timestamp", "ts", "1 hour")
        run = windows.write_idempotent(rows, str(tmp_path / "out"), str(tmp_path / "check"), ["id"]).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_stages_stand_for_statuses(spark):
    stages = ["uploaded", "preprocessing", "classifying", "extracting", "redacting", "persisting", "completed", "needs_review", "rendering", ""]
    rows = spark.createDataFrame([(s,) for s in stages], "s string").select(jobs.status_of(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows] == ["queued", *stages[1:8], "extracting", "extracting"]


def test_times_run_from_the_first_active_status_and_rates_over_ended_jobs(spark):
    log = [(1, 1, "queued", "uploaded", 0), (1, 2, "failed", "x", 50), (2, 1, "queued", "attempt", 10), (2, 2, "extracting", "x", 20), (2, 3, "completed", "x", 40), (3, 1, "extracting", "x", 5)]
    events = spark.createDataFrame([(j, q, s, g, 10, t) for j, q, s, g, t in log], "job_id int, sequence int, status string, stage string, progress int, s long")
    state = jobs.job_state(events.withColumn("created_at", F.timestamp_seconds("s"))).cache()
    assert {r.job_id: r.processing_seconds for r in state.collect()} == {1: None, 2: 30.0, 3: None}
    total = jobs.operations(state).first()
    assert (total.job_count, total.terminal_job_count, total.success_rate, total.failure_rate, total.mean_seconds, total.max_seconds) == (3, 2, 0.5, 0.5, 30.0, 30.0)


def test_redaction_metrics(spark):
    from quillspark.operators import summaries

    rows = [
        ("a", True, True, "redact", "redact", 0.5, 1.0),
        ("a", True, True, "redact", "review", 1.0, 1.0),
        ("a", True, False, "review", None, 0.0, 4.0),
        ("a", False, True, None, "redact", 0.0, 2.0),
        (None, False, True, None, "review", 0.0, 1.0),
    ]
    frame = spark.createDataFrame(rows, "k string, expected boolean, predicted boolean, expected_action string, predicted_action string, containment double, latency double")
    found = {r.k: r for r in summaries.detection_scores(frame, ["k"]).collect()}
    a, none = found["a"], found[None]
    assert (a.rows, a.tp, a.fp, a.fn) == (4, 2, 1, 1)
    assert (a.redaction_coverage, a.missed_redaction_rate, a.false_redaction_rate) == (0.5, 0.5, 0.5)
    assert a.action_accuracy == pytest.approx(1 / 3) and (a.mean_containment, a.mean_latency) == (0.75, 2.0)
    assert (none.precision, none.redaction_coverage, none.false_redaction_rate, none.action_accuracy, none.mean_containment) == (0.0, 1.0, 0.0, 1.0, 0.0)


def test_normal_form_is_case_folded(spark):
    import re

    from quillspark.functions import text

    odd = ["oﬃce ẞ ſ", "ﬁne ﬅ", "İstanbul K", "ŉ ǰ ẖẗẘẙẚ", "Straße", "É x", "", "ÀB-1", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(text.normalize(F.col("t")).alias("n")).collect()
    assert [r.n for r in rows] == [None if t is None else re.sub(r"[^a-z0-9]+", " ", t.casefold()).strip() for t in odd]


def test_an_empty_target_is_nowhere_and_known_records_do_not_multiply(spark):
    from quillspark.operators import extract

    rows = spark.createDataFrame([("redact", "", "a", "b")], "action string, target string, before string, after string")
    found = redact.verify(rows).first()
    assert (found.present_before, found.present_after, found.passed) == (False, False, False)
    read = spark.createDataFrame([("p-1", "x")], "protocol_number string, phase string").withColumns({c: F.lit(None).cast("string") for c in ("sponsor_name", "sponsor_address")})
    known = spark.createDataFrame([("P 1", "two"), ("P-1", "three"), ("", "none")], "protocol_number string, phase string")
    assert [r.phase for r in extract.resolve_known(read, known).collect()] == ["two"]


def test_results_within_results(spark):
    nested = '{"res": {"res": {"res": {"rec_texts": ["up", " ", "down"], "rec_scores": [0.5, 0.7, 0.9]}}}}'
    found = spark.createDataFrame([(nested,)], "j string").select(codecs.recognition(F.col("j")).alias("r")).first().r
    assert found.text == "up\ndown" and found.confidence == pytest.approx(70)


def test_recogniser_results_of_any_depth(spark):
    from quillspark.sources import codecs

    def under(levels, inner):
        return '{"res": ' * levels + inner + "}" * levels

    plural = '{"rec_texts": ["a", " ", "b"], "rec_scores": [0.5, 1.0], "more": {"x": {"res": 1}}}'
    rows = [(under(n, plural),) for n in (0, 1, 8, 9, 40)] + [('{"res": "plain", "rec_text": " {c} ", "rec_score": 70}',), ('{"rec_text": null, "rec_texts": [], "rec_scores": []}',), ('{"rec_text": ["d", "e"], "rec_score": [0.2]}',)]
    found = [(r.r.text, r.r.confidence) for r in spark.createDataFrame(rows, "j string").coalesce(1).select(codecs.recognition(F.col("j")).alias("r")).collect()]
    assert found == [("a\nb", 75.0)] * 5 + [("{c}", 70.0), ("", 0.0), ("d\ne", 20.0)]
    for wrong in ("[1]", "no json", None, '{"res": {"x": 1}}'):
        with pytest.raises(Exception, match="no text"):
            spark.createDataFrame([(wrong,)], "j string").select(codecs.recognition(F.col("j"))).collect()
