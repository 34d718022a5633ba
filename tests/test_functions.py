import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import geometry, numbers, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_normalize(spark):
    assert one(spark, text.normalize(F.lit("Form FDA-1572\nStatement"))) == "form fda 1572 statement"
    assert one(spark, text.normalize(F.lit("Straße"))) == "strasse"
    assert one(spark, text.normalize(F.lit(None).cast("string"))) is None


def test_error_rates(spark):
    assert one(spark, text.wer(F.lit("one two three"), F.lit("one four three"))) == pytest.approx(1 / 3)
    assert one(spark, text.wer(F.lit(""), F.lit("a b"))) == 2.0
    assert one(spark, text.wer(F.lit("a b"), F.lit(""))) == 1.0
    assert one(spark, text.cer(F.lit("abc"), F.lit("a-b d"))) == pytest.approx(1 / 3)
    s = one(spark, text.score_field(F.lit("x"), F.lit("yyy")))
    assert (s.exact, s.cer, s.accuracy) == (False, 3.0, 0.0)


@pytest.mark.parametrize("value, masked", [("", ""), ("a", "*"), ("ab", "**"), ("abcd", "a**d"), ("a" + "x" * 30 + "b", "a" + "*" * 12 + "b")])
def test_mask(spark, value, masked):
    assert one(spark, text.mask(F.lit(value))) == masked


def test_artifacts_and_routes(spark):
    assert one(spark, text.clean_artifacts(F.lit("mMRNA-1273 \n study |_"))) == "mRNA-1273 study"
    assert one(spark, text.route(F.lit("/v1/jobs/not-a-job"))) == "/v1/jobs/{id}"
    assert one(spark, text.route(F.lit("/v1/documents/jobs/5"))) == "/v1/documents/{id}/5"
    assert one(spark, text.route(F.lit("/"))) == "/"
    assert one(spark, text.document_id(F.lit("My form (1)"), F.sha2(F.lit("x"), 256))).startswith("Myform1-")


def box(a, b, c, d):
    return F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"), F.lit(float(c)).alias("x1"), F.lit(float(d)).alias("y1"))


def test_boxes(spark):
    assert one(spark, geometry.iou(box(0, 0, 2, 2), box(0, 0, 2, 2))) == 1.0
    assert one(spark, geometry.iou(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0.0
    assert one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert one(spark, geometry.containment(box(0, 0, 2, 2), box(1, 0, 9, 9))) == 0.5


def test_boundary_match(spark):
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, geometry.boundary_matches(array([1, 101, 201]), array([0, 100, 200]), 2.0)) == 3
    assert one(spark, geometry.boundary_matches(array([1, 2]), array([1.5]), 2.0)) == 1
    assert one(spark, geometry.boundary_matches(F.array().cast("array<double>"), array([1]), 2.0)) == 0
    assert one(spark, geometry.prf(F.lit(0), F.lit(0), F.lit(0))).f1 == 1.0


def test_box_match_takes_largest_first(spark):
    found = one(spark, geometry.box_matches(F.array(box(0, 0, 10, 10), box(0, 0, 10, 9)), F.array(box(0, 0, 10, 10)), 0.7))
    assert found == 1


def test_folds(spark):
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, geometry.representatives(array([1, 3, 5, 7]), 3.0)) == [1.0, 5.0]
    assert one(spark, geometry.padded_boundaries(array([20, 50]), F.lit(100))) == [0.0, 20.0, 50.0, 99.0]
    assert one(spark, geometry.padded_boundaries(F.array().cast("array<double>"), F.lit(100))) == []
    runs = one(spark, geometry.active_runs(F.array(*[F.lit(c == "x") for c in "..xxxx..xxx.......xxxx.x"])))
    assert [(r.begin, r.end) for r in runs] == [(2, 11), (18, 22)]


def test_numbers(spark):
    assert one(spark, numbers.detector_confidence("PERSON", F.lit(0.9))) == pytest.approx(0.97)
    assert one(spark, numbers.detector_confidence("REGEX", F.lit(0.1))) == pytest.approx(0.55)
    assert sum(one(spark, numbers.softmax(F.array(F.lit(1.0), F.lit(2.0))))) == pytest.approx(1.0)
    a, b = datetime.datetime(2026, 1, 1), datetime.datetime(2026, 1, 1, 0, 0, 3)
    assert one(spark, numbers.elapsed_seconds(F.lit(b), F.lit(a))) == 0.0
