"""Places of matches, token boxes, cells and the person rule, by brute force."""

import random
import re

from pyspark.sql import functions as F

from quillspark.functions import spans
from quillspark.functions.patterns import PERSON_RULE


def test_spans_are_those_of_plain_matching(spark):
    rng = random.Random(4)
    texts = [None, "", "12", "a1é22🤦333", "".join(rng.choice("ab1 é🤦") for _ in range(5000)), "7" * 900, "1 " * 1200]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.spans(F.col("t"), "[0-9]+").alias("s")).collect()
    for r in rows:
        assert [(s.begin, s.end, s.text) for s in r.s] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", r.t or "")]


def test_a_span_has_the_box_of_the_tokens_that_it_touches(spark):
    tokens = "array(named_struct('begin', 0, 'end', 3, 'box', named_struct('x0', 0.0, 'y0', 0.0, 'x1', 3.0, 'y1', 1.0)), named_struct('begin', 4, 'end', 6, 'box', named_struct('x0', 4.0, 'y0', -1.0, 'x1', 6.0, 'y1', 1.0)))"
    places = spark.createDataFrame([(0, 3), (2, 5), (3, 4), (6, 9)], "begin int, end int").select(F.struct("begin", "end").alias("s"), F.expr(tokens).alias("t"))
    found = places.select(spans.boxes_union(spans.under(F.col("s"), F.col("t"))).alias("b")).collect()
    assert [None if r.b is None else tuple(r.b) for r in found] == [(0, 0, 3, 1), (0, -1, 6, 1), None, None]


def test_words_go_to_the_first_cell_that_holds_their_centre(spark):
    words = [(1, "b", 8.0, 0.0, 4.0, 2.0), (1, "a", 2.0, 1.0, 2.0, 2.0), (1, "c", 2.0, 0.0, 2.0, 2.0), (1, "out", 90.0, 0.0, 2.0, 2.0), (1, "d", 12.0, 12.0, 2.0, 2.0)]
    frame = spark.createDataFrame(words, "k int, text string, left double, top double, width double, height double")
    assert [r.matrix for r in spans.words_to_matrix(frame, ["k"], [0, 10, 20], [0, 10, 20]).collect()] == [[["c b a", ""], ["", "d"]]]
    assert spans.words_to_matrix(frame.limit(0), ["k"], [0, 10], [0, 10]).count() == 0


def test_the_person_rule(spark):
    texts = {"see Ann Lee, MD now": ["Ann Lee, MD"], "Émile Çelik phd": ["Émile Çelik phd"], "ann Lee": [], "XAnn Lee": [], "Jo Do.": ["Jo Do."], "Ann  Lee Jo Wu": ["Ann  Lee", "Jo Wu"]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.spans(F.col("t"), PERSON_RULE).alias("s")).collect()
    assert {r.t: [s.text for s in r.s] for r in rows} == texts
