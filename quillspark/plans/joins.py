"""Join semantics over documents, labels, orders, part and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import joins as J
from ..operators import matching, scans, substrings
from .registry import query, table


def _head(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j01_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _head(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("""SELECT l.l_orderkey, l.l_suppkey, count(*) AS n FROM lineitem l JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') r
    ON l.l_orderkey = r.l_orderkey AND l.l_suppkey = r.l_suppkey GROUP BY 1, 2""")
def j02_composite_key(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    returned = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct()
    return lines.join(returned, ["l_orderkey", "l_suppkey"], "left_semi").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CAST(quality AS VARCHAR), source) AS title FROM documents LEFT JOIN labels USING (doc_id)")
def j03_left_default(spark: SparkSession, sf: str) -> DataFrame:
    joined = _head(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("quality").cast("string"), "source").alias("title"))


@query("SELECT doc_id, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j04_left_constant(spark: SparkSession, sf: str) -> DataFrame:
    return _head(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("""WITH e AS (SELECT doc_id FROM labels WHERE quality = 1), p AS (SELECT doc_id FROM labels WHERE toxic = 1)
    SELECT coalesce(e.doc_id, p.doc_id) AS doc_id, CASE WHEN e.doc_id IS NULL THEN 'FP' WHEN p.doc_id IS NULL THEN 'FN' ELSE 'TP' END AS outcome FROM e FULL JOIN p ON e.doc_id = p.doc_id""")
def j05_full_outer_outcome(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    e = labels.where("quality = 1").select("doc_id", F.lit(True).alias("e"))
    p = labels.where("toxic = 1").select("doc_id", F.lit(True).alias("p"))
    outcome = F.when(F.col("e").isNull(), "FP").when(F.col("p").isNull(), "FN").otherwise("TP")
    return e.join(p, "doc_id", "full_outer").select("doc_id", outcome.alias("outcome"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def j06_anti(spark: SparkSession, sf: str) -> DataFrame:
    return _head(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def j07_semi(spark: SparkSession, sf: str) -> DataFrame:
    return _head(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id")


@query("SELECT n_name, c AS condition FROM nation, (VALUES ('clean'), ('blur'), ('noise')) t(c)")
def j08_cross(spark: SparkSession, sf: str) -> DataFrame:
    conditions = F.explode(F.array(*[F.lit(c) for c in ("clean", "blur", "noise")]))  # a fixed list: no join needed
    return table(spark, sf, "nation").select("n_name", conditions.alias("condition"))


_BANDS = [(0, 0.0, 10.0), (1, 10.0, 20.0), (2, 15.0, 35.0), (3, 30.0, 50.0)]


@query("""SELECT band, count(*) AS n FROM (SELECT (SELECT CAST(min(k) AS INTEGER) FROM (VALUES (0, 0.0, 10.0), (1, 10.0, 20.0), (2, 15.0, 35.0), (3, 30.0, 50.0)) b(k, lo, hi) WHERE l_quantity >= lo AND l_quantity <= hi) AS band
    FROM lineitem) GROUP BY 1""")
def j09_range_assign(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.createDataFrame(_BANDS, "band int, lo double, hi double")
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return J.within_range(points, "l_quantity", bands, "lo", "hi", "band", 10.0).groupBy("band").agg(F.count("*").alias("n"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 1""")
def j10_band_join(spark: SparkSession, sf: str) -> DataFrame:
    return J.band_within(table(spark, sf, "part"), ["p_brand"], "p_partkey", "p_retailprice", 1.0)


#: Pairs gone through in order by one recursion a group: each end is taken once.
_GREEDY = """m AS (SELECT g, 0::BIGINT AS k, []::BIGINT[] AS p, []::BIGINT[] AS r FROM (SELECT DISTINCT g FROM e)
      UNION ALL SELECT m.g, e.k, CASE WHEN list_contains(p, pi) OR list_contains(r, ri) THEN p ELSE list_append(p, pi) END, CASE WHEN list_contains(p, pi) OR list_contains(r, ri) THEN r ELSE list_append(r, ri) END
      FROM m JOIN e ON e.g = m.g AND e.k = m.k + 1),
    matches AS (SELECT g, max(len(p)) AS matched FROM m GROUP BY 1)"""


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT p_brand AS g, CAST(p_size AS BIGINT) AS pi FROM part), n AS (SELECT g, count(*) AS n FROM s GROUP BY 1),
    e AS (SELECT s.g, pi, ri, row_number() OVER (PARTITION BY s.g ORDER BY abs(pi - ri), pi, ri) AS k FROM s JOIN range(0, 51, 5) t(ri) ON abs(pi - ri) <= 2), {_GREEDY}
    SELECT n.g AS p_brand, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / n, 9) AS precision, round(coalesce(matched, 0) / 11, 9) AS recall, round(coalesce(2 * matched / (n + 11), 0), 9) AS f1 FROM n LEFT JOIN matches USING (g)""")
def j10_greedy_boundary_match(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of a brand against a grid, one to one, nearest first: a band join, then rounds of matching."""
    sizes = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("size")).distinct()
    grid = spark.range(0, 51, 5).select(F.col("id").cast("double").alias("line"))
    near = J.band(sizes, "size", grid, "line", 2.0).withColumn("brand", F.col("p_brand"))
    pairs = matching.greedy(near, ["p_brand", "size"], ["brand", "line"], [F.abs(F.col("size") - F.col("line"))])
    counts = sizes.groupBy("p_brand").agg(F.count("*").alias("n")).join(pairs.groupBy("p_brand").agg(F.count("*").alias("m")), "p_brand", "left")
    counts = counts.select("p_brand", F.coalesce("m", F.lit(0)).alias("matched"), "n")
    return counts.select("p_brand", "matched", geometry.prf(F.col("matched"), F.col("n"), F.lit(11)).alias("s")).select("p_brand", "matched", *[F.round(f"s.{c}", 9).alias(c) for c in ("precision", "recall", "f1")])


_BOXES = "SELECT l_orderkey, l_linenumber AS k, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 20 AS x1, l_discount * 100 + 10 AS y1 FROM lineitem"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x0, y0 = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + 20).alias("x1"), (y0 + 10).alias("y1")).alias("box"))


@query(f"""WITH b AS ({_BOXES}), p AS (SELECT a.l_orderkey, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i
    FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.k < b.k)
    SELECT l_orderkey, count(*) AS pairs FROM p WHERE round(i / (400 - i), 9) >= 0.3 GROUP BY 1""")
def j11_iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _boxes(spark, sf)
    a, b = boxes.toDF("l_orderkey", "ka", "a"), boxes.toDF("l_orderkey", "kb", "b")
    pairs = a.join(b, "l_orderkey").where("ka < kb").where(F.round(geometry.iou(F.col("a"), F.col("b")), 9) >= 0.3)
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"))


@query(f"""WITH RECURSIVE b AS ({_BOXES}), n AS (SELECT l_orderkey AS g, count(*) FILTER (k % 2 = 0) AS predicted, count(*) FILTER (k % 2 = 1) AS expected FROM b GROUP BY 1),
    x AS (SELECT a.l_orderkey AS g, CAST(a.k AS BIGINT) AS pi, CAST(b.k AS BIGINT) AS ri, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i
      FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.k % 2 = 0 AND b.k % 2 = 1),
    e AS (SELECT g, pi, ri, row_number() OVER (PARTITION BY g ORDER BY round(i / (400 - i), 9) DESC, pi DESC, ri DESC) AS k FROM x WHERE round(i / (400 - i), 9) >= 0.3), {_GREEDY}
    SELECT n.g AS l_orderkey, coalesce(matched, 0) AS matched, predicted, expected FROM n LEFT JOIN matches USING (g)""")
def j11_greedy_box_match(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of an order's even lines against those of its odd ones, one to one, greatest overlap first, then later ones."""
    boxes = _boxes(spark, sf)
    a = boxes.where("k % 2 = 0").select(F.col("l_orderkey").alias("ga"), F.col("k").alias("pi"), F.col("box").alias("a"))
    b = boxes.where("k % 2 = 1").select(F.col("l_orderkey").alias("gb"), F.col("k").alias("ri"), F.col("box").alias("b"))
    over = a.join(b, F.col("ga") == F.col("gb")).withColumn("iou", F.round(geometry.iou(F.col("a"), F.col("b")), 9)).where("iou >= 0.3")
    pairs = matching.greedy(over, ["ga", "pi"], ["gb", "ri"], [-F.col("iou"), -F.col("pi"), -F.col("ri")])
    counts = boxes.groupBy("l_orderkey").agg(F.count_if(F.col("k") % 2 == 0).alias("predicted"), F.count_if(F.col("k") % 2 == 1).alias("expected"))
    found = pairs.groupBy(F.col("ga").alias("l_orderkey")).agg(F.count("*").alias("m"))
    return counts.join(found, "l_orderkey", "left").select("l_orderkey", F.coalesce("m", F.lit(0)).alias("matched"), "predicted", "expected")


@query("""SELECT o_custkey, count(*) AS n FROM (SELECT a.o_custkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
    AND a.o_orderdate < b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate < a.o_orderdate + INTERVAL 30 DAY) GROUP BY 1""")
def j12_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("d"))
    a, b = orders.toDF("o_custkey", "ka", "da"), orders.toDF("o_custkey", "kb", "db")
    month = F.expr("interval 30 days")
    return a.join(b, "o_custkey").where("ka < kb").where((F.col("da") < F.col("db") + month) & (F.col("db") < F.col("da") + month)).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, arg_min(v, abs(v - p_size) * 100 + v) AS nearest FROM part, (VALUES (0), (7), (14), (21), (28), (35), (42), (49)) t(v) GROUP BY 1")
def j13_nearest(spark: SparkSession, sf: str) -> DataFrame:
    grid = F.array(*[F.lit(v) for v in range(0, 50, 7)])
    return J.nearest_value(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", grid).select("p_partkey", "nearest")


@query("SELECT c_custkey, o.o_orderkey AS best_order FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) o")
def j14_lateral_top1(spark: SparkSession, sf: str) -> DataFrame:
    best = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"))
    customers = table(spark, sf, "customer").select("c_custkey")
    return customers.join(best, customers["c_custkey"] == best["o_custkey"]).select("c_custkey", "best_order")


@query("SELECT p_partkey, min(n_nationkey) AS nation FROM part LEFT JOIN nation ON contains(lower(p_name || ' ' || p_type), lower(n_name[1:3])) GROUP BY 1")
def j15_substring(spark: SparkSession, sf: str) -> DataFrame:
    """A theta join as an equi-join on runs of letters: the first name in order that a part's text contains."""
    nations = table(spark, sf, "nation").select("n_nationkey", F.lower(F.substring("n_name", 1, 3)).alias("w"))
    part = table(spark, sf, "part").select("p_partkey", F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("t"))
    return substrings.first_contained(part, "p_partkey", "t", nations, "w", "n_nationkey", "nation").select("p_partkey", "nation")


@query("SELECT doc_id, min(item_id) AS item FROM documents LEFT JOIN (SELECT item_id, text[1:40] AS w FROM benchmark) ON contains(documents.text, w) GROUP BY 1")
def j15_passage_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The first benchmark item whose beginning stands somewhere in a document: a dimension of any size, whole texts."""
    items = table(spark, sf, "benchmark").select("item_id", F.substring("text", 1, 40).alias("w"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substrings.first_contained(docs, "doc_id", "text", items, "w", "item_id", "item").select("doc_id", "item")


@query("""SELECT o_orderkey, coalesce(d.flag, o_orderstatus) AS status FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, l_linenumber * 1e9 + l_extendedprice) AS flag FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) d
    ON o_orderkey = l_orderkey""")
def j16_override(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.redact import override

    decisions = table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("action"), (F.col("l_linenumber") * 1e9 + F.col("l_extendedprice")).alias("seq"))
    items = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("action"))
    return override(items, decisions, "o_orderkey").withColumnRenamed("action", "status")


@query("SELECT o_orderkey, coalesce(c_name, '') AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j17_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").select("o_orderkey", F.coalesce("c_name", F.lit("")).alias("name"))


@query("SELECT n_name, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j18_batch_lookup(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    by_nation = table(spark, sf, "customer").join(per, "c_custkey").groupBy("c_nationkey").agg(F.sum("k").alias("k"))
    nation = table(spark, sf, "nation")
    return nation.join(by_nation, nation["n_nationkey"] == by_nation["c_nationkey"], "left").select("n_name", F.coalesce("k", F.lit(0)).cast("long").alias("orders"))


@query("""WITH r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS k, count(*) OVER () AS n FROM region)
    SELECT i, r_name FROM range(23) t(i) JOIN r ON t.i % n = k""")
def j19_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return J.cyclic(table(spark, sf, "region"), "r_regionkey", 23).select("i", "r_name")


@query("SELECT conv_id, i AS place, roles[i] AS role, length(texts[i]) AS chars FROM (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY 1), LATERAL (SELECT unnest(generate_series(1, len(roles))) AS i)")
def j20_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Two sequences of a key side by side: each numbered by a scan, joined on the number."""
    turns = table(spark, sf, "conversations")
    place = lambda c: scans.numbered(turns.select("conv_id", "turn", c), ["conv_id"], ["turn"], "place").drop("turn")
    roles, texts = place("role"), place("text")
    return roles.join(texts, ["conv_id", "place"]).select("conv_id", "place", "role", F.length("text").cast("long").alias("chars"))


@query("SELECT event_id, name FROM events JOIN (SELECT c_custkey, min(c_name) AS name FROM customer GROUP BY 1) c ON user_id = c_custkey")
def j21_scalar_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").groupBy("c_custkey").agg(F.min("c_name").alias("name"))
    events = table(spark, sf, "events")
    return events.join(names, events["user_id"] == names["c_custkey"]).select("event_id", "name")


@query("""SELECT s_suppkey, coalesce(c_name, s_name) AS name FROM supplier LEFT JOIN (SELECT regexp_replace(lower(c_name), '[^0-9]+', '', 'g') AS k, min(c_name) AS c_name FROM customer GROUP BY 1) c
    ON regexp_replace(lower(s_name), '[^0-9]+', '', 'g') = k""")
def j22_reference_resolution(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda c: F.regexp_replace(F.lower(c), "[^0-9]+", "")
    known = table(spark, sf, "customer").groupBy(key("c_name").alias("k")).agg(F.min("c_name").alias("c_name"))
    return table(spark, sf, "supplier").withColumn("k", key("s_name")).join(known, "k", "left").select("s_suppkey", F.coalesce("c_name", "s_name").alias("name"))


@query("SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS next FROM part")
def j23_next_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).alias("next"))
