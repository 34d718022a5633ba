"""Projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import classify, scans
from ..sources.scratch import scratch
from .registry import query, table


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def prj01_first_match(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").where("r_name = 'ASIA'").limit(1)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def prj03_in_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE starts_with(CAST(p_partkey AS VARCHAR), '12')")
def prj04_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_partkey").cast("string").startswith("12")).select("p_partkey")


@query("SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS yes, count(*) FILTER (NOT l_discount > 0.05) AS no FROM lineitem GROUP BY 1")
def prj05_mask_and_negation(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("l_discount") > 0.05
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(c).alias("yes"), F.count_if(~c).alias("no"))


@query("SELECT event_id FROM events WHERE user_id % 2 = 0 OR event_type IN ('view', 'click')")
def prj06_empty_allows_all(spark: SparkSession, sf: str) -> DataFrame:
    allowed = F.when(F.col("user_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("view"), F.lit("click")))
    return table(spark, sf, "events").where((F.size(allowed) == 0) | F.array_contains(allowed, F.col("event_type"))).select("event_id")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS n FROM conversations GROUP BY 1")
def prj07_nested_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("t"))
    return rows.select("conv_id", F.size(F.filter("t", lambda x: x["role"] == "user")).cast("long").alias("n"))


@query("SELECT o_orderkey AS param_key, o_orderstatus AS param_status, 'orders' AS name FROM orders")
def prj09_prefixed_struct(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("p"))
    fields = [f.name for f in s.schema["p"].dataType.fields]
    return s.select(*[F.col(f"p.{k}").alias(f"param_{k}") for k in fields], F.lit("orders").alias("name"))


@query("SELECT doc_id, quality = toxic AS correct, CASE WHEN toxic = 1 THEN '__REVIEW__' ELSE 'ok' END AS label FROM labels")
def prj10_derived(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "NEEDS_REVIEW").otherwise("ok")
    return table(spark, sf, "labels").select("doc_id", (F.col("quality") == F.col("toxic")).alias("correct"), F.replace(label, F.lit("NEEDS_REVIEW"), F.lit("__REVIEW__")).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'actual' WHEN contains(p_type, 'BRASS') THEN 'derived' ELSE 'controlled' END AS source FROM part""")
def prj13_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "actual").when(F.contains("p_type", F.lit("BRASS")), "derived").otherwise("controlled").alias("source"))


_TITLES = """CASE WHEN o_orderkey % 7 = 0 THEN 'Form  FDA 1572' WHEN o_orderkey % 7 = 1 THEN 'STATEMENT OF INVESTIGATOR, form fda 1572' WHEN o_orderkey % 7 = 2 THEN 'Disclosure: the Financial Interests'
    WHEN o_orderkey % 7 = 3 THEN 'Clinical Study Protocol' WHEN o_orderkey % 7 = 4 THEN 'the protocol' WHEN o_orderkey % 7 = 5 THEN 'Schedule of Events' ELSE 'none' END"""


@query(f"""SELECT o_orderkey, CASE WHEN a + b > 0 THEN 'FDA_1572' WHEN c > 0 THEN 'FDA_3455' WHEN s >= 0.62 OR (s >= 0.45 AND t) THEN 'CLINICAL_TABLE' WHEN p THEN 'CLINICAL_PROTOCOL' ELSE 'UNKNOWN' END AS label,
    round(CASE WHEN a + b = 2 THEN 0.99 WHEN a + b > 0 OR c > 0 THEN 0.93 WHEN s >= 0.62 OR (s >= 0.45 AND t) THEN least(0.97, 0.62 + 0.35 * s) WHEN p AND contains(x, 'CLINICAL STUDY PROTOCOL') THEN 0.92 WHEN p THEN 0.84 ELSE 0.25 END, 6) AS confidence
    FROM (SELECT o_orderkey, x, s, CAST(regexp_matches(x, 'FORM\\s+FDA\\s+1572') AS INTEGER) AS a, CAST(contains(x, 'STATEMENT OF INVESTIGATOR') AS INTEGER) AS b, CAST(regexp_matches(x, 'DISCLOSURE.{{0,80}}FINANCIAL\\s+INTERESTS') AS INTEGER) AS c,
      regexp_matches(x, 'SCHEDULE OF EVENTS') AS t, regexp_matches(x, 'PROTOCOL|CLINICAL STUDY') AS p FROM (SELECT o_orderkey, upper({_TITLES}) AS x, (o_orderkey % 100) / 100.0 AS s FROM orders))""")
def prj14_rule_cascade(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_TITLES).alias("t"), (F.col("o_orderkey") % 100 / 100.0).alias("s"))
    return o.select("o_orderkey", classify.by_rules(F.col("t"), F.col("s")).alias("r")).select("o_orderkey", "r.label", F.round("r.confidence", 6).alias("confidence"))


@query("""SELECT doc_id, CASE WHEN r >= 0.8 AND lang <> 'es' THEN 'rule' WHEN m < 0.05 THEN 'image_low_margin' ELSE 'image_fallback' END AS source FROM (SELECT doc_id, lang, (doc_id % 40) / 40.0 AS r, (doc_id % 17) / 100.0 AS m FROM documents)""")
def prj15_hybrid_gate(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.struct(F.when(F.col("lang") == "es", "UNKNOWN").otherwise(F.col("lang")).alias("label"), (F.col("doc_id") % 40 / 40.0).alias("confidence"))
    gate = classify.gate(rule, F.lit("x"), F.lit(0.5), F.col("doc_id") % 17 / 100.0)
    return table(spark, sf, "documents").select("doc_id", gate["source"].alias("source"))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error' OR value > 99) THEN 'needs_review' ELSE 'completed' END AS status FROM events GROUP BY 1")
def prj17_terminal_status(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.when(F.bool_or((F.col("event_type") == "error") | (F.col("value") > 99)), "needs_review").otherwise("completed").alias("status"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ['PERSON'] WHEN c_custkey % 3 = 1 THEN ['ADDRESS'] ELSE [] END AS types FROM customer""")
def prj18_field_types(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.redact import field_types

    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "db_invest_name").when(k == 1, "db_inv_ZIP_address").otherwise("title")
    return table(spark, sf, "customer").select("c_custkey", field_types(name).alias("types"))


@query("SELECT event_id, CASE WHEN r >= 0.08 THEN 'checked' ELSE 'unchecked' END AS state, round(least(0.99, 0.55 + 4 * abs(r - 0.08)), 6) AS confidence FROM (SELECT event_id, (value % 20) / 100 AS r FROM events)")
def prj20_checkbox_state(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.numbers import checkbox_confidence

    r = (F.col("value") % 20) / 100
    return table(spark, sf, "events").select("event_id", F.when(r >= 0.08, "checked").otherwise("unchecked").alias("state"), F.round(checkbox_confidence(r, F.lit(0.08)), 6).alias("confidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '/v1/jobs/{id}' WHEN o_orderkey % 4 = 1 THEN '/v1/documents/{id}/artifacts/{id}' WHEN o_orderkey % 4 = 2 THEN '/' ELSE '/v1/health' END AS route FROM orders""")
def prj22_route(spark: SparkSession, sf: str) -> DataFrame:
    k, key = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/v1/jobs/"), key)).when(k == 1, F.concat(F.lit("/v1/documents/"), key, F.lit("/artifacts/a.csv"))).when(k == 2, "/").otherwise("/v1/health/")
    return table(spark, sf, "orders").select("o_orderkey", text.route(path).alias("route"))


@query("SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (ORDER BY p_brand, p_retailprice, p_partkey) AS place FROM part")
def srt01_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    """All rows, sorted, with their places.

    Rows are sorted in ranges of the keys; a place is that in its range and the counts of the ranges before. The
    ranges are written once, as they must be the same for counts and rows.
    """
    keys, path = ["p_brand", "p_retailprice", "p_partkey"], scratch(spark, "ranges")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    part.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema("p_partkey long, p_brand string, p_retailprice double, at long").parquet(path)
    rows = rows.withColumn("range", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(offsets), "range").select("p_partkey", "p_brand", "p_retailprice", (F.col("before") + F.col("within") + 1).alias("place"))
    return placed.orderBy("place")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey")
def srt02_metric_desc(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey")


@query("SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS reading FROM conversations GROUP BY 1")
def srt03_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return scans.joined_text(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], F.col("role"), " ", "reading")


@query("""SELECT pos, condition, n FROM (VALUES (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'refund')) o(pos, condition) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON condition = event_type""")
def srt06_custom_order(spark: SparkSession, sf: str) -> DataFrame:
    order = spark.createDataFrame([(1, "view"), (2, "click"), (3, "purchase"), (4, "refund")], "pos int, condition string")
    counts = table(spark, sf, "events").groupBy(F.col("event_type").alias("condition")).agg(F.count("*").alias("n"))
    return order.join(counts, "condition", "left").orderBy("pos").select("pos", "condition", "n")


@query("SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1")
def srt07_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").groupBy("label").agg(F.max_by("vec_id", -F.col("vec_id")).alias("vec_id"))


@query("SELECT doc_id FROM documents ORDER BY sha256('7|' || doc_id), doc_id LIMIT 50")
def srt08_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").orderBy(F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256), "doc_id").limit(50)


@query("SELECT r_regionkey AS k, r_name AS name, NULL AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def set01_union_all(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT r_regionkey AS k FROM region UNION SELECT n_regionkey FROM nation")
def set02_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("k")).union(table(spark, sf, "nation").select("n_regionkey")).distinct()


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set03_except(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("SELECT count(*) = 0 AS disjoint FROM (SELECT n_name FROM nation INTERSECT SELECT r_name FROM region)")
def set04_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "nation").select("n_name").intersect(table(spark, sf, "region").select("r_name"))
    return both.agg((F.count("*") == 0).alias("disjoint"))


@query("SELECT (SELECT count(*) FROM (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region)) + (SELECT count(*) FROM (SELECT r_regionkey FROM region EXCEPT SELECT n_regionkey FROM nation)) = 0 AS equal")
def set05_set_equality(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "nation").select(F.col("n_regionkey").alias("k")).distinct(), table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("equal"))


@query("""SELECT n_nationkey, string_agg(k || '=' || v, ';' ORDER BY k) AS merged FROM (
    SELECT n_nationkey, k, arg_max(v, side) AS v FROM (
      SELECT n_nationkey, 0 AS side, unnest(['name', 'region']) AS k, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS v FROM nation
      UNION ALL SELECT n_nationkey, 1, unnest(['region', 'comment']), unnest([r_name, r_name || n_name]) FROM nation JOIN region ON n_regionkey = r_regionkey)
    GROUP BY 1, 2) GROUP BY 1""")
def set06_row_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two maps of a row united; where both have a key the second counts."""
    both = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    second = F.create_map(F.lit("region"), F.col("r_name"), F.lit("comment"), F.concat("r_name", "n_name"))
    return both.select("n_nationkey", numbers.written_map(numbers.united(first, second)).alias("merged"))


@query("SELECT CASE WHEN NOT ends_with(url, '.html') THEN 'type' WHEN html = '' THEN 'empty' WHEN strlen(html) > 4000 THEN 'size' ELSE 'ok' END AS verdict, count(*) AS n FROM pages GROUP BY 1")
def src27_admission(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.files import admission

    return table(spark, sf, "pages").groupBy(admission(F.col("url"), F.octet_length("html"), (".html",), 4000).alias("verdict")).agg(F.count("*").alias("n"))
