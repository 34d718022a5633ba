"""Metric tables over lineitem, orders, labels and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import scans, summaries
from ..operators.percentiles import percentiles
from .registry import query, table


def _field() -> dict:
    return {"late_rate": F.col("l_discount") > 0.05, "mean_quantity": F.col("l_quantity"), "mean_price": F.col("l_extendedprice"), "mean_discount": F.col("l_discount"), "mean_tax": F.col("l_tax")}


_FIELD_SQL = """count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS late_rate, round(avg(l_quantity), 6) AS mean_quantity,
    round(avg(l_extendedprice), 6) AS mean_price, round(avg(l_discount), 6) AS mean_discount, round(avg(l_tax), 6) AS mean_tax"""


@query(f"SELECT l_returnflag, l_linestatus, {_FIELD_SQL} FROM lineitem GROUP BY ALL")
def a01_group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], _field())


@query(f"SELECT l_linestatus, {_FIELD_SQL} FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL")
def a02_filtered_overall(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "lineitem").where("l_returnflag <> 'N'"), ["l_linestatus"], _field())


@query("SELECT toxic, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM labels GROUP BY 1")
def a03_checkbox_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "labels"), ["toxic"], {"accuracy": F.col("quality") == 1})


@query("SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, round(avg(n_chars), 6) AS mean_declared FROM documents GROUP BY 1")
def a04_page_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "documents"), ["source"], {"mean_chars": F.length("text"), "mean_declared": F.col("n_chars")})


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price, round(sum(o_totalprice), 2) AS total_price FROM orders GROUP BY 1")
def a05_engine_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "orders"), ["o_orderpriority"], {"mean_price": F.col("o_totalprice")}, {"total_price": F.col("o_totalprice")})


@query("SELECT p_brand, p_size, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1, 2")
def a06_form_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "part"), ["p_brand", "p_size"], {"mean_price": F.col("p_retailprice")})


@query("""SELECT round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R'), 6) AS mean_returned,
    round(avg(l_extendedprice) FILTER (WHERE l_returnflag <> 'R'), 6) AS mean_other FROM lineitem""")
def a07_conditional_means(spark: SparkSession, sf: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").agg(
        F.round(F.avg((F.col("l_tax") > 0.04).cast("double")), 6).alias("rate"),
        F.round(F.avg(F.when(returned, price)), 6).alias("mean_returned"),
        F.round(F.avg(F.when(~returned, price)), 6).alias("mean_other"),
    )


@query("""SELECT o_orderstatus, o_orderpriority, grouping(o_orderpriority) = 1 AS is_total, count(*) AS n, round(avg(o_totalprice), 6) AS mean_price
    FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))""")
def a08_two_grain_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.grains(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderstatus"], {"mean_price": F.col("o_totalprice")})


@query("""SELECT l_returnflag, l_linestatus, grouping(l_linestatus) = 1 AS is_total, count(*) AS n, round(avg(l_discount), 6) AS mean_discount, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END), 6) AS large
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))""")
def a09_robustness_grains(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.grains(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"], {"mean_discount": F.col("l_discount"), "large": F.col("l_quantity") > 25})


#: An entity for each label: expected where quality is 1, predicted where toxic is 1; actions, containment and latency follow from the key.
_OUTCOMES = """SELECT lang, quality = 1 AS e, toxic = 1 AS p, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'review' ELSE 'redact' END END AS ea,
    CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 5 = 0 THEN 'review' ELSE 'redact' END END AS pa, (doc_id % 7) / 7.0::DOUBLE AS containment, n_chars / 1000.0::DOUBLE AS latency FROM documents JOIN labels USING (doc_id)"""
_COUNTS = f"""SELECT lang, count(*) AS rows, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn,
    count(*) FILTER (e AND ea = 'redact') AS to_redact, count(*) FILTER (e AND p AND ea = 'redact' AND pa = 'redact') AS covered, count(*) FILTER (pa = 'redact') AS redacted,
    count(*) FILTER (NOT e AND pa = 'redact') AS wrongly, count(*) FILTER (e AND p AND ea = pa) AS correct, count(*) FILTER (e) AS wanted,
    coalesce(avg(containment) FILTER (e AND p), 0) AS mean_containment, avg(latency) AS mean_latency FROM ({_OUTCOMES}) GROUP BY 1"""
_RATES = f"""SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
    CASE WHEN to_redact = 0 THEN 1.0 ELSE covered::DOUBLE / to_redact END AS redaction_coverage, 1 - CASE WHEN to_redact = 0 THEN 1.0 ELSE covered::DOUBLE / to_redact END AS missed_redaction_rate,
    CASE WHEN redacted = 0 THEN 0.0 ELSE wrongly::DOUBLE / redacted END AS false_redaction_rate, CASE WHEN wanted = 0 THEN 1.0 ELSE correct::DOUBLE / wanted END AS action_accuracy FROM ({_COUNTS})"""
_PRF = f"SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM ({_RATES})"
_METRICS = summaries.DETECTION_METRICS


def _by_language(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    e, p = F.col("quality") == 1, F.col("toxic") == 1
    action = lambda k: F.when(F.col("doc_id") % k == 0, "review").otherwise("redact")
    outcomes = joined.select("lang", e.alias("expected"), p.alias("predicted"), F.when(e, action(3)).alias("expected_action"), F.when(p, action(5)).alias("predicted_action"), (F.col("doc_id") % 7 / 7.0).alias("containment"), (F.col("n_chars") / 1000.0).alias("latency"))
    return summaries.detection_scores(outcomes, ["lang"])


@query("SELECT lang, rows, tp, fp, fn, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + f" FROM ({_PRF})")
def a10_prf_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _by_language(spark, sf).select("lang", "rows", "tp", "fp", "fn", *[F.round(m, 6).alias(m) for m in _METRICS])


@query("SELECT CAST(sum(rows) AS BIGINT) AS rows, " + ", ".join(f"round(sum({m} * rows) / greatest(sum(rows), 1), 6) AS {m}" for m in _METRICS) + f" FROM ({_PRF})")
def a11_weighted_overall(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.weighted(_by_language(spark, sf), [], _METRICS, "rows")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = 0 AND toxic = 0) AS a, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (toxic = 0) AS t0,
      count(*) FILTER (quality = 1 AND toxic = 1) AS b, count(*) FILTER (quality = 1) AS q1, count(*) FILTER (toxic = 1) AS t1 FROM labels)
    SELECT n, round(same::DOUBLE / n, 6) AS accuracy, round((CASE WHEN q0 + t0 = 0 THEN 0 ELSE 2.0 * a / (q0 + t0) END + CASE WHEN q1 + t1 = 0 THEN 0 ELSE 2.0 * b / (q1 + t1) END) / 3, 6) AS macro_f1 FROM c""")
def a12_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.macro_f1(table(spark, sf, "labels"), "quality", "toxic", [0, 1, 2])


@query("""SELECT lang, count(*) FILTER (quality = 0) AS "0", count(*) FILTER (quality = 1) AS "1" FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def a13_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return summaries.crosstab(joined, "lang", "quality", [0, 1])


@query("""SELECT lang, source, grouping(source) = 1 AS is_total, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) AS long_rate
    FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))""")
def a14_field_metrics_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.grains(table(spark, sf, "documents"), ["lang", "source"], ["lang"], {"mean_chars": F.col("n_chars"), "long_rate": F.col("n_chars") > 2000})


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events")
def a15_global_row(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.means(table(spark, sf, "events"), [], {"mean_value": F.col("value"), "error_rate": F.col("event_type") == "error"})


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events")
def a16_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


@query()
def a16_distinct_counts_approximate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def a17_distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").dropDuplicates(["user_id", "event_type"]).agg(F.count("*").alias("n"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'labels', count(*) FROM labels")
def a19_table_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("documents", "events", "orders", "labels")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a20_status_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS status_counts FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a20_status_histogram_map(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.status_histogram(table(spark, sf, "events"), "event_type").select(numbers.written_map(F.col("status_counts")).alias("status_counts"))


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes FROM documents GROUP BY 1")
def a23_artifact_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("total_bytes"))


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1")
def a24_box_union(spark: SparkSession, sf: str) -> DataFrame:
    q, p = "l_quantity", "l_extendedprice"
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min(q).alias("x0"), F.min(p).alias("y0"), F.max(q).alias("x1"), F.max(p).alias("y1"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def a25_dedup_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id")))  # pre-aggregates before the shuffle
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(best.alias("s")).select("user_id", "event_type", "s.*")


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def a26_dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("SELECT user_id, string_agg(event_type, ';' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def a27_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda s: s["event_type"]), ";").alias("types"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def a28_ordered_string_agg(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return scans.joined_text(turns, ["conv_id"], ["turn"], F.col("line"), "\n", "text")


@query("SELECT l_returnflag, array_to_string(list_sort(list(DISTINCT l_linenumber))[1:4], ',') AS first_numbers FROM lineitem GROUP BY 1")
def a29_group_topn_distinct(spark: SparkSession, sf: str) -> DataFrame:
    top = F.slice(F.array_sort(F.collect_set("l_linenumber")), 1, 4)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.array_join(top.cast("array<string>"), ",").alias("first_numbers"))


@query("SELECT lang, arg_min(quality, doc_id) FILTER (quality IS NOT NULL) AS quality, arg_min(toxic, doc_id) FILTER (toxic IS NOT NULL) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a30_first_non_null(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("doc_id"))).alias(c)
    return joined.groupBy("lang").agg(first("quality"), first("toxic"))


@query("SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a31_counts_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    # a handful of types: the window over all rows is over as many
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long"))


@query("""SELECT o_custkey, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE / greatest(count(*), 1), 6) AS rate FROM orders GROUP BY 1""")
def a32_verification_rates(spark: SparkSession, sf: str) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(done / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


@query("""WITH r AS (SELECT avg(l_discount) FILTER (l_linestatus = 'O') AS a, avg(l_discount) FILTER (l_linestatus = 'F') AS b FROM lineitem)
    SELECT round(CASE WHEN b = 0 THEN 0 ELSE (b - a) / b END, 6) AS reduction FROM r""")
def a34_error_reduction(spark: SparkSession, sf: str) -> DataFrame:
    mean = lambda s: F.avg(F.when(F.col("l_linestatus") == s, F.col("l_discount")))
    both = table(spark, sf, "lineitem").agg(mean("O").alias("a"), mean("F").alias("b"))
    return both.select(F.round(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.col("b")), F.lit(0.0)), 6).alias("reduction"))


@query("""SELECT 'fields' AS area, 'mean_discount' AS metric, round(avg(l_discount), 6) AS value, 'ratio' AS unit FROM lineitem
    UNION ALL SELECT 'fields', 'max_price', round(max(l_extendedprice), 6), 'usd' FROM lineitem
    UNION ALL SELECT 'documents', 'count', CAST(count(*) AS DOUBLE), 'rows' FROM documents
    UNION ALL SELECT 'jobs', 'p95', round(quantile_cont(value, 0.95), 6), 'seconds' FROM events""")
def a35_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    fields = table(spark, sf, "lineitem").agg(F.avg("l_discount").alias("m"), F.max("l_extendedprice").alias("x"))
    row = lambda area, metric, value, unit: F.struct(F.lit(area).alias("area"), F.lit(metric).alias("metric"), F.round(value.cast("double"), 6).alias("value"), F.lit(unit).alias("unit"))
    one = fields.select(F.inline(F.array(row("fields", "mean_discount", F.col("m"), "ratio"), row("fields", "max_price", F.col("x"), "usd"))))
    two = table(spark, sf, "documents").agg(F.count("*").alias("c")).select(F.inline(F.array(row("documents", "count", F.col("c"), "rows"))))
    three = percentiles(table(spark, sf, "events"), [], F.col("value"), {"p": 0.95}).select(F.inline(F.array(row("jobs", "p95", F.col("p"), "seconds"))))
    return one.unionByName(two).unionByName(three)


@query("SELECT round(60.0 * count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_minute FROM events")
def a36_throughput(spark: SparkSession, sf: str) -> DataFrame:
    seconds = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return table(spark, sf, "events").agg(F.round(60.0 * F.count("*") / seconds, 6).alias("per_minute"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def a37_amortised_cost(spark: SparkSession, sf: str) -> DataFrame:
    share = F.col("l_extendedprice") / F.count("*").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(share, 6).alias("share"))


@query("""SELECT lang, CAST(2 * count(*) FILTER (quality = toxic) AS BIGINT) AS hits, CAST(count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1) AS BIGINT) AS instances,
    round(CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 0 ELSE (count(*) FILTER (quality = 1 AND toxic = 1))::DOUBLE / count(*) FILTER (toxic = 1) END, 6) AS precision
    FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def a41_per_type_scores(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return joined.groupBy("lang").agg(
        (2 * F.count_if(F.col("quality") == F.col("toxic"))).alias("hits"),
        (F.count_if(q) + F.count_if(t)).alias("instances"),
        F.round(F.coalesce(F.try_divide(F.count_if(q & t), F.count_if(t)), F.lit(0.0)), 6).alias("precision"),
    )


@query("SELECT lang, bool_and(n_chars > 0) AS all_ok, bool_and(n_chars < 5000) AS all_short FROM documents GROUP BY 1")
def a42_all_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.bool_and(F.col("n_chars") > 0).alias("all_ok"), F.bool_and(F.col("n_chars") < 5000).alias("all_short"))


@query("""SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'P') THEN 'failed' ELSE 'unavailable' END AS status FROM orders GROUP BY 1""")
def a44_status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.when(F.bool_and(s == "F"), "completed").when(F.bool_or(s == "P"), "failed").otherwise("unavailable").alias("status"))
