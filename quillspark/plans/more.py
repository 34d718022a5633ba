"""Further operators: matrices, balance, sinks and readers as round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns, text
from ..operators import augment, extract, redact
from ..sources import files
from ..sources.scratch import scratch
from .registry import query, table


@query("""WITH c AS (SELECT p_brand, replace(lower(p_type), ' ', '') AS r, replace(lower(p_name), ' ', '') AS h FROM part)
    SELECT p_brand, round(avg(levenshtein(r, h)::DOUBLE / greatest(1, length(r))), 6) AS mean_cer, round(avg(CASE WHEN r = h THEN 1.0 ELSE 0.0 END), 6) AS exact FROM c GROUP BY 1""")
def a33_matrix_cer(spark: SparkSession, sf: str) -> DataFrame:
    """Cell by cell error of two matrices of the same shape: a brand's types against its names."""
    cells = F.array_sort(F.collect_list(F.struct("p_partkey", F.col("p_type").alias("r"), F.col("p_name").alias("h"))))
    matrix = table(spark, sf, "part").groupBy("p_brand").agg(F.transform(cells, lambda c: c["r"]).alias("r"), F.transform(cells, lambda c: c["h"]).alias("h"))
    pairs = matrix.select("p_brand", F.posexplode(F.arrays_zip("r", "h")).alias("i", "z")).select("p_brand", text.cer(F.col("z.r"), F.col("z.h")).alias("e"))
    return pairs.groupBy("p_brand").agg(F.round(F.avg("e"), 6).alias("mean_cer"), F.round(F.avg((F.col("e") == 0).cast("double")), 6).alias("exact"))


@query("""WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
    SELECT n_regionkey, n_nationkey, CAST(i // n AS INTEGER) AS copy FROM r, range(12) t(i) WHERE i % n = k""")
def a43_class_balance(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select("n_regionkey", "n_nationkey")
    return augment.balanced(rows, "n_regionkey", "n_nationkey", 12)


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag <> 'N'")
def prj02_not_equal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_returnflag <> 'N'").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT p_partkey, p_name, p_size * 2 AS double_size FROM part")
def prj08_key_subset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", (F.col("p_size") * 2).alias("double_size"))


@query("""SELECT doc_id, CASE WHEN q IS NULL THEN 'FP' WHEN t IS NULL THEN 'FN' ELSE 'TP' END AS outcome FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 1 END AS q, CASE WHEN toxic = 1 THEN 1 END AS t FROM labels) WHERE q IS NOT NULL OR t IS NOT NULL""")
def prj12_outcome(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, sf, "labels").where(q | t).select("doc_id", F.when(~q, "FP").when(~t, "FN").otherwise("TP").alias("outcome"))


@query("SELECT event_id, greatest(0, least(1, value / 60)) AS v FROM events")
def prj21_clamp(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.numbers import clamp01

    return table(spark, sf, "events").select("event_id", clamp01(F.col("value") / 60).alias("v"))


@query()
def str03_token_distance(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    a, b = text.tokens(F.concat_ws(" ", "p_name", "p_type")), text.tokens(F.concat_ws(" ", "p_type", "p_brand"))
    return part.select("p_partkey", text.token_distance(a, b).alias("d"))


@query(r"SELECT c_custkey, CASE WHEN contains(lower(c_name), '01') THEN 'ModernaTX, Inc.' ELSE c_name END AS sponsor, 'Cambridge, MA 02139' AS address FROM customer")
def str17_canonical_sponsor(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.extract import _canonical

    raw = table(spark, sf, "customer").select("c_custkey", F.when(F.contains("c_name", F.lit("01")), "modernaTX  inc").otherwise(F.col("c_name")).alias("sponsor_name"), F.lit("cambridge , MA 02139").alias("sponsor_address"))
    return _canonical(raw).select("c_custkey", F.col("sponsor_name").alias("sponsor"), F.col("sponsor_address").alias("address"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]+)</title>', 1), '') AS title, nullif(regexp_extract(html, 'href="([^"]+)"', 1), '') AS link,
    list_filter([CASE WHEN regexp_extract(html, '<title>([^<]+)</title>', 1) = '' THEN 'missing:title' END, CASE WHEN regexp_extract(html, 'href="([^"]+)"', 1) = '' THEN 'missing:link' END], lambda x: x IS NOT NULL) AS missing FROM pages""")
def str19_strict_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Strict extraction by labels: no repair; a missing label gives null and is named (``strict`` raises instead)."""
    labels = {"title": "<title>([^<]+)</title>", "link": 'href="([^"]+)"'}
    return extract.labelled(table(spark, sf, "pages").select("page_id", "html"), "html", labels).drop("html")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+[,.]?')) AS INTEGER) AS names FROM documents")
def str33_title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+[,.]?"), F.lit(0))).alias("names"))


@query("SELECT event_id, round(abs(1.5 + (value - 50) / 10), 6) AS residual FROM events")
def mth12_rotation_residual(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(F.abs(1.5 + (F.col("value") - 50) / 10), 6).alias("residual"))


@query()
def mth14_seeded_draws(spark: SparkSession, sf: str) -> DataFrame:
    return augment.draws(table(spark, sf, "part").select("p_partkey"), "p_partkey", -1.5, 1.5, 7)


@query("SELECT n_nationkey, condition FROM nation, (VALUES " + ", ".join(f"('{c}')" for c in augment.CONDITIONS) + ") c(condition)")
def ml05_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return augment.under_conditions(table(spark, sf, "nation").select("n_nationkey"))


@query("SELECT user_id, event_id, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3")
def srt05_truncated(spark: SparkSession, sf: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("user_id", "event_id", k.alias("k")).where("k <= 3")


@query("SELECT url, page_id FROM pages ORDER BY url, page_id")
def srt10_path_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", "page_id").orderBy("url", "page_id")


@query("SELECT n_regionkey, '<table>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation GROUP BY 1")
def snk04_html(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: F.array(s["n_nationkey"].cast("string"), s["n_name"]))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(files.html_table(rows).alias("html"))


@query("""SELECT 'events_total{type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def snk14_exposition(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select(files.exposition(F.lit("events_total"), F.create_map(F.lit("type"), F.col("event_type")), F.col("n")).alias("line"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src03_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    nation, path = table(spark, sf, "nation"), scratch(spark, "csv")
    files.write_csv(nation, path)
    return files.read_csv(spark, path, nation.schema)


@query("SELECT * FROM orders")
def src02_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    orders, path = table(spark, sf, "orders"), scratch(spark, "json")
    files.write_json(orders, path)
    return spark.read.schema(orders.schema).json(path)


@query("SELECT CAST(part AS VARCHAR) AS part, count(*) AS n FROM (SELECT s_suppkey % 3 AS part FROM supplier) GROUP BY 1")
def snk08_partition_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """One partition is written twice; only it is replaced."""
    rows, path = table(spark, sf, "supplier").withColumn("part", (F.col("s_suppkey") % 3).cast("string")), scratch(spark, "parts")
    files.replace_partitions(rows, path, "part")
    files.replace_partitions(rows.where("part = '1'"), path, "part")
    return spark.read.schema(rows.schema).parquet(path).groupBy("part").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+')) > 0 AS person FROM documents")
def udf03_swappable_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """A detector is a function from DataFrame to DataFrame, put in by ``transform``."""

    def persons(df: DataFrame) -> DataFrame:
        return redact.detect(df, "text", F.lit(1.0), [("PERSON", patterns.ASCII_PERSON)]).select("doc_id").distinct().withColumn("person", F.lit(True))

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id").join(docs.transform(persons), "doc_id", "left").select("doc_id", F.coalesce("person", F.lit(False)).alias("person"))
