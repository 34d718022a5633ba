"""Windows and sequences: running numbers, islands, medians, offsets, top-2 margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry, numbers
from ..operators import scans
from .registry import query, table


def _in_order():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")



@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def w01_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return scans.numbered(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "sequence").select("event_id", "sequence")


@query("SELECT user_id, count(*) FILTER (value < p) AS violations FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def w02_monotonic(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "events").select("user_id", "value", F.lag("value").over(_in_order()).alias("p"))
    return before.groupBy("user_id").agg(F.count_if(F.col("value") < F.col("p")).alias("violations"))


@query("""WITH c AS (SELECT l_orderkey, l_extendedprice AS x, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS cum, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS tot FROM lineitem)
    SELECT l_orderkey, min(x) AS median FROM c WHERE cum >= tot / 2 GROUP BY 1""")
def w03_weighted_median(spark: SparkSession, sf: str) -> DataFrame:
    own = Window.partitionBy("l_orderkey")
    run = own.orderBy("l_extendedprice", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), F.sum("l_quantity").over(run).alias("cum"), F.sum("l_quantity").over(own).alias("tot"))
    return c.where("cum >= tot / 2").groupBy("l_orderkey").agg(F.min("x").alias("median"))


@query("""WITH f AS (SELECT p_brand, p_retailprice AS v, p_partkey, CASE WHEN p_retailprice - lag(p_retailprice) OVER w <= 5 THEN 0 ELSE 1 END AS b FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY p_brand ORDER BY v, p_partkey) AS g FROM f)
    SELECT p_brand, CAST(g AS BIGINT) AS island, count(*) AS n, round(sum(v), 2) AS total FROM g GROUP BY p_brand, g""")
def w04_islands(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_brand", "p_retailprice", "p_partkey")
    near = F.col("p_retailprice") - F.col("before") <= 5
    islands = scans.islands(part, ["p_brand"], ["p_retailprice", "p_partkey"], {"before": F.col("p_retailprice")}, near, "island")
    return islands.groupBy("p_brand", "island").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("""WITH RECURSIVE v AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS s FROM part GROUP BY 1),
    k AS (SELECT p_brand, s, s[1] AS last, 1 AS n FROM v UNION ALL SELECT p_brand, s, list_filter(s, lambda x: x - last > 3)[1], n + 1 FROM k WHERE len(list_filter(s, lambda x: x - last > 3)) > 0)
    SELECT p_brand, CAST(max(n) AS INTEGER) AS kept, CAST(max(last) AS DOUBLE) AS last FROM k GROUP BY 1""")
def w05_representatives(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("double")).alias("v"))
    kept = sizes.select("p_brand", geometry.representatives(F.col("v"), 3.0).alias("r"))
    return kept.select("p_brand", F.size("r").alias("kept"), F.element_at("r", -1).alias("last"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 20 AS active FROM events),
    g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM e WHERE active),
    r AS (SELECT user_id, min(i) AS b, max(i) + 1 AS e FROM g GROUP BY user_id, g HAVING count(*) >= 2),
    f AS (SELECT *, CASE WHEN b - lag(e) OVER w <= 3 THEN 0 ELSE 1 END AS s FROM r WINDOW w AS (PARTITION BY user_id ORDER BY b)),
    m AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY b) AS m FROM f)
    SELECT user_id, min(b) AS "begin", max(e) AS "end" FROM m GROUP BY user_id, m""")
def w06_runs(spark: SparkSession, sf: str) -> DataFrame:
    return scans.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 20, 2, 3)


@query("""WITH u AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), r AS (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS k FROM u)
    SELECT vec_id, round(CAST(max(x) FILTER (k = 1) AS DOUBLE) - CAST(max(x) FILTER (k = 2) AS DOUBLE), 6) AS margin FROM r GROUP BY 1""")
def w07_top2_margin(spark: SparkSession, sf: str) -> DataFrame:
    top = F.sort_array("embedding", asc=False)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(top, F.lit(0)).cast("double") - F.get(top, F.lit(1)).cast("double"), 6).alias("margin"))


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations""")
def w08_offsets(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return scans.offsets(turns, ["conv_id"], ["turn"], (F.col("chars") + 1).cast("long"), "start").select("conv_id", "turn", "start")


@query("""WITH s AS (SELECT DISTINCT p_brand, p_size FROM part), e AS (SELECT p_brand, p_size AS x0, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS x1 FROM s)
    SELECT a.p_brand, a.x0, a.x1, b.x0 AS y0, b.x1 AS y1 FROM e a JOIN e b USING (p_brand) WHERE a.x1 IS NOT NULL AND b.x1 IS NOT NULL""")
def w09_adjacent_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_edges(spark, sf))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select("p_brand", "p_size").distinct()
    return sizes.withColumn("next", F.lead("p_size").over(Window.partitionBy("p_brand").orderBy("p_size"))).where("next is not null")


def _cells(edges: DataFrame) -> DataFrame:
    rows = edges.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(F.col("p_size").alias("a"), F.col("next").alias("b")))).alias("e"))
    cells = F.flatten(F.transform("e", lambda y: F.transform("e", lambda x: F.struct(x["a"].alias("x0"), x["b"].alias("x1"), y["a"].alias("y0"), y["b"].alias("y1")))))
    return rows.select("p_brand", F.inline(cells))


@query("""SELECT p_brand, CASE WHEN lo > 12 THEN [0.0] ELSE [] END || s || CASE WHEN 99 - hi > 12 THEN [99.0] ELSE [] END AS edges
    FROM (SELECT p_brand, list_sort(list(DISTINCT p_size::DOUBLE)) AS s, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)""")
def w10_outer_padding(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.col("p_size").cast("double"))).alias("s"))
    return sizes.select("p_brand", geometry.padded_boundaries(F.col("s"), F.lit(100)).alias("edges"))


@query("SELECT user_id, min(ts) FILTER (event_type <> 'signup') AS started_at, max(ts) AS last_at, round(epoch(max(ts) - min(ts) FILTER (event_type <> 'signup')), 3) AS elapsed FROM events GROUP BY 1")
def w11_first_last(spark: SparkSession, sf: str) -> DataFrame:
    bounds = table(spark, sf, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") != "signup", F.col("ts"))).alias("started_at"), F.max("ts").alias("last_at"))
    return bounds.withColumn("elapsed", F.round(numbers.elapsed_seconds(F.col("started_at").cast("timestamp"), F.col("last_at").cast("timestamp")), 3))


@query("SELECT max(ts) AS latest FROM events WHERE event_type IN ('purchase', 'error')")
def w12_latest_terminal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error")).agg(F.max("ts").alias("latest"))


@query("""SELECT conv_id, turn, CAST(15 + 60 * turn // n AS INTEGER) AS base, CAST(least(78, 15 + 60 * turn // n + 8) AS INTEGER) AS upper FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def w13_page_progress(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    base = numbers.page_progress(F.col("turn") + 1, F.col("n"))
    return pages.select("conv_id", "turn", base.alias("base"), F.least(F.lit(78), base + 8).alias("upper"))


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS INTEGER) AS r FROM lineitem")
def srt04_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("r"))
