"""Nested and semi-structured records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records, studies
from .registry import query, table


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.none.deep'), 'n/a') AS missing FROM events")
def jsn01_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.none.deep"), F.lit("n/a")).alias("missing"))


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records with nested lines by flag."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("lines"))
    return lines.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "lines")).alias("flags"))


@query("SELECT l_orderkey, l_returnflag, l_linenumber, l_quantity FROM lineitem")
def jsn02_explode(spark: SparkSession, sf: str) -> DataFrame:
    flags = _orders(spark, sf).select("l_orderkey", F.inline("flags"))
    return flags.select("l_orderkey", "l_returnflag", F.inline("lines"))


@query("SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'serious' ELSE 'other' END AS kind, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2")
def jsn03_tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two arrays of a record become one tagged array."""
    e = F.struct("l_linenumber")
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", e)).alias("serious"), F.collect_list(F.when(F.col("l_returnflag") == "A", e)).alias("other"))
    tagged = rows.select("l_orderkey", F.inline(F.array(F.struct(F.lit("serious").alias("kind"), F.col("serious").alias("events")), F.struct(F.lit("other").alias("kind"), F.col("other").alias("events")))))
    return tagged.select("l_orderkey", "kind", F.explode("events").alias("e")).groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"))


_RECORD = "struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,conditionsModule:struct<conditions:array<string>>>>"


@query("SELECT p_partkey, 'P' || p_partkey AS nct_id, p_name AS title, p_brand || '; ' || p_type AS conditions FROM part")
def jsn04_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Records go to JSON text and back by a given schema."""
    ident = F.struct(F.concat(F.lit("P"), F.col("p_partkey")).alias("nctId"), F.col("p_name").alias("briefTitle"))
    record = F.struct(F.struct(ident.alias("identificationModule"), F.struct(F.array("p_brand", "p_type").alias("conditions")).alias("conditionsModule")).alias("protocolSection"))
    parsed = table(spark, sf, "part").select("p_partkey", F.from_json(F.to_json(record), studies.STUDY).alias("s"))
    return studies.summary(parsed, "s").select("p_partkey", "nct_id", F.col("brief_title").alias("title"), "conditions")


@query("""SELECT r_regionkey, '{"key":' || r_regionkey || ',"name":"' || r_name || '"}' AS body FROM region""")
def jsn05_sorted_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("body"))


@query("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS body FROM nation""")
def jsn06_document(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct("*")).alias("body"))


@query("SELECT p_partkey, '[' || p_size || ',0,' || (p_size + 10) || ',5]' AS box FROM part")
def jsn07_box_text(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.array(s, F.lit(0), s + 10, F.lit(5))).alias("box"))


@query("SELECT page_id, '/' || page_id || url AS path, unnest(['GET', 'POST']) AS method FROM pages")
def src25_openapi(spark: SparkSession, sf: str) -> DataFrame:
    """Routes of interface descriptions, one for each page."""
    from ..sources.files import openapi_routes

    path = F.concat(F.lit("/"), F.col("page_id").cast("string"), "url")
    verbs = F.create_map(*[x for v in ("get", "post", "parameters") for x in (F.lit(v), F.create_map(F.lit("d"), F.lit(v)))])
    body = F.to_json(F.struct(F.create_map(path, verbs).alias("paths")))
    return openapi_routes(table(spark, sf, "pages").select("page_id", body.alias("body")), "body")


#: Records of several shapes: events as JSON texts whose keys are in no order.
_MIXED_SQL = """CASE event_type WHEN 'view' THEN '{"z":' || event_id || ',"a":{"y":[1,{"c":"' || event_type || '","b":null}],"x":' || props || '}}'
    WHEN 'click' THEN '[' || user_id || ',"' || event_type || '"]' WHEN 'error' THEN 'no json' ELSE '{"b":true,"a":' || user_id || '}' END"""
_MIXED_SORTED = """CASE event_type WHEN 'view' THEN '{"a":{"x":' || replace(props, ' ', '') || ',"y":[1,{"b":null,"c":"' || event_type || '"}]},"z":' || event_id || '}'
    WHEN 'click' THEN '[' || user_id || ',"' || event_type || '"]' WHEN 'error' THEN NULL ELSE '{"a":' || user_id || ',"b":true}' END"""


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.expr(_MIXED_SQL).alias("body"))


@query(f"SELECT event_id, {_MIXED_SORTED} AS body FROM events")
def jsn05_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Records of any shape with the keys of every object in order, at any depth."""
    return _mixed(spark, sf).select("event_id", records.canonical(F.col("body")).alias("body"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS deep, CASE event_type WHEN 'view' THEN event_type ELSE 'none' END AS place FROM events""")
def jsn01_deep_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values under paths of records of any shape, with a default where a path ends."""
    parsed = _mixed(spark, sf).select("event_id", F.try_parse_json("body").alias("v"))
    return parsed.select("event_id", records.value_at(F.col("v"), ["a", "x", "k"], "bigint").alias("deep"), records.value_at(F.col("v"), ["a", "y", 1, "c"], "string", F.lit("none")).alias("place"))


@query("""WITH e AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1), p AS (SELECT t, n, unnest(CASE t
      WHEN 'view' THEN ['$:object', '$.z:number', '$.a:object', '$.a.x:object', '$.a.x.k:number', '$.a.y:array', '$.a.y[]:number', '$.a.y[]:object', '$.a.y[].c:string', '$.a.y[].b:null']
      WHEN 'click' THEN ['$:array', '$[]:number', '$[]:string'] WHEN 'error' THEN [] ELSE ['$:object', '$.b:boolean', '$.a:number'] END) AS x FROM e)
    SELECT split_part(x, ':', 1) AS path, split_part(x, ':', 2) AS kind, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2""")
def jsn04_field_paths(spark: SparkSession, sf: str) -> DataFrame:
    """What shapes there are: every path with the kinds of its values and their number."""
    return records.field_paths(_mixed(spark, sf), "body").groupBy("path", "kind").agg(F.sum("n").alias("n"))


@query()
def ml01_svc(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier learns from some groups, is kept, read again, and says what the others are."""
    from ..operators import models
    from ..sources.scratch import scratch

    learn, held_out = models.split(table(spark, sf, "embeddings"), F.col("vec_id"))
    path = scratch(spark, "model")
    models.save(models.fit(learn, "embedding", "label"), path)
    out = models.classify(models.load(path), held_out, "embedding")
    return out.select("vec_id", "label", "prediction", F.round("confidence", 4).alias("confidence"), F.round("margin", 4).alias("margin"))
