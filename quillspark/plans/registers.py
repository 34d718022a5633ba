"""Cover pages, known records, names that resemble each other, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, similar, store
from ..sources import transactions
from ..sources.scratch import scratch
from .registry import query, table


def _covers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as texts of cover pages; some lack an amendment, some its number."""
    o = F.col("o_orderkey").cast("string")
    parts = [
        F.lit("Clinical Protocol\n"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("Protocol Title: A Phase "), (F.col("o_orderkey") % 4).cast("string"), F.lit(" study of order "), o, F.lit("\n"))),
        F.lit("Protocol Number : mRNA-"), o, F.lit("\nSponsor Name: "), F.when(F.col("o_orderkey") % 5 == 0, "Modernatx, inc").otherwise(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))),
        F.lit("\nLegal Registered Address: 1 Main Street; Cambridge , MA "), F.lpad(F.col("o_custkey").cast("string"), 5, "0"), F.lit("\nSponsor Contact: x\n"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Amendment Number: "), (F.col("o_orderkey") % 7).cast("string"), F.lit("\n"))),
        F.lit("Date of Amendment 9: 01 Jan 2001\nDate of Amendment "), (F.col("o_orderkey") % 7).cast("string"), F.lit(" : "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit("\nNCT#: NCT"), F.lpad(o, 8, "O"),
    ]
    return table(spark, sf, "orders").select("o_orderkey", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("body"))


_COVER_SQL = """SELECT o_orderkey, 'NCT' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS nct_id, 'mRNA-' || o_orderkey AS protocol_number, CASE WHEN o_orderkey % 5 = 0 THEN 'ModernaTX, Inc.' ELSE 'Customer ' || o_custkey END AS sponsor_name,
    '1 Main Street; Cambridge, MA ' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') AS sponsor_address, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 7 AS VARCHAR) END AS amendment_number,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d %b %Y') ELSE '01 Jan 2001' END AS amendment_date,
    CASE WHEN o_orderkey % 3 > 0 THEN 'A Phase ' || o_orderkey % 4 || ' study of order ' || o_orderkey END AS protocol_title, CASE WHEN o_orderkey % 3 > 0 THEN 'Phase ' || o_orderkey % 4 END AS phase,
    array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 1 THEN 'missing:amendment_number' END, CASE WHEN o_orderkey % 3 = 0 THEN 'missing:protocol_title' END, CASE WHEN o_orderkey % 3 = 0 THEN 'missing:phase' END], lambda x: x IS NOT NULL), ',') AS warnings FROM orders"""


@query(_COVER_SQL)
def str15_cover_page(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of cover pages and what is missing."""
    return extract.cover_fields(_covers(spark, sf), "body").drop("body").withColumn("warnings", F.array_join("warnings", ","))


@query(f"""SELECT c.o_orderkey, c.protocol_number, CASE WHEN c.o_orderkey % 4 = 0 THEN 'Registered ' || c.o_orderkey ELSE c.sponsor_name END AS sponsor_name, CASE WHEN c.o_orderkey % 4 = 0 THEN 'Phase 9' ELSE c.phase END AS phase
    FROM ({_COVER_SQL}) c""")
def j22_known_records(spark: SparkSession, sf: str) -> DataFrame:
    """Cover pages against a register: where the normalised numbers agree, the register's fields count."""
    known = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("MRNA "), F.col("o_orderkey").cast("string")).alias("protocol_number"), F.concat(F.lit("Registered "), F.col("o_orderkey").cast("string")).alias("sponsor_name"), F.lit("Phase 9").alias("phase"))
    found = extract.resolve_known(extract.cover_fields(_covers(spark, sf), "body"), known)
    number = F.concat(F.lit("mRNA-"), F.regexp_extract("protocol_number", "([0-9]+)$", 1))
    return found.select("o_orderkey", number.alias("protocol_number"), "sponsor_name", "phase")


@query()
def str13_similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """All different names of parts that resemble each other, each against all."""
    names = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("n")).distinct()
    return similar.similar(names, "n", names, "n").where("value <> known").select("value", "known", F.round("ratio", 9).alias("ratio"))


@query("""WITH e AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS q FROM events),
    a AS (SELECT user_id, count(*) AS n, max(event_id) AS m FROM events WHERE event_id % 2 = 1 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, max(event_id) AS m FROM events WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT 'jobs' AS what, count(DISTINCT user_id) AS n, CAST(sum(DISTINCT user_id) AS BIGINT) AS s FROM events UNION ALL SELECT 'events', count(*), CAST(sum(event_id) AS BIGINT) FROM events
    UNION ALL SELECT 'artifacts', count(*), CAST(sum(m) AS BIGINT) FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE user_id NOT IN (SELECT user_id FROM a))""")
def snk06_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs, events and artifacts are published as one, twice with the same number; a second transaction replaces artifacts of its jobs; private state stays private."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root, private = scratch(spark, "published"), scratch(spark, "private")
    jobs, _ = store.submitted(events.groupBy(F.col("user_id").alias("job_id")).agg(F.min("event_id").alias("document_id"), F.lit(1).alias("batch_id"), F.min("ts").alias("created_at")))
    artifact = lambda rows: rows.groupBy(F.col("user_id").alias("job_id")).agg(F.max("event_id").alias("m"))
    first = {"jobs": jobs, "events": events, "artifacts": artifact(events.where("event_id % 2 = 0")), "state": jobs}
    for _ in range(2):
        transactions.publish(spark, root, "first", first, private, ("state",), {"artifacts": "job_id"})
    transactions.publish(spark, root, "second", {"artifacts": artifact(events.where("event_id % 2 = 1"))}, replace={"artifacts": "job_id"})
    line = lambda name, column: transactions.read(spark, root, name).agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.sum(column).alias("s"))
    return line("jobs", "job_id").unionByName(line("events", "event_id")).unionByName(line("artifacts", "m"))
