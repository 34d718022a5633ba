"""Entities with their places and boxes, words in cells, persons by token rule, studies, the operational summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, patterns, spans
from ..operators import grids, jobs, redact, studies
from ..operators import joins as J
from ..sources.scratch import scratch
from .logs import _STATE, _log
from .registry import query, table


def _spans_sql(name: str, pattern: str, source: str, key: str) -> str:
    """The same places by running sums over pieces and matches."""
    return f"""SELECT {key}, '{name}' AS entity_type, CAST(b AS INTEGER) AS "begin", CAST(b + length(m) AS INTEGER) AS "end", m AS text FROM (
        SELECT {key}, m, sum(length(p) + length(m)) OVER (PARTITION BY {key} ORDER BY i) - length(m) AS b FROM (
          SELECT {key}, unnest(generate_series(1, len(ms))) AS i, unnest(ms) AS m, unnest(list_slice(ps, 1, len(ms))) AS p FROM (
            SELECT {key}, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM {source} WHERE text IS NOT NULL) WHERE len(ms) > 0))"""


#: The entity patterns without the flag that the other engine reads differently.
_ENTITIES = {"CCI_PROTOCOL_ID": patterns.PROTOCOL, "DATE": patterns.DATE, "ADDRESS": patterns.POSTAL, "NCT": patterns.NCT, "EMAIL": patterns.EMAIL, "PHONE_NUMBER": patterns.PHONE}
_ENTITIES = {k: p.replace("(?iU)", "(?i)").replace("(?U)", "") for k, p in _ENTITIES.items()}


@query(" UNION ALL ".join(_spans_sql(k, p, "documents", "doc_id") for k, p in _ENTITIES.items()))
def str26_entity_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every match of every entity pattern with its place."""
    typed = lambda kind: lambda s: F.struct(F.lit(kind).alias("entity_type"), s["begin"].alias("begin"), s["end"].alias("end"), s["text"].alias("text"))
    found = [F.transform(spans.spans(F.col("text"), p), typed(k)) for k, p in _ENTITIES.items()]
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.concat(*found)).alias("s"))
    return docs.select("doc_id", "s.*")


@query(f"""WITH words AS (
      SELECT conv_id, turn, CAST(sum(length(p) + length(w)) OVER (PARTITION BY conv_id, turn ORDER BY i) - length(w) AS INTEGER) AS b, w, turn AS line FROM (
        SELECT conv_id, turn, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS w, unnest(list_slice(ps, 1, len(ws))) AS p FROM (
          SELECT conv_id, turn, regexp_extract_all(text, '[^ \\n]+') AS ws, string_split_regex(text, '[^ \\n]+') AS ps FROM conversations WHERE text IS NOT NULL) WHERE len(ws) > 0)),
    span AS ({_spans_sql("SENTENCE", "[A-Z][a-z]+ [a-z]+ [a-z]+", "(SELECT *, conv_id * 1000 + turn AS k FROM conversations)", "k")})
    SELECT k // 1000 AS conv_id, k % 1000 AS turn, "begin", "end", CAST(count(*) AS INTEGER) AS tokens, CAST(min(b) * 6 AS DOUBLE) AS x0, CAST(min(line) * 10 AS DOUBLE) AS y0, CAST(max(b + length(w)) * 6 AS DOUBLE) AS x1, CAST(max(line) * 10 + 8 AS DOUBLE) AS y1
    FROM span JOIN words ON words.conv_id = k // 1000 AND words.turn = k % 1000 AND b + length(w) > "begin" AND b < "end" GROUP BY 1, 2, 3, 4""")
def j12_span_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Spans against tokens: how many tokens a span touches and the box around them (six points a character, ten a line)."""
    turns = table(spark, sf, "conversations").where("text is not null")
    row = ["conv_id", "turn"]
    tokens = turns.select(*row, F.explode(spans.spans(F.col("text"), "[^ \n]+")).alias("s")).select(*row, F.col("s.begin").alias("b"), F.col("s.end").alias("e"))
    found = turns.select(*row, F.explode(spans.spans(F.col("text"), "[A-Z][a-z]+ [a-z]+ [a-z]+")).alias("s")).select(*row, "s.begin", "s.end")
    met = J.overlapping(found, "begin", "end", tokens, "b", "e", row, 64)
    box = [(F.min("b") * 6.0).alias("x0"), (F.min("turn") * 10.0).alias("y0"), (F.max("e") * 6.0).alias("x1"), (F.max("turn") * 10.0 + 8).alias("y1")]
    return met.groupBy(*row, "begin", "end").agg(F.count("*").cast("int").alias("tokens"), *box)


_X, _Y = [0.0, 10.0, 20.0, 35.0, 50.0], [0.0, 3.0, 6.0, 10.0]


def _band_sql(value: str, bounds: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a} AND {value} <= {b} THEN {i}" for i, (a, b) in enumerate(zip(bounds, bounds[1:]))) + " END"


@query(f"""WITH w AS (SELECT l_orderkey, {_band_sql("l_quantity", _X)} AS c, {_band_sql("l_discount * 100", _Y)} AS r, CAST(trunc(l_discount * 100 - 1) AS INTEGER) AS t, CAST(trunc(l_quantity - 2) AS INTEGER) AS l, l_returnflag || l_linenumber AS text FROM lineitem),
    cell AS (SELECT l_orderkey, r, c, string_agg(text, ' ' ORDER BY t, l, text) AS text FROM w WHERE r IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2, 3),
    grid AS (SELECT l_orderkey, r, c FROM (SELECT DISTINCT l_orderkey FROM cell), range({len(_Y) - 1}) a(r), range({len(_X) - 1}) b(c))
    SELECT l_orderkey, string_agg(coalesce(text, ''), '|' ORDER BY r, c) AS matrix FROM grid LEFT JOIN cell USING (l_orderkey, r, c) GROUP BY 1""")
def j09_words_to_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Words into the cells of a grid by their centres, then dense rows: lines of an order stand for words of a page."""
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    words = table(spark, sf, "lineitem").select("l_orderkey", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), (q - 2).alias("left"), F.lit(4.0).alias("width"), (d - 1).alias("top"), F.lit(2.0).alias("height"))
    matrix = spans.words_to_matrix(words, ["l_orderkey"], _X, _Y)
    return matrix.select("l_orderkey", F.array_join(F.flatten("matrix"), "|").alias("matrix"))


_PAGE_EDGES = """SELECT l_orderkey, v AS lo, lead(v) OVER w AS hi, row_number() OVER w - 1 AS i FROM (SELECT DISTINCT l_orderkey, unnest([0.0, {last}, CASE WHEN l_linenumber % 2 = {odd} THEN {c} END]) AS v FROM line) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY l_orderkey ORDER BY v)"""


@query(f"""WITH line AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_returnflag || l_linenumber AS text FROM lineitem),
    xi AS MATERIALIZED ({_PAGE_EDGES.format(last="50.0", odd=0, c="x")}), yi AS MATERIALIZED ({_PAGE_EDGES.format(last="10.0", odd=1, c="y")}),
    c AS (SELECT id, min(i) AS c FROM line JOIN xi USING (l_orderkey) WHERE x >= lo AND x <= hi GROUP BY 1), r AS (SELECT id, min(i) AS r FROM line JOIN yi USING (l_orderkey) WHERE y >= lo AND y <= hi GROUP BY 1)
    SELECT l_orderkey, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS "column", string_agg(text, ' ' ORDER BY trunc(y - 1), trunc(x - 2), text) AS text FROM line JOIN c USING (id) JOIN r USING (id) GROUP BY 1, 2, 3""")
def j09_page_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Words into cells whose boundaries are each page's own: lines of an order stand for words, some lines' values for boundaries."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"))
    edge = lambda c, odd, last: lines.select("l_orderkey", F.explode(F.array(F.lit(0.0), F.lit(last), F.when(F.col("l_linenumber") % 2 == odd, F.col(c)))).alias("edge")).dropna().distinct()
    words = lines.select("l_orderkey", "text", (F.col("q") - 2).alias("left"), F.lit(4.0).alias("width"), (F.col("d") - 1).alias("top"), F.lit(2.0).alias("height"), F.col("q").alias("cx"), F.col("d").alias("cy"))
    return grids.cells(words, ["l_orderkey"], edge("q", 0, 50.0), edge("d", 1, 10.0), "edge", F.col("cx"), F.col("cy"))


_FIELD_NAMES = ["invest_name", "site_zip", "sigdate", "prot_name_code", "lab_name", "notes", "address_1", "appfirm"]


@query()
def src22_field_detections(spark: SparkSession, sf: str) -> DataFrame:
    """What fields hold, by what their names mean, with the box of the tokens that it rests on: documents stand for fields on a page."""
    name = F.element_at(F.array(*[F.lit(n) for n in _FIELD_NAMES]), (F.col("doc_id") % len(_FIELD_NAMES) + 1).cast("int"))
    fields = table(spark, sf, "documents").select("doc_id", name.alias("field_name"), F.col("text").alias("ocr_text"), F.lit(0.9).alias("ocr_confidence"))
    path = scratch(spark, "detections")
    redact.keep_best(redact.detect_fields(fields).drop("ocr_text"), ["doc_id", "entity_type", "field_name"]).write.parquet(path)
    found = spark.read.parquet(path)
    placed = fields.join(found.where(F.size("places") > 0).select("doc_id").distinct(), "doc_id", "left_semi")  # other fields' tokens are not asked for
    words = placed.select("doc_id", F.explode(spans.spans(F.col("ocr_text"), "[^ \n]+")).alias("s"))
    box = F.struct((F.col("s.begin") * 6.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("s.end") * 6.0).alias("x1"), F.lit(8.0).alias("y1"))
    tokens = words.select("doc_id", F.col("s.begin").alias("token_begin"), F.col("s.end").alias("token_end"), box.alias("token_box"))
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(800.0).alias("y1"))
    out = redact.resolve(redact.with_boxes(found, tokens, ["doc_id"], whole))
    return out.select("doc_id", "entity_type", "action", "needs_review", F.sha2("detected_text", 256).alias("text_sha256"), "box.*")


@query()
def str33_person_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Persons by token rule over letters of any script, with places."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(spans.spans(F.col("text"), patterns.PERSON_RULE)).alias("s"))
    return docs.select("doc_id", "s.*")


def _studies(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as registry records in JSON: measures by return flag, classes by line status, a category for each line."""
    lines = table(spark, sf, "lineitem")
    group = F.concat(F.lit("G"), F.col("l_linenumber").cast("string"))
    cell = F.struct(F.concat(F.lit("C"), F.col("l_linenumber").cast("string")).alias("title"), F.array(F.struct(group.alias("groupId"), F.col("l_quantity").cast("int").cast("string").alias("value"))).alias("measurements"))
    classes = lines.groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.collect_list(cell).alias("categories"))
    measures = classes.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("title"), "categories")).alias("classes"))
    titled = measures.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), F.lit("pieces").alias("unitOfMeasure"), "classes")).alias("measures"))
    stat = F.array(F.struct(group.alias("groupId"), F.col("l_quantity").cast("long").alias("numAffected")))
    event = F.struct(F.col("l_linestatus").alias("organSystem"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("term"), stat.alias("stats"))
    events = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", event)).alias("seriousEvents"), F.collect_list(F.when(F.col("l_returnflag") == "A", event)).alias("otherEvents"))
    groups = F.array(*[F.struct(F.lit(f"G{i}").alias("id"), F.lit(f"Group {i}").alias("title")) for i in (1, 2)])
    record = F.struct(
        F.struct(F.struct(F.concat(F.lit("NCT"), F.col("l_orderkey").cast("string")).alias("nctId")).alias("identificationModule")).alias("protocolSection"),
        F.struct(F.struct(groups.alias("groups"), "measures").alias("baselineCharacteristicsModule"), F.struct(groups.alias("eventGroups"), "seriousEvents", "otherEvents").alias("adverseEventsModule")).alias("resultsSection"),
    )
    text = titled.join(events, "l_orderkey").select(F.to_json(record).alias("record"))
    return text.select(F.from_json("record", studies.STUDY).alias("study"))


_GROUP = "CASE WHEN l_linenumber <= 2 THEN 'Group ' || l_linenumber ELSE 'G' || l_linenumber END"


@query(f"""SELECT 'NCT' || l_orderkey AS nct_id, l_returnflag AS measure, 'pieces' AS unit, l_linestatus AS class, 'C' || l_linenumber AS category, 'G' || l_linenumber AS group_id, {_GROUP} AS "group", CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS value FROM lineitem""")
def jsn02_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Four levels of a registry record flattened; groups by title where they have one."""
    return studies.baseline(_studies(spark, sf)).drop("spread")


@query(f"""SELECT 'NCT' || l_orderkey AS nct_id, CASE l_returnflag WHEN 'R' THEN 'serious' ELSE 'other' END AS severity, l_linestatus AS organ_system, 'T' || l_linenumber AS term, {_GROUP} AS "group", CAST(trunc(l_quantity) AS BIGINT) AS affected
    FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def jsn03_adverse_events(spark: SparkSession, sf: str) -> DataFrame:
    """Serious and other events of registry records in one tagged table."""
    return studies.adverse_events(_studies(spark, sf)).drop("at_risk", "events")


@query(f"""WITH j AS (SELECT * FROM ({_STATE})), s AS (SELECT status, count(*) AS n FROM j GROUP BY 1)
    SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM j) AS job_count, (SELECT count(*) FROM j WHERE status IN ('completed', 'failed')) AS terminal_job_count,
    (SELECT string_agg(status || '=' || n, ';' ORDER BY status) FROM s) AS status_counts, (SELECT count(*) FROM pages) AS artifact_count, (SELECT CAST(coalesce(sum(strlen(html)), 0) AS BIGINT) FROM pages) AS artifact_bytes""")
def a22_operational_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of documents, jobs, ended jobs, jobs by status, artifacts (pages here) and their bytes."""
    artifacts = table(spark, sf, "pages").agg(F.count("*").alias("artifact_count"), F.coalesce(F.sum(F.octet_length("html").cast("long")), F.lit(0)).alias("artifact_bytes"))
    documents = table(spark, sf, "documents").agg(F.count("*").alias("document_count"))
    state = jobs.job_state(_log(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))
    ended = F.col("status").isin(patterns.TERMINAL)
    by_status = F.map_from_entries(F.collect_list(F.struct("status", "n")))
    counts = state.agg(F.sum("n").alias("job_count"), F.coalesce(F.sum(F.when(ended, F.col("n"))), F.lit(0)).alias("terminal_job_count"), numbers.written_map(by_status).alias("status_counts"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(documents).join(one(counts), "_one").join(one(artifacts), "_one").drop("_one")
