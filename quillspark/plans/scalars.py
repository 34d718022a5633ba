"""Scalar functions over documents, benchmark, conversations, pages and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, numbers, text
from ..operators.percentiles import percentiles
from .registry import query, table

_FOLDED = "{0}"
for _char, _letters in text.FOLDED.items():
    _FOLDED = f"replace({_FOLDED}, '{_char}', '{_letters}')"
_NORM = f"trim(regexp_replace(lower({_FOLDED}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def str01_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


_PAIR = "part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    a = part.select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("r"))
    b = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat("p_name", F.lit(" "), "p_type").alias("h"))
    return a.join(b, "p_partkey")


_R, _H = (_NORM.format(f"{t}.p_name || ' ' || {t}.p_type") for t in "ab")
_RC, _HC = f"replace({_R}, ' ', '')", f"replace({_H}, ' ', '')"


@query(f"SELECT a.p_partkey, CAST(levenshtein({_R}, {_H}) AS INTEGER) AS d FROM {_PAIR}")
def str02_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("p_partkey", F.levenshtein(text.normalize(F.col("r")), text.normalize(F.col("h"))).alias("d"))


@query(f"SELECT a.p_partkey, round(levenshtein({_RC}, {_HC})::DOUBLE / greatest(1, length({_RC})), 6) AS cer FROM {_PAIR}")
def str04_cer(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf).select("p_partkey", F.round(text.cer(F.col("r"), F.col("h")), 6).alias("cer"))


@query()
def str05_wer(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    a = turns.select("conv_id", "turn", F.col("text").alias("r"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("h"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.wer(F.col("r"), F.col("h")), 6).alias("wer"))


@query(f"""SELECT k AS p_partkey, r = h AS exact, round(cer, 6) AS cer, round(greatest(0, 1 - cer), 6) AS accuracy FROM (
    SELECT a.p_partkey AS k, {_R} AS r, {_H} AS h, levenshtein({_RC}, {_HC})::DOUBLE / greatest(1, length({_RC})) AS cer FROM {_PAIR})""")
def str06_score(spark: SparkSession, sf: str) -> DataFrame:
    s = text.score_field(F.col("r"), F.col("h"))
    return _neighbours(spark, sf).select("p_partkey", s.alias("s")).select("p_partkey", "s.exact", F.round("s.cer", 6).alias("cer"), F.round("s.accuracy", 6).alias("accuracy"))


@query("SELECT page_id, trim(regexp_replace(html, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS squeezed FROM pages")
def str07_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace("html", "[ \\t\\n\\r\\f]+", " ")).alias("squeezed"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS v FROM documents")
def str08_verification_form(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.verification_form(F.col("text")).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND length(d) >= 5 THEN d[1:5] WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN o_orderkey % 3 = 0 THEN d ELSE o_orderpriority END AS value
    FROM (SELECT *, regexp_replace(CAST(o_orderkey * 7919 AS VARCHAR), '[^0-9]', '', 'g') AS d FROM orders)""")
def str14_field_validation(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.extract import validated

    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, "site_zip").when(k == 1, "sigdate").otherwise("title")
    raw = F.when(k == 0, (F.col("o_orderkey") * 7919).cast("string")).when(k == 1, F.date_format("o_orderdate", "M - d - yyyy")).otherwise(F.col("o_orderpriority"))
    return o.select("o_orderkey", validated(name, raw).alias("value"))


@query()
def str13_ratio(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.extract import similarity

    return _neighbours(spark, sf).select("p_partkey", F.round(similarity(text.normalize(F.col("r")), text.normalize(F.col("h"))), 6).alias("ratio"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, CASE WHEN regexp_extract(html, '<title>([^<]*)', 1) = '' THEN 'missing:title' END AS warning FROM pages""")
def str15_label_anchor(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf, "pages").select("page_id", title.alias("title"), F.when(title == "", "missing:title").alias("warning"))


@query("SELECT c_custkey, replace(upper(c_name), 'O', '0') AS code FROM customer")
def str16_confusion_repair(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.translate(F.upper("c_name"), "O", "0").alias("code"))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size > 25 THEN 'missing:size' END, CASE WHEN p_retailprice > 1000 THEN 'missing:price' END, CASE WHEN p_brand LIKE '%1' THEN 'missing:brand' END], lambda x: x IS NOT NULL) AS warnings FROM part""")
def str18_warnings(spark: SparkSession, sf: str) -> DataFrame:
    w = [F.when(F.col("p_size") > 25, "missing:size"), F.when(F.col("p_retailprice") > 1000, "missing:price"), F.when(F.col("p_brand").endswith("1"), "missing:brand")]
    return table(spark, sf, "part").select("p_partkey", F.array_compact(F.array(*w)).alias("warnings"))


@query("""SELECT c_custkey, CASE WHEN length(t) = 0 THEN '' WHEN length(t) <= 2 THEN repeat('*', length(t)) ELSE t[1] || repeat('*', least(length(t) - 2, 12)) || t[-1:] END AS masked FROM (SELECT c_custkey, trim(c_name) AS t FROM customer)""")
def str20_mask(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.mask(F.col("c_name")).alias("masked"))


@query(r"SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]', '[EMAIL]', 'g') AS redacted FROM documents")
def str21_span_redaction(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import patterns
    from ..operators.redact import redact_text

    return table(spark, sf, "documents").select("doc_id", redact_text(F.col("text"), [("EMAIL", patterns.EMAIL)]).alias("redacted"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def str22_sha(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT c_custkey, regexp_replace(c_name, '[^A-Za-z0-9_-]', '', 'g')[1:32] || '-' || sha256(c_name)[1:16] AS id FROM customer")
def str23_document_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.document_id(F.col("c_name"), F.sha2("c_name", 256)).alias("id"))


@query("SELECT l_orderkey, l_linenumber, sha256(l_orderkey || '|' || l_linenumber || '|' || l_returnflag)[1:16] AS id FROM lineitem")
def str24_candidate_id(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_returnflag")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.substring(F.sha2(key, 256), 1, 16).alias("id"))


@query("SELECT c_custkey, (CAST('0x' || sha256(c_name)[1:8] AS BIGINT) + 20260115) % 2147483647 AS seed FROM customer")
def str25_seed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", text.stable_seed(F.col("c_name"), 20260115).alias("seed"))


@query(r"SELECT doc_id, regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS found FROM documents")
def str26_find_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0)).alias("found"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]')) AS INTEGER) AS emails, CAST(len(regexp_extract_all(text, '[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}')) AS INTEGER) AS phones,
    CAST(len(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+')) AS INTEGER) AS persons FROM documents""")
def str27_pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import patterns

    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return table(spark, sf, "documents").select("doc_id", n(patterns.EMAIL).alias("emails"), n(patterns.PHONE).alias("phones"), n(patterns.ASCII_PERSON).alias("persons"))


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ' ' || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) AS flat FROM lineitem GROUP BY 1")
def str28_flat_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: F.array(s["l_linenumber"].cast("string"), s["l_returnflag"]))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.flat_matrix(rows).alias("flat"))


@query("SELECT user_id, string_agg(event_type, '; ' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def str29_joined(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("types"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) AS s FROM documents")
def str30_squeeze(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("s"))


@query(r"SELECT page_id, lower(regexp_extract(url, '(\.[^.]+)$', 1)) AS suffix, starts_with(url, 'http') AS web, contains(url, '/') AS path, ends_with(url, 'l') AS l FROM pages")
def str31_suffix(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.suffix(url).alias("suffix"), url.startswith("http").alias("web"), url.contains("/").alias("path"), url.endswith("l").alias("l"))


@query("SELECT doc_id, text[1:1000] AS head FROM documents")
def str34_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 1000).alias("head"))


@query("SELECT o_orderkey, coalesce(strftime(try_strptime(CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%d %b %Y') END, '%d %b %Y'), '%m/%d/%Y'), '01/15/2026') AS d FROM orders")
def dt01_date_format(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "dd MMM yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.date_format(F.to_date(raw, "dd MMM yyyy"), "MM/dd/yyyy"), F.lit("01/15/2026")).alias("d"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def dt02_iso(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT user_id, round(greatest(0, epoch(max(ts)) - epoch(min(ts))), 3) AS seconds FROM events GROUP BY 1")
def dt03_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min(t).alias("a"), F.max(t).alias("b")).select("user_id", F.round(numbers.elapsed_seconds(F.col("a"), F.col("b")), 3).alias("seconds"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(CASE WHEN u = 0 THEN 0 ELSE i / u END, 6) AS iou FROM (
    SELECT *, i AS ii, 400 + 225 - i AS u FROM (SELECT *, greatest(0, least(l_quantity + 20, 35) - greatest(l_quantity, 20)) * greatest(0, least(l_tax * 100 + 20, 20) - greatest(l_tax * 100, 5)) AS i FROM lineitem))""")
def mth01_iou(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_tax") * 100
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 20).alias("y1"))
    fixed = F.struct(F.lit(20.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(35.0).alias("x1"), F.lit(20.0).alias("y1"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(geometry.iou(box, fixed), 6).alias("iou"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, round(greatest(0, least(l_quantity + 20, 35) - greatest(l_quantity, 20)) * 15 / (20 * 15), 6) AS inside FROM lineitem""")
def mth02_containment(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l_quantity")
    box = F.struct(x.alias("x0"), F.lit(5.0).alias("y0"), (x + 20).alias("x1"), F.lit(20.0).alias("y1"))
    fixed = F.struct(F.lit(20.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(35.0).alias("x1"), F.lit(40.0).alias("y1"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(geometry.containment(box, fixed), 6).alias("inside"))


@query("""WITH c AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS m, count(*) FILTER (o_orderpriority < '3') AS p, count(*) FILTER (o_totalprice > 400000) AS e FROM orders GROUP BY 1),
    r AS (SELECT *, CASE WHEN p = 0 AND e = 0 THEN 1.0 WHEN p = 0 THEN 0.0 ELSE m::DOUBLE / p END AS precision, CASE WHEN p = 0 AND e = 0 THEN 1.0 WHEN e = 0 THEN 0.0 ELSE m::DOUBLE / e END AS recall FROM c)
    SELECT o_custkey, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r""")
def mth03_prf(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("m"), F.count_if(F.col("o_orderpriority") < "3").alias("p"), F.count_if(F.col("o_totalprice") > 400000).alias("e"))
    scores = c.select("o_custkey", geometry.prf(F.col("m"), F.col("p"), F.col("e")).alias("s"))
    return scores.select("o_custkey", *[F.round(f"s.{m}", 6).alias(m) for m in ("precision", "recall", "f1")])


@query("""SELECT p_partkey, CAST(greatest(0, round_even((p_size - 1.5) * 300 / 72.0, 0)) AS INTEGER) AS x0, CAST(round_even((p_size + 20 + 1.5) * 300 / 72.0, 0) AS INTEGER) AS x1 FROM part""")
def mth04_points_to_pixels(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    box = geometry.to_pixels(F.struct(s.alias("x0"), s.alias("y0"), (s + 20).alias("x1"), (s + 20).alias("y1")), 300)
    return table(spark, sf, "part").select("p_partkey", box["x0"].alias("x0"), box["x1"].alias("x1"))


@query("SELECT p_partkey, CASE WHEN least(30, p_size + 10) > greatest(0, p_size - 5) THEN greatest(0, p_size - 5) END AS x0 FROM part")
def mth05_clip(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    box = F.struct((s - 5).alias("x0"), F.lit(0).alias("y0"), (s + 10).alias("x1"), F.lit(5).alias("y1"))
    return table(spark, sf, "part").select("p_partkey", geometry.clip(box, F.lit(30), F.lit(30))["x0"].alias("x0"))


@query("SELECT p_partkey, round(p_size * CASE WHEN p_size < 25 THEN 0.5 ELSE 1 END * 72.0 / 300, 6) AS x0 FROM part")
def mth06_pixels_to_points(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size").cast("double")
    box = geometry.to_points(F.struct(*[s.alias(c) for c in ("x0", "y0", "x1", "y1")]), 300, s < 25)
    return table(spark, sf, "part").select("p_partkey", F.round(box["x0"], 6).alias("x0"))


@query("SELECT p_partkey, round(least(1, 0.55 * (p_size % 7) / 5 + 0.45 * (p_size % 5) / 4), 6) AS score FROM part")
def mth07_table_score(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", F.round(geometry.table_score(s % 7, s % 5), 6).alias("score"))


@query("""SELECT event_id, round(greatest(0.55, c), 6) AS regex, round(least(0.99, 0.7 + 0.3 * c), 6) AS person, round(least(0.99, 0.72 + 0.28 * c), 6) AS semantic, round(least(0.99, 0.76 + 0.24 * c), 6) AS protocol
    FROM (SELECT event_id, (value % 100) / 100 AS c FROM events)""")
def mth08_confidence_maps(spark: SparkSession, sf: str) -> DataFrame:
    c = (F.col("value") % 100) / 100
    out = [F.round(numbers.detector_confidence(k.upper(), c), 6).alias(k) for k in ("regex", "person", "semantic", "protocol")]
    return table(spark, sf, "events").select("event_id", *out)


@query("SELECT event_type, round(quantile_cont(value, 0.85), 6) AS p85 FROM events GROUP BY 1")
def mth09_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles(table(spark, sf, "events"), ["event_type"], F.col("value"), {"p85": 0.85}).select("event_type", F.round("p85", 6).alias("p85"))


@query("SELECT event_id, round(abs(value - 50), 6) AS residual, round_even(value, 1) AS rounded, greatest(0, least(1, value / 50)) AS clamped FROM events")
def mth11_rounding(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(F.abs(v - 50), 6).alias("residual"), F.bround(v, 1).alias("rounded"), numbers.clamp01(v / 50).alias("clamped"))


@query("""WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, round(exp(max(x)) / sum(exp(x)), 6) AS top FROM u GROUP BY 1""")
def mth13_softmax(spark: SparkSession, sf: str) -> DataFrame:
    whole = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.array_max(numbers.softmax(whole)), 6).alias("top"))


@query("SELECT vec_id, CAST(embedding[3:6] AS DOUBLE[]) AS part, CAST(len(embedding) AS INTEGER) AS n, embedding[1] AS first, embedding[-1] AS last FROM embeddings")
def arr01_slices(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.slice(e, 3, 4).cast("array<double>").alias("part"), F.size(e).alias("n"), F.get(e, F.lit(0)).alias("first"), F.element_at(e, -1).alias("last"))


@query("WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS r FROM events GROUP BY 1) SELECT user_id, list_resize(r, (SELECT max(len(r)) FROM l), '') AS padded FROM l")
def arr02_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lists, padded to the greatest length found."""
    events = table(spark, sf, "events")
    lists = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("r"))
    width = events.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").cast("int").alias("width"))
    return lists.crossJoin(F.broadcast(width)).select("user_id", F.concat("r", F.array_repeat(F.lit(""), F.col("width") - F.size("r"))).alias("padded"))


@query("""WITH g AS (SELECT p_brand, k, coalesce(max(p_size) FILTER (p_size % 4 = k), -1) AS m FROM part, range(4) t(k) GROUP BY 1, 2) SELECT p_brand, list(m ORDER BY k) AS row FROM g GROUP BY 1""")
def arr03_dense_row(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda k: F.coalesce(F.max(F.when(F.col("p_size") % 4 == k, F.col("p_size"))), F.lit(-1))
    return table(spark, sf, "part").groupBy("p_brand").agg(F.array(*[cell(k) for k in range(4)]).alias("row"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'viewed' WHEN 'click' THEN 'clicked' ELSE event_type END AS title FROM events")
def map01_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    names = F.create_map(F.lit("view"), F.lit("viewed"), F.lit("click"), F.lit("clicked"))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.col("event_type")).alias("title"))


@query("SELECT n_regionkey, string_agg(n_nationkey || '=' || n_name, ';' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def map02_from_rows(spark: SparkSession, sf: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))))
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(numbers.written_map(F.map_from_entries(pairs)).alias("names"))
