"""Readers and writers of files. Schemas are always given; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import suffix


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with quotes and line ends inside quotes; several files or a glob are read as one table."""
    return spark.read.schema(schema).csv(path, header=header, quote='"', escape='"', multiLine=True)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A folder of JSON documents, one a file, with the file's stem in ``stem``."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("stem", F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1))


def one_per_group(df: DataFrame, group: str, preferred: Column, order: str) -> DataFrame:
    """One document of each group, preferred ones first."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(preferred.cast("int")), order))).where("_r = 1").drop("_r")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text, trimmed, without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")


def read_yaml(path: str) -> dict:
    """A small configuration, on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def paired(spark: SparkSession, path: str, first: str, second: str) -> DataFrame:
    """Files with the first suffix that have a partner of the same stem with the second one; listing only."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("stem")
    a, b = (read_binary(spark, path, f"*{s}").select(stem, F.col("path")) for s in (first, second))
    return a.withColumnRenamed("path", "first").join(b.withColumnRenamed("path", "second"), "stem")


def magic(content: Column, mark: bytes = b"%PDF") -> Column:
    return F.substring(content, 1, len(mark)) == F.lit(bytearray(mark))


def admission(name: Column, size: Column, suffixes: tuple[str, ...] = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff"), most: int = 25 * 1024 * 1024) -> Column:
    """Why an upload is refused (type, empty, size, in this order) or ``ok``."""
    return F.when(~suffix(name).isin(*suffixes), "type").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most, "size").otherwise("ok")


def read_table(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A table of a database; with a numeric column and (low, high, parts) it is read in parallel."""
    if column and bounds:
        return spark.read.jdbc(url, name, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=bounds[2], properties=options)
    return spark.read.jdbc(url, name, properties=options)


def openapi_routes(documents: DataFrame, body: str) -> DataFrame:
    """(path, method) rows of OpenAPI documents given as JSON texts, beside the documents' other columns."""
    rest = [c for c in documents.columns if c != body]
    paths = F.from_json(F.get_json_object(F.col(body), "$.paths"), "map<string, map<string, string>>")
    rows = documents.select(*rest, F.explode(paths).alias("path", "operations")).select(*rest, "path", F.explode("operations").alias("method", "_"))
    return rows.select(*rest, "path", F.upper("method").alias("method")).where(F.col("method").isin("GET", "POST", "PUT", "PATCH", "DELETE"))


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def html_table(matrix: Column) -> Column:
    """A matrix of strings as an HTML table, escaped."""

    def cell(x: Column) -> Column:
        x = F.coalesce(x, F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return F.concat(F.lit("<td>"), x, F.lit("</td>"))

    rows = F.transform(matrix, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))


def exposition(name: Column, labels: Column, value: Column) -> Column:
    """One line of Prometheus text: name{a="b"} value, from a map of labels."""
    quoted = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    inner = F.when(F.size(labels) > 0, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))).otherwise(F.lit(""))
    return F.concat(name, inner, F.lit(" "), value.cast("string"))


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Delete-then-insert by key: only the partitions that ``df`` has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Registry records from JSON files that hold them under ``studies``: column ``study``."""
    from ..operators.studies import STUDY

    return spark.read.schema(f"studies array<{STUDY}>").json(path, multiLine=True).select(F.explode("studies").alias("study"))
