"""Records of any shape, as variants: paths, values, one written form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(body: Column) -> Column:
    """JSON text with the keys of every object in order, at any depth, and no blanks; null where the text is no JSON.

    A variant keeps an object's fields by name, so writing it again is all there is to do.
    """
    return F.to_json(F.try_parse_json(body))


def value_at(record: Column, path: list[str | int], kind: str = "string", default: Column | None = None) -> Column:
    """The value under a path of keys and places of a variant, or the default where the path ends, is null or is of another kind."""
    at = "$" + "".join(f"[{p}]" if isinstance(p, int) else "['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)
    found = F.try_variant_get(record, at, kind)
    return found if default is None else F.coalesce(found, default)


def field_paths(records: DataFrame, body: str, most: int = 100) -> DataFrame:
    """Every path that occurs in JSON texts, with the kind of its values: path, kind, n (how many values).

    Objects add ``.key`` and arrays ``[]`` to a path; kinds are object, array, string, number, boolean and null. Levels are opened one
    after the other and counted as they are, so nothing gathers by record; it ends with the deepest record (at most ``most`` levels,
    beyond which it is an error). Texts that are no JSON don't count.
    """
    spark = records.sparkSession
    level = records.select(F.lit("$").alias("path"), F.try_parse_json(F.col(body)).alias("v")).where("v is not null")
    shape = F.schema_of_variant("v")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(F.is_variant_null("v"), "null").otherwise("number")
    counted = None
    for _ in range(most + 1):
        here = level.withColumn("kind", kind)
        counts = here.groupBy("path", "kind").agg(F.count("*").alias("n"))
        counted = counts if counted is None else counted.unionByName(counts)
        inner = here.where("kind in ('object', 'array')")
        if inner.isEmpty():
            return counted
        name = F.when(F.col("kind") == "object", F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit("[]")))
        level = inner.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select("key", F.col("value").alias("inner"))).select(name.alias("path"), F.col("inner").alias("v"))
    raise ValueError(f"records nest deeper than {most} levels")
