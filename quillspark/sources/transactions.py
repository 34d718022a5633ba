"""Several tables published together: all of a transaction is seen, or nothing.

Tables are written under the transaction's own folder; what makes them visible is one small file in ``manifest``, whose
name is the next number and which is created by a rename that fails if another writer was first. A job that dies before that leaves
files that no reader looks at. All of it goes by Spark's own writers and file systems, so any store with a rename will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, root: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root}/manifest")
    return hadoop, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> list[dict]:
    """What has been published, oldest first: one entry a transaction."""
    hadoop, fs = _fs(spark, root)
    folder = hadoop.Path(f"{root}/manifest")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    out = []
    for name in names:
        stream = fs.open(hadoop.Path(f"{root}/manifest/{name}"))
        out.append(json.loads(read.toString(stream, "UTF-8")))
        stream.close()
    return out


def publish(spark: SparkSession, root: str, transaction: str, tables: dict[str, DataFrame], private: str | None = None, hidden: tuple[str, ...] = (), replace: dict[str, str] | None = None, tries: int = 20) -> bool:
    """Write tables and make them visible as one; false, with nothing changed, if the transaction was published before.

    ``hidden`` names tables that go under ``private`` instead, a folder of its own rights: readers of ``root`` never learn of
    their places. ``replace`` maps a table to a key: earlier rows of the keys that this transaction has are gone for its readers.
    """
    if any(m["transaction"] == transaction for m in _manifests(spark, root)):
        return False
    place = f"data/{uuid.uuid4().hex}"
    entry = {"transaction": transaction, "tables": {}, "replace": replace or {}}
    for name, df in tables.items():
        if name in hidden:
            if private is None:
                raise ValueError("hidden tables need a private folder")
            df.write.mode("overwrite").parquet(f"{private}/{transaction}/{name}")
        else:
            df.write.parquet(f"{root}/{place}/{name}")
            entry["tables"][name] = f"{place}/{name}"
    hadoop, fs = _fs(spark, root)
    fs.mkdirs(hadoop.Path(f"{root}/manifest"))
    for _ in range(tries):
        known = _manifests(spark, root)
        if any(m["transaction"] == transaction for m in known):
            return False
        draft = hadoop.Path(f"{root}/manifest/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        if not fs.exists(target := hadoop.Path(f"{root}/manifest/{len(known):012d}.json")) and fs.rename(draft, target):
            return True
        fs.delete(draft, False)
    raise RuntimeError("other writers were first each time")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All published rows of a table; an error if no transaction has any."""
    out = None
    for entry in _manifests(spark, root):
        if name not in entry["tables"]:
            continue
        fresh = spark.read.parquet(f"{root}/{entry['tables'][name]}")
        key = entry["replace"].get(name)
        if out is not None and key:
            out = out.join(fresh.select(key).distinct(), key, "left_anti").select(*out.columns)
        out = fresh if out is None else out.unionByName(fresh, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"nothing is published as {name}")
    return out


def documents(df: DataFrame, key: str) -> DataFrame:
    """One JSON document a row under its key, keys of objects in order: a result to be kept as a document."""
    from ..operators.records import canonical

    return df.select(F.col(key), canonical(F.to_json(F.struct(*[F.col(c) for c in df.columns]))).alias("document"))
