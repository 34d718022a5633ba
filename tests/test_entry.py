import glob
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def shown(value):
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(shown, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(shown(v) for v in value.values()) + "}"
    return str(value)


def rows(table):
    if hasattr(table, "read_all"):
        table = table.read_all()
    names = sorted(table.column_names)
    return names, sorted(tuple(shown(r[c]) for c in names) for r in table.to_pylist())


def core():
    from quillspark.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", core())
def test_query(spark, oracle, name):
    from quillspark.plans import registry

    found = rows(registry.queries()[name](spark, SF).toArrow())
    if name in registry.oracle_sql():
        assert found == rows(oracle.sql(registry.oracle_sql()[name]).arrow())
    else:
        assert found[0]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_the_core_stands_without_llm(tmp_path):
    """The entry and every core test module import, and no core query is lost, where ``llm`` can't be imported."""
    import subprocess
    import sys

    code = """
import importlib.abc, sys

class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith(("quillspark.llm", "tests.llm")):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Gone())
import glob, importlib, os
import __spark_entry__ as e
from quillspark.plans import registry
assert set(e.queries()) == set(registry.queries()) and set(e.oracle_sql()) == set(registry.oracle_sql())
for f in glob.glob("tests/test_*.py"):
    importlib.import_module("tests." + os.path.basename(f)[:-3])
    assert "quillspark.llm" not in open(f).read().replace('"quillspark.llm', "")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
