import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests.conftest import ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(df):
    def cell(v):
        return None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, str) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry_module.oracle_sql() if not (n.startswith("op") and n[2:3].isdigit())))
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry_module.queries()[name](spark, "/root/testdata/sf0.01").toPandas(), duck.sql(entry_module.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)


def test_the_registry_is_read_without_a_session():
    """The check tool lists the queries before it starts Spark."""
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    assert entry_module.entry(spark).count() == 4


def test_the_rest_stands_without_the_corpus_package(tmp_path):
    """Without the llm folders and the pipeline the entry still imports, lists its other queries and runs one; the oracle SQL has no others."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = """import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2:3].isdigit()] and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
assert q['mutual_nn_ratio'](spark, '/root/testdata/sf0.001').count() == 100 and q['set_summary'](spark, '/root/testdata/sf0.001').count() == 5"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
