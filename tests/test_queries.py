"""Every registered query against its DuckDB text on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from siftmill import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, str):
        return v
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


def rows(data, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    df = plans.QUERIES[name](spark, sf)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in plans.ORACLE_SQL:
        found = duck.execute(plans.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(found.fetchall(), columns)


def test_entry_survives_without_the_training_data_subpackage(tmp_path, sf):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parent.parent
    shutil.copytree(root / "siftmill", tmp_path / "siftmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries())); from pyspark.sql import SparkSession; print(e.queries()['count_by_lang'](SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(), '/root/testdata/sf0.001').count() > 0)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[2:] == ["False", "True"], said.stderr
