"""Every query of the library against its SQL."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tensorloom.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = sql.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(found.columns, found.fetchall())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_corpus_operators(tmp_path, sf_dir, pipeline):
    """The package with both of its corpus folders gone, with and without the pipeline's module."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "tensorloom", tmp_path / "tensorloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        shutil.copy(root / name, tmp_path / name)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
names = set(e.queries())
assert names and set(e.oracle_sql()) <= names and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names)
assert e.entry(spark).count() and e.queries()["dtype_groups"](spark, SF_DIR).count()
""".replace("SF_DIR", repr(sf_dir))
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-3000:]


def test_intermediate_tables_go_when_the_application_ends(tmp_path):
    """Every table below the shared folder is removed at the process's end."""
    root = Path(__file__).resolve().parent.parent
    code = """
from pyspark.sql import SparkSession
from tensorloom import shipping
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", SHARED).getOrCreate()
for _ in range(2):
    spark.range(5).write.parquet(shipping.run_dir(spark) + "/t")
    shipping.clear(spark)
spark.range(5).write.parquet(shipping.run_dir(spark) + "/t")
spark.stop()
""".replace("SHARED", repr(str(tmp_path / "shared")))
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-3000:]
    assert [f for f in os.listdir(tmp_path / "shared") if f.startswith("tensorloom")] == []


def test_component_sets_come_from_every_document(spark, tmp_path):
    """A document of any id counts."""
    rows = [(60, "en", "late"), (61, "en", "src9"), (999999, "en", "src8")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["component_set_check_all"](spark, str(tmp_path)).select("lang", "missing", "covered", "required").collect()]
    assert got == [("en", "src9", True, "late,src8,src9")]
