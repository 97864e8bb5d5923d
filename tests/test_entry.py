"""The entry module: names, schemas, and that the rest stands without the text operators."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry_module

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def cell(v):
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, dict):
        return str([cell(x) for x in v.values()])
    return str([cell(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_entry_runs(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["year", "n_events"] and got.count() > 0


# queries whose result may be empty on the smallest tables
MAY_BE_EMPTY = {"p3_found", "p3_blocks", "p8_found", "p8_leaks", "p9_found", "p9_repaired", "collapse_dup_lines"}


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_every_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con, sql, wrong = duckdb.connect(), entry_module.oracle_sql(), []
    con.execute("set timezone = 'UTC'")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    for name, q in entry_module.queries().items():
        df = q(spark, DATA)
        rows = df.collect()
        if not rows and name not in MAY_BE_EMPTY:
            wrong.append((name, "empty"))
        if name in sql:
            other = con.execute(sql[name])
            names = [x[0] for x in other.description]
            if sorted(names) != sorted(df.columns) or rows_of(rows, df.columns) != rows_of(other.fetchall(), names):
                wrong.append((name, "not as its SQL"))
    assert not wrong


def test_core_does_not_import_the_text_operators():
    code = "import sys; sys.modules['loomspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_database_scan_on_executors_of_their_own(tmp_path):
    """The database is read by other processes than the driver's; nulls, quotes, line ends and a null key stay."""
    code = f"""
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1024m").config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
rows = [(i, f"name {{i}}") for i in range(50)] + [(50, None), (51, ""), (52, 'a "b", c'), (53, "x\\ny"), (54, "\u00e9" * 99), (None, "no key")]
spark.createDataFrame(rows, "s_suppkey int, s_name string").write.parquet("file://{tmp_path}/supplier.parquet")
got = e.queries()["sql_cursor_scan"](spark, "file://{tmp_path}")
assert got.dtypes == [("s_suppkey", "int"), ("s_name", "string")]
assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
print("same rows", flush=True)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=300)
    assert "same rows" in done.stdout, done.stderr[-3000:]
