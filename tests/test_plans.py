"""Every plan against its SQL on the smallest tables; the entry without the llm folders."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone import plans

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def key(rows, columns):
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(str([plain(r[c]) for c in columns]) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_like_sql(spark, duck, name):
    cursor = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = plans.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert key([r.asDict() for r in df.collect()], sorted(names)) == key([dict(zip(names, r, strict=True)) for r in cursor.fetchall()], sorted(names))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_without_sql(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_other_partitioning_same_rows(spark):
    first = sorted(map(str, plans.QUERIES["hybrid_search"](spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(str, plans.QUERIES["hybrid_search"](spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "point_id", "score", "best_rank", "matched", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_folders(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quillstone"), tmp_path / "quillstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'hybrid_search' in n and not any(k.startswith('op') and k[2].isdigit() for k in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
