"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in plain.itertuples(index=False)), key=repr)


def check(spark, name, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want, got = con.execute(sql).df(), entry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    check(spark, name, SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "file_path", "line", "kind"]
