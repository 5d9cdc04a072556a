"""The queries against their SQL."""

import glob
import os

import duckdb
import pytest

from attesta.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    rel = con.execute(queries.SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted((tuple(r[cols.index(c)] for c in names) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=str) == want


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))
