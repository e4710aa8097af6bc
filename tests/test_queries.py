"""Each registered query against its SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from dialoom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _sorted(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = df.select(*columns).collect()
    theirs = duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({SQL[name]}) q").fetchall()
    assert _sorted(map(tuple, ours)) == _sorted(theirs)
