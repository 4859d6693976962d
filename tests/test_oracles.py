"""Every registered query against its SQL in DuckDB, on the tables of the correctness check."""

import math
import os

import duckdb
import pytest

from specseq.plans import catalogue

FOLDERS = ["/root/testdata/sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=FOLDERS, ids=["sf0.01"])
def tables(request):
    con, folder = duckdb.connect(), request.param
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        con.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return folder, con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0  # -0.0 is 0.0
        return list(v) if hasattr(v, "__iter__") and not isinstance(v, (str, bytes)) else v

    return sorted((tuple(repr(value(r[i])) for i in order) for r in rows))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, tables, name):
    folder, duck = tables
    got = catalogue.QUERIES[name](spark, folder)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_all_are_registered():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
