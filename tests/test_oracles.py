"""Every query that has SQL returns the same rows as DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from skeinlake.plans.catalog import all_queries

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (int(x) if x.is_integer() else x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(all_queries()[1]))
def test_same_rows(spark, con, name):
    queries, oracles = all_queries()
    got = queries[name](spark, FOLDER)
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(got.columns) == sorted(names)
    mine = rows_of(got.columns, got.collect())
    assert len(mine) == len(want)
    assert mine == want


@pytest.mark.parametrize("name", sorted(set(all_queries()[0]) - set(all_queries()[1])))
def test_runs_without_sql(spark, name):
    got = all_queries()[0][name](spark, FOLDER)
    assert len(got.columns) == len(set(got.columns))
    got.count()
