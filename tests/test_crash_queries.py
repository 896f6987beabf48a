"""Every registered query with SQL gives the rows of that SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from crashloom.plans import queries, registry as Q
from crashloom.plans import report_queries  # noqa: F401  registers its queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(Q.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    order = lambda r: tuple((v is None, str(v)) for v in r)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=order)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order) == right


def test_flagship(spark):
    assert queries.flagship(spark, DATA).count() > 0
