"""Registered archive queries against their SQL in DuckDB on the smallest tables."""

import decimal
import os
from collections import Counter

import pytest

from archlake import queries as Q
from archlake import queries_store  # noqa: F401 (registers more queries)

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return v.normalize()
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = Q.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(Q.ORACLE[name])
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(norm(r[c]) for c in cols) for r in got.collect()) == Counter(tuple(norm(v[i]) for i in at) for v in want.fetchall())
