"""Every named query against its SQL on the smallest tables."""

import duckdb
import pytest

from sylvan.oracles import SQL
from sylvan.queries import QUERIES

#: Every query with SQL.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL_ENOUGH = [n for n in QUERIES if n in SQL]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    flat = lambda v: None if v is None else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(flat(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", SMALL_ENOUGH)
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    want = con.execute(SQL[name])
    assert sorted(got.columns) == sorted(d[0] for d in want.description)
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
