"""Every named query against its SQL on the smallest tables, and rows for those that have none."""

import decimal
import math
import os

import pytest

from quillon.registry import COVERS, ORACLES, QUERIES

DIR = os.environ.get("QUILLON_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the synthetic tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert COVERS[name]
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    want = sorted(([plain(r[names.index(c)]) for c in columns] for r in rel.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    if DIR == "/root/testdata/sf0.001":
        assert entry.entry(spark).columns == ["user_id", "interval", "id_0", "id_1", "score"]
