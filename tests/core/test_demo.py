"""Each demonstration query against its SQL, over whole tables."""

import duckdb
import pytest

from quern.plans import demo

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _sorted(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(demo.SQL))
def test_against_sql(spark, duck, name):
    got = demo.QUERIES[name](spark, SF)
    want = duck.sql(demo.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert _sorted(tuple(r) for r in got.select(*columns).collect()) == _sorted(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["flow_type", "rule_id", "n", "users"]
    assert set(e.oracle_sql()) <= set(e.queries())
