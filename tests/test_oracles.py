"""Every query of the engine proper against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from arborlake.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted(repr([clean(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        got.count()
        return
    expected = duck.execute(sql)
    columns = [c[0] for c in expected.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, expected.fetchall())


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
