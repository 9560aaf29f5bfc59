"""Every registered core query against its DuckDB text."""

import math

import duckdb
import pytest

from fieldcohort.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, int | float) or hasattr(v, "is_finite"):
        return None if math.isnan(float(v)) else round(float(v), 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_have_rows(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).limit(1).count() == 1


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
