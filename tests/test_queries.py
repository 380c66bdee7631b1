"""Every registered query of the engine against its SQL, over whole tables."""

import math

import pytest

import __spark_entry__ as entry
from graphloom.plans import queries

SF = "/root/testdata/sf0.001"


def rounded(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(rounded(r[c]) for c in sorted(df.columns))) for r in df.collect())
    if name not in queries.ORACLES:
        return
    held = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in held.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted(repr(tuple(rounded(r[i]) for i in order)) for r in held.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(queries.QUERIES) >= 60


def test_token_estimate_by_the_function(spark):
    from graphloom.functions.text import estimate_tokens
    from graphloom.plans.views import view

    texts = {r.path: r.text for r in view(spark, SF, "files").collect()}
    assert all(r.tokens == estimate_tokens(texts[r.path]) for r in queries.QUERIES["token_estimate"](spark, SF).collect())
