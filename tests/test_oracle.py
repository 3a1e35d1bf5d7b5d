"""Every query with SQL gives the rows of its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from noisefold import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


def key(row):
    return [(x is None, str(x)) for x in row]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, tiny, con, name):
    df = catalog.queries()[name](spark, tiny)
    cols = sorted(df.columns)
    found = con.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    ours = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=key)
    theirs = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=key)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, tiny, name):
    assert catalog.queries()[name](spark, tiny).count() > 0
