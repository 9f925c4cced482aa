"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from vectrail.plans.queries import QUERIES, SQL

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    out = []
    for r in rows:
        out.append(tuple(float(x) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want, got = plain(cur.fetchall()), plain([tuple(r) for r in df.select(*names).collect()])
    assert len(want) == len(got) > 0
    for a, b in zip(want, got, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=0), (name, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
