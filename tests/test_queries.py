"""Every query with SQL gives the SQL's rows; the others run with a stable schema."""

import duckdb
import pytest

from cellwright.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def flat(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    return v


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = [tuple(flat(r[c]) for c in columns) for r in df.collect()]
    answer = duck.sql(ORACLE_SQL[name])
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert in_order(found) == in_order([tuple(flat(r[k]) for k in at) for r in answer.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
