"""Every registered query against its SQL twin, on the smallest data."""

import duckdb
import pytest

from gleaner.plans import catalog, files, oracle

QUERIES, ORACLE = catalog.QUERIES | files.QUERIES, oracle.ORACLE | files.ORACLE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(records, order):
    said = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(said(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    got = rows(df.collect(), [df.columns.index(c) for c in names])
    assert got == rows(result.fetchall(), [columns.index(c) for c in names])


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


def test_plans(spark, sf_dir):
    """Filters and columns reach the scan, the best are taken without a full sort."""
    plan = QUERIES["retrieve_dated"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "l_extendedprice" not in plan and "CartesianProduct" not in plan
