"""Every registered query against its SQL on the smallest tables; those without SQL run and keep their grain."""

import os

import duckdb
import pytest

from planforge.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())


@pytest.fixture(scope="module")
def few_trees():
    """The registered queries with few trees: what they are made of is tested in test_boosting.py and test_operators.py."""
    from dataclasses import replace

    from planforge.plans import scores as SC

    patch = pytest.MonkeyPatch()
    for name in ("DEMAND", "DEMAND_LEAVES", "YIELD", "FAILURE"):
        patch.setattr(SC, name, replace(getattr(SC, name), trees=10, depth=3, rate=0.3))
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir, few_trees):
    df = QUERIES[name](spark, sf_dir)
    site = {"m7_adjusted_capacity": 5}.get(name)  # a read of one site is empty where no supplier is there
    present = site is None or spark.read.parquet(f"{sf_dir}/supplier.parquet").where(f"s_nationkey = {site}").count() > 0
    assert (df.count() > 0) == present
    key = {"l11_attributions": ["feat_pk", "rank"], **dict.fromkeys(("l3_demand_regressors", "l7_ensemble", "m10_demand_forecast"), ["site_code", "product_family", "month_key"]), **dict.fromkeys(("l13_failure_model", "l14_risk_alerts", "l16_isolation_forest"), ["site_code", "test_type", "month_key"])}.get(name, ["feat_pk"])
    if set(key) <= set(df.columns):
        assert df.groupBy(*key).count().where("count > 1").count() == 0


def test_entry_without_optional_operators():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
