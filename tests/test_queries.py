"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from designloom.operators import quantiles
from designloom.plans import behaviour, queries

SMALL = "/root/testdata/sf0.001"
#: The quickest of those of numbers, and all that tell what the engine says or refuses.
CHOSEN = ["q_poly", "q_cr", "q_cc", "q_cr_centered", "q_flagship", *(n for n, f in queries.QUERIES.items() if f.__module__ == behaviour.__name__ and n != "q_looked_up_levels")]


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        db.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, tables, name):
    found = queries.QUERIES[name](spark, SMALL)
    names = sorted(found.columns)
    cursor = tables.execute(queries.ORACLE_SQL[name])
    given = [c[0] for c in cursor.description]
    assert sorted(given) == names
    wanted = sorted(repr(tuple(row[given.index(n)] for n in names)) for row in cursor.fetchall())
    got = sorted(repr(tuple(row[n] for n in names)) for row in (r.asDict() for r in found.collect()))
    assert got == wanted


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("settled", [10, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, settled):
    monkeypatch.setattr(quantiles, "SETTLED", settled)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = np.random.default_rng(0)
    draws = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25), rng.integers(0, 3, 500), [-1e300, 1e300]])
    data = spark.createDataFrame([(float(v),) for v in rng.permutation(draws)] + [(None,)], "x double").repartition(5)
    asked = [0, 0.001, 0.1, 1 / 3, 0.5, 0.77, 1]
    assert quantiles.quantiles(data, F.col("x"), asked) == pytest.approx(np.quantile(draws, asked).tolist(), rel=1e-12)
    assert quantiles.quantiles(data, F.col("x"), asked, distinct=True) == pytest.approx(np.quantile(np.unique(draws), asked).tolist(), rel=1e-12)
    assert quantiles.quantiles(data.where("x IS NULL"), F.col("x"), asked) is None
