"""Every query runs; those with SQL give what DuckDB gives."""

import duckdb
import pytest

from lodestrata.plans.catalog import ORACLES, QUERIES

SLOW = {"gbt_oof", "permutation_importance", "strict_leave_site_out", "sieve", "marker_stability", "regressor_search", "classifier_search", "boosting_rounds"}  # their operators have tests of their own


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple("NULL" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
