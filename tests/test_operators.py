"""Hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import coda
from lodestrata.operators import groups, metrics, raster, samples


def one(df):
    return tuple(df.first())


def test_closure_replacement_balance(spark):
    df = spark.createDataFrame([(0.0, 1.0, 3.0, 4.0)], "a double, b double, c double, d double")
    assert one(df.select(*coda.closure(["b", "b", "a"]))) == (0.5, 0.5, 0.0)
    assert one(df.select(*coda.multiplicative_replacement(["a", "b", "c"]))) == pytest.approx((1 / 9, 2 / 9, 6 / 9))
    x = df.select(F.lit(4.0).alias("p"), F.lit(4.0).alias("q"), F.lit(1.0).alias("r"))
    assert one(x.select(coda.group_balance(["p", "q"], ["r"])))[0] == pytest.approx(math.sqrt(2 / 3) * math.log(4))
    assert one(x.select(coda.group_balance(["r"], ["p", "q"])))[0] == pytest.approx(-math.sqrt(2 / 3) * math.log(4))
    assert sum(one(x.select(*coda.clr(["p", "q", "r"])))) == pytest.approx(0)
    with pytest.raises(ValueError):
        coda.balance_of(x, ["p"], ["p"])


def test_center(spark):
    df = spark.createDataFrame([(1.0, 4.0), (4.0, 1.0)], "a double, b double")
    assert one(coda.center(df, ["a", "b"])) == pytest.approx((0.5, 0.5))


def test_distance_is_inclusive(spark):
    sites = spark.createDataFrame([("s", 0.0, 0.0)], "site string, x double, y double")
    bg = spark.createDataFrame([(500.0, 0.0), (500.001, 0.0)], "bx double, by double")
    assert samples.within(sites, bg, 500.0, ("x", "y"), ("bx", "by")).count() == 1


def test_passthrough_is_not_closed(spark):
    df = spark.createDataFrame([("1", "far", "COR", 0.0, 0.0, 2.0, 6.0), ("2", "b", "Background", 9e5, 9e5, 1.0, 1.0)], "serial string, site string, type string, easting double, northing double, a double, b double")
    r = samples.remove_background(df, ["a", "b"], 500.0).first()
    assert (r.a, r.b, r.corrected) == (2.0, 6.0, False)


def test_collapse_keeps_single_rows(spark):
    df = spark.createDataFrame([("1.1", "s", "t", 1.0, 3.0), ("1.2", "s", "t", 3.0, 1.0), ("2.1", "s", "t", 5.0, 5.0)], "serial string, site string, type string, a double, b double")
    out = {r.parent: (r.n, r.a, r.b) for r in samples.collapse_triples(df, ["a", "b"], means=()).collect()}
    assert out[1] == pytest.approx((2, 0.5, 0.5)) and out[2] == (1, 5.0, 5.0)


def test_median_edges(spark):
    px = spark.createDataFrame([(r, c, float(3 * r + c + 1)) for r in range(3) for c in range(3)], "r int, c int, v double")
    grid = raster.Header(0, 3, 1, 1, 3, 3)
    corner = lambda df: df.where("r = 0 AND c = 0").first().v
    assert corner(raster.median_filter(px, ["v"], 3, grid)) == 2.0
    spots = spark.createDataFrame([("s", 0, 0)], "serial string, r int, c int")
    assert raster.window_median_clipped(spots, px, ["v"], 3).first().v == 3.0


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (float("inf"),)], "a double")
    assert df.where(samples.all_finite(["a"])).count() == 1


def test_ranks_bins_classes(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    assert sorted((r.v, r.rank) for r in metrics.value_ranks(df, "v").collect()) == [(1.0, 1.0), (2.0, 2.5), (4.0, 4.0)]
    seven = spark.createDataFrame([(i, float(i)) for i in range(7)], "serial int, y_pred double")
    assert [r.bin for r in metrics.quantile_bins(seven).orderBy("serial").collect()] == [1, 1, 2, 3, 4, 5, 5]
    single = spark.createDataFrame([(1.0, 1.0), (2.0, -1.0)], "y_true double, y_pred double")
    r = metrics.agreement_metrics(single).first()
    assert r.accuracy == 0.5 and r.balanced_acc is None and r.mcc is None


def test_singleton_stratum_trains(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "k int, s string")
    out = {r.k: r.is_test for r in metrics.stratified_split(df, "s", [F.col("k")]).collect()}
    assert out == {1: False, 2: True, 3: False}


def test_sieve(spark):
    cells = [(r, c, 0 if r == 0 else 2 if (r, c) == (2, 2) else 1) for r in range(5) for c in range(5)]
    out = {(r.r, r.c): r.cls for r in raster.sieve(spark.createDataFrame(cells, "r int, c int, cls int"), 2).collect()}
    assert out[2, 2] == 1 and all(out[0, c] == 0 for c in range(5))


def test_upsert(spark):
    old = spark.createDataFrame([("m", "e", 1.0), ("n", "e", 2.0)], "model string, eval string, r2 double")
    new = spark.createDataFrame([("m", "e", 3.0, 0.5)], "model string, eval string, r2 double, auc double")
    assert sorted((r.model, r.r2, r.auc) for r in samples.upsert(old, new, ["model", "eval"]).collect()) == [("m", 3.0, 0.5), ("n", 2.0, None)]
    assert samples.upsert(None, new, ["model"]).count() == 1


def test_tree_and_variances(spark):
    r = np.random.default_rng(1)
    x = np.exp(r.standard_normal((200, 4)))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    parts = list("abcd")
    t = groups.matrix_of(groups.variation_matrix(df, parts).collect(), parts)
    signs = groups.partition_signs(groups.ward(np.sqrt(t)))
    balances = groups.principal_balances(df, parts, signs).collect()
    clr = np.log(x) - np.log(x).mean(1, keepdims=True)
    assert sum(b.variance for b in balances) == pytest.approx(clr.var(0, ddof=1).sum())


def test_utm_round_trip():
    e, n = raster.utm_from_lonlat(np.array([55.3]), np.array([23.1]), "EPSG:32640")
    lon, lat = raster.lonlat_from_utm(e, n, "EPSG:32640")
    assert (lon[0], lat[0]) == pytest.approx((55.3, 23.1), abs=1e-9)
    assert raster.utm_from_lonlat(np.array([57.0]), np.array([0.0]), "EPSG:32640")[0][0] == pytest.approx(500000)


def test_entry_without_corpus_columns(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
