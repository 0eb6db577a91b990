"""Queries do the whole job: no fixed subset, no result that has not settled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import coda
from lodestrata.operators import groups, learning, raster
from lodestrata.plans import catalog

LARGER = "/root/testdata/sf0.1"


def test_silhouette_of_every_pixel(spark):
    r = np.random.default_rng(4)
    x, c = r.standard_normal((90, 2)), r.integers(0, 3, 90)
    df = spark.createDataFrame([(i, int(c[i]), float(x[i, 0]), float(x[i, 1])) for i in range(90)], "k int, c int, u double, v double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    own = np.array([d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1) for i in range(90)])
    other = np.array([min(d[i, c == k].mean() for k in range(3) if k != c[i]) for i in range(90)])
    s = (other - own) / np.maximum(own, other)
    for block in (20, 2000):
        got = {r.cls: (r.silhouette, r.n) for r in learning.silhouette(df, ["u", "v"], "c", "k", block).collect()}
        assert got == {k: (pytest.approx(s[c == k].mean()), (c == k).sum()) for k in range(3)}
    every = spark.read.parquet(f"{LARGER}/embeddings.parquet").count()
    assert sum(r.n for r in catalog.QUERIES["silhouette_exact"](spark, LARGER).collect()) == every


def site_by_site(df, features, fit_target):
    """The plain way: a fit for each site."""
    out = None
    for s in sorted(r[0] for r in df.select("site").distinct().collect()):
        train, held = df.where(F.col("site") != s), df.where(F.col("site") == s)
        num, den = fit_target(train)
        balance = coda.group_balance(num, den)
        w, b = learning.ridge(train.withColumn("y_true", balance), features, "y_true", 1.0)
        rows = held.withColumns({"y_true": balance, "y_pred": learning.linear(features, w, b), "markers": F.lit(",".join(sorted(num)))}).select("site", "y_true", "y_pred", "markers")
        out = rows if out is None else out.unionByName(rows)
    return out


def test_leave_site_out_of_every_site(spark, sf):
    df, near = catalog.fixed(spark, sf).where("site IN ('1', '2', '3')"), ["easting", "northing"]

    def split(found):
        return found["markers"] or ["p"], found["background"]

    rows = lambda out: sorted((r.site, r.markers, r.y_true, r.y_pred) for r in out.collect())
    got = rows(learning.leave_site_out(df, catalog.X, near, "site", lambda t: split(groups.groups_from_variation(t, catalog.X, 0.95))))
    want = rows(site_by_site(df, near, lambda train: split(groups.compositional_groups(train, catalog.X, 0.95))))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want], rtol=0, atol=1e-7)
    every = {r.site: r.n for r in catalog.QUERIES["strict_leave_site_out"](spark, sf).collect()}
    assert every == {r.site: r["count"] for r in df.sparkSession.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").count().selectExpr("CAST(l_suppkey AS STRING) AS site", "count").collect()}


def test_regions_settle(spark):
    arm = 120
    cells = [(r, c, 1) for r in range(arm) for c in (0, 2)] + [(arm, c, 1) for c in range(3)] + [(r, 1, 2) for r in range(arm)]
    got = raster.connected(spark.createDataFrame(cells, "r int, c int, cls int")).groupBy("cls").agg(F.min("blob"), F.max("blob"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {(1, 0, 0, 2 * arm + 3), (2, 1, 1, arm)}
    with pytest.raises(RuntimeError):
        raster.connected(spark.createDataFrame(cells, "r int, c int, cls int"), rounds=2)


def test_mape_of_every_pair(spark):
    pairs = spark.read.parquet(f"{LARGER}/events.parquet").select("event_id", "value").toPandas()
    true = np.log(pairs.value.where(pairs.value > 0) / 50)
    guess = true * 0.5 + ((pairs.event_id * 7919) % 1000) / 500.0 - 1
    want = np.log((np.abs(guess - true) / np.maximum(np.abs(true), np.finfo(float).eps)).mean())
    assert catalog.QUERIES["mape_all_rows"](spark, LARGER).first().ln_mape == pytest.approx(want, rel=1e-6)
