"""What larger tables met: exploded rows are never broadcast, grids whose last row is short, rasters of several files."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import lineage, metrics, raster, samples
from lodestrata.plans import catalog
from lodestrata.sources import geotiff


def broadcast_parts(df) -> list[str]:
    """The plan below each broadcast."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"[\s:+\-]*", x).group()) for x in lines]
    out = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            out.append("\n".join(lines[i + 1 : end]))
    return out


def test_bootstrap_broadcasts_sites_and_not_draws(spark, monkeypatch):
    sites = spark.range(40).select(F.col("id").alias("site"), F.sin("id").alias("mean_true"), F.cos(F.col("id") * 1.3).alias("mean_pred"))
    frame = metrics.bootstrap_ci(sites, 200)
    assert not [x for x in broadcast_parts(frame) if "Generate" in x or "Range" in x]
    got = frame.first()
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 10)
    shuffled = metrics.bootstrap_ci(sites, 200)
    assert not broadcast_parts(shuffled) and shuffled.first() == pytest.approx(got)
    assert got.n == 200 and -1 < got.lo < got.hi < 1
    assert metrics.bootstrap_ci(sites.limit(0), 200).first().n == 0


def test_means_within_broadcast_no_exploded_spots(spark, monkeypatch):
    r = np.random.default_rng(8)
    at, v = r.integers(-40, 40, (3000, 2)).astype(float), r.standard_normal(3000)
    spots = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-45, 45, (30, 2)))]
    a = spark.createDataFrame(spots, "k int, x double, y double")
    b = spark.createDataFrame([(float(p[0]), float(p[1]), float(q)) for p, q in zip(at, v)] + [(float("nan"), 0.0, 1e9), (0.0, None, 1e9)], "u double, w double, v double")
    want = {}
    for k, x, y in spots:
        near = np.hypot(x - at[:, 0], y - at[:, 1]) <= 17.0
        if near.any():
            want[k] = pytest.approx(v[near].mean())
    # the spots as a written table: the optimizer knows how small they are, and takes them for as small when exploded
    a = lineage.cut(a)
    for rows in (lineage.BROADCAST_ROWS, 0):
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", rows)
        frame = samples.means_within(a, "k", b, ["v"], 17.0, ("x", "y"), ("u", "w"))
        assert not [x for x in broadcast_parts(frame) if "Generate" in x]
        assert {q.k: q.v for q in frame.collect()} == want


#: Rows of the raster of 25 columns: 420 rows of pixels put centres on borders, 21 pixels are a short last row.
SIZES = {
    "box_filter": 321,
    "geotiff_round_trip": 321,
    "median_filter_nearest": 321,
    "nearest_resample": 300,
    "pansharpen_ratio": 321,
    "rasterize_polygons": 321,
}


@pytest.mark.parametrize("name", sorted(SIZES))
def test_rasters_of_other_sizes(spark, tmp_path, name):
    d = duckdb.connect()
    d.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < {SIZES[name]}) TO '{tmp_path}/embeddings.parquet'")
    d.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for t in ("lineitem", "events"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    frame = catalog.QUERIES[name](spark, str(tmp_path))
    got, want = [sorted(map(tuple, x)) for x in (frame.collect(), d.sql(catalog.ORACLES[name]).fetchall())]
    assert got == want


def test_geotiff_of_several_files(spark, tmp_path):
    grid = raster.Header(100.0, 5000.0, 200.0, 5000 / 41, 41, 25)
    px = spark.range(1021).select(F.expr("int(id DIV 25)").alias("r"), F.expr("int(id % 25)").alias("c"), F.expr("IF(id = 700, NULL, id * 0.5D)").alias("v"))
    assert geotiff.write(px, str(tmp_path / "all"), grid, ["v"], tile=8).count() == 23
    got = geotiff.read(spark, str(tmp_path / "all"), ["v"], grid=grid)
    there = {(q.r, q.c): q.v for q in got.collect()}
    # places without a pixel or a value are null; the one place of the last square has no file
    assert len(there) == 41 * 25 - 1
    assert {k: v for k, v in there.items() if v is not None} == {divmod(i, 25): i * 0.5 for i in range(1021) if i != 700}
    with pytest.raises(Exception, match="not on the mosaic's grid"):
        geotiff.read(spark, str(tmp_path / "all"), ["v"], grid=raster.Header(150.0, 5000.0, 200.0, 5000 / 41, 41, 25)).count()


def test_geotiff_tells_nan_from_null(spark, tmp_path):
    grid = raster.Header(0.0, 40.0, 10.0, 10.0, 4, 5)
    odd = "CASE id WHEN 3 THEN NULL WHEN 7 THEN double('NaN') WHEN 8 THEN double('-Infinity') ELSE id * 0.5D END"
    px = spark.range(20).where("id <> 11").select(F.expr("int(id DIV 5)").alias("r"), F.expr("int(id % 5)").alias("c"), F.expr(odd).alias("v"))
    geotiff.write(px, str(tmp_path / "a"), grid, ["v"], tile=4)
    got = {q.r * 5 + q.c: q.v for q in geotiff.read(spark, str(tmp_path / "a"), ["v"], grid=grid).collect()}
    assert math.isnan(got.pop(7)) and got.pop(8) == -math.inf
    assert got == {i: None if i in (3, 11) else i * 0.5 for i in range(20) if i not in (7, 8)}
    for more, why in ((px.limit(1), "a pixel is there twice"), (px.limit(1).withColumns({"r": F.lit(2), "c": F.lit(1), "v": F.lit(geotiff.GAP)}), "stands for no value")):
        with pytest.raises(Exception, match=why):
            geotiff.write(px.unionByName(more), str(tmp_path / "b"), grid, ["v"])


@pytest.mark.parametrize("name", ["background_removal_local", "background_passthrough", "background_removal_global"])
def test_background_formulas_compile(spark, sf, name):
    # a formula that passes 64 KB of generated code fails here, else it runs outside whole-stage code
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = catalog.QUERIES[name](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    d = duckdb.connect()
    d.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    for t in ("embeddings", "events"):
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, rows)) == sorted(d.sql(catalog.ORACLES[name]).fetchall())
