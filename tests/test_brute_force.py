"""What SQL can't say, against plain NumPy on small inputs; guards; ranks over many buckets."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import indices
from lodestrata.operators import groups, learning, metrics, raster, samples
from lodestrata.sources import readers, writers
from lodestrata.streaming.microbatch import each_batch

MANY = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many(spark):
    """A session that keeps its 37 range buckets."""
    before = {k: spark.conf.get(k) for k in MANY}
    for k, v in MANY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranks_over_many_buckets(many):
    n = 300_000
    df = many.range(n).select(F.col("id").alias("serial"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 7.0).alias("y_pred"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("y_true", F.when(F.col("id") % 4 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))) if "id" in df.columns else df.withColumn("y_true", F.when(F.col("serial") % 4 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    ranked = metrics.row_ranks(df, [F.col("y_pred"), F.col("serial")])
    assert tuple(ranked.agg(F.count("*"), F.countDistinct("rn"), F.min("rn"), F.max("rn"), F.max("n")).first()) == (n, n, 1, n, n)
    bins = [r["count"] for r in metrics.quantile_bins(df).groupBy("bin").count().orderBy("bin").collect()]
    assert sum(bins) == n and max(bins) - min(bins) <= 1
    inside = metrics.row_ranks(df, [F.col("y_pred"), F.col("serial")], ["g"]).groupBy("g").agg(F.countDistinct("rn").alias("d"), F.max("rn").alias("top"), F.max("n").alias("n"))
    assert {(r.d, r.top, r.n) for r in inside.collect()} == {(n // 3, n // 3, n // 3)}
    ranks = metrics.value_ranks(df, "y_pred").toPandas().set_index("y_pred")["rank"]
    held = df.select("y_pred").toPandas()["y_pred"]
    assert np.allclose(ranks.loc[np.sort(held.unique())], held.rank().groupby(held).first().sort_index())
    got = metrics.top_fraction(df, F.col("y_true") > 0).first()
    whole = df.toPandas().sort_values(["y_pred", "serial"], ascending=[False, True])
    assert got.k == n // 5 and got.hit == pytest.approx((whole.y_true.head(n // 5) > 0).mean()) and got.base == pytest.approx(0.25)


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, g string")
    assert sorted((r.k, r.rn, r.n) for r in metrics.row_ranks(df, [F.col("k")], ["g"]).collect()) == [(1, 1, 2), (2, 2, 2), (3, 1, 1)]
    assert metrics.row_ranks(df.limit(0), [F.col("k")]).count() == 0


def _regions(mask, eight):
    seen, out = {}, {}
    moves = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for spot in sorted(mask):
        if spot in seen:
            continue
        todo, own = [spot], []
        seen[spot] = spot
        while todo:
            at = todo.pop()
            own.append(at)
            for m in moves:
                near = at[0] + m[0], at[1] + m[1]
                if near in mask and near not in seen and mask[near] == mask[at]:
                    seen[near] = spot
                    todo.append(near)
        out[spot] = own
    return seen, out, moves


def _brute_sieve(cells, least, eight):
    mask = {(r, c): k for r, c, k in cells if k}
    label, regions, moves = _regions(mask, eight)
    new = dict(mask)
    for first, own in regions.items():
        if len(own) < least:
            near = {label[p] for r, c in own for dr, dc in moves if (p := (r + dr, c + dc)) in mask and label[p] != first}
            if near:
                best = max(near, key=lambda x: (len(regions[x]), (-x[0], -x[1])))
                new.update(dict.fromkeys(own, mask[best]))
    return {(r, c): new.get((r, c), k) for r, c, k in cells}


@pytest.mark.parametrize(("eight", "row0", "shape"), [(False, 0, (14, 14)), (True, 5_000_000, (12, 15)), (False, 2_000_000, (4, 60))])
def test_sieve_on_random_masks(spark, eight, row0, shape):
    r = np.random.default_rng(shape[1])
    cells = [(row0 + i, j, int(r.choice([0, 1, 1, 2, 2, 3]))) for i in range(shape[0]) for j in range(shape[1])]
    got = raster.sieve(spark.createDataFrame(cells, "r int, c int, cls int"), 4, 8 if eight else 4)
    assert {(x.r, x.c): x.cls for x in got.collect()} == _brute_sieve(cells, 4, eight)


def test_wide_mask_does_not_overflow(spark):
    wide = spark.range(2 * 4000).select(F.expr("CAST(3000000 + id DIV 4000 AS INT)").alias("r"), F.expr("CAST(id % 4000 AS INT)").alias("c"), F.lit(1).alias("cls"))
    blobs = raster.connected(wide).groupBy("blob").count().collect()
    assert [b["count"] for b in blobs] == [8000]


@pytest.mark.parametrize(("size", "tile"), [(3, 4), (4, 5), (11, 7)])
def test_median_by_tiles(spark, size, tile):
    r = np.random.default_rng(size)
    h, w = 13, 17
    x = r.standard_normal((h, w))
    x[3, 4], x[0, 0] = np.nan, np.nan
    px = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(h) for j in range(w)], "r int, c int, v double")
    got = {(q.r, q.c): q.v for q in raster.median_filter(px, ["v"], size, raster.Header(0, 0, 1, 1, h, w), tile).collect()}
    lo, hi = -(size // 2), size - 1 - size // 2
    for i, j in itertools.product(range(h), range(w)):
        rows, cols = np.clip(range(i + lo, i + hi + 1), 0, h - 1), np.clip(range(j + lo, j + hi + 1), 0, w - 1)
        assert got[i, j] == pytest.approx(np.nanmedian(x[np.ix_(rows, cols)]))
    assert len(got) == h * w


def test_means_within_by_cells(spark):
    r = np.random.default_rng(2)
    spots = [(f"s{k}", float(a), float(b)) for k, (a, b) in enumerate(r.uniform(-50, 1050, (25, 2)))] + [("far", 1e6, 1e6), ("edge", 0.0, 0.0)]
    points = [(float(a), float(b), float(v)) for a, b, v in np.column_stack([r.uniform(0, 1000, (4000, 2)), r.standard_normal(4000)])] + [(100.0, 0.0, 7.0), (0.0, 100.0, 9.0), (100.0001, 0.0, 1e9)]
    a, b = spark.createDataFrame(spots, "k string, x double, y double"), spark.createDataFrame(points, "u double, w double, v double")
    for split in (1, 8):
        got = {q.k: q.v for q in samples.means_within(a, "k", b, ["v"], 100.0, ("x", "y"), ("u", "w"), split).collect()}
        want = {k: [v for u, w, v in points if math.hypot(u - x, w - y) <= 100.0] for k, x, y in spots}
        assert set(got) == {k for k, v in want.items() if v} and all(got[k] == pytest.approx(np.mean(want[k])) for k in got)


def _brute_ward(x):
    """Merges of the pair that raises the squared error least, on the coordinates themselves."""
    sse = lambda own: ((x[own] - x[own].mean(0)) ** 2).sum()
    held, out = [[i] for i in range(len(x))], []
    while len(held) > 1:
        a, b = min(itertools.combinations(range(len(held)), 2), key=lambda p: sse(held[p[0]] + held[p[1]]) - sse(held[p[0]]) - sse(held[p[1]]))
        out.append((frozenset(held[a]), frozenset(held[b]), math.sqrt(2 * (sse(held[a] + held[b]) - sse(held[a]) - sse(held[b])))))
        held = [h for k, h in enumerate(held) if k not in (a, b)] + [held[a] + held[b]]
    return out


def test_ward_tree_and_signs():
    r = np.random.default_rng(8)
    for n in (2, 5, 9):
        x = r.standard_normal((n, 4))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        tree, members = groups.ward(d), [frozenset([i]) for i in range(n)]
        for (a, b, h, size), (left, right, height) in zip(tree, _brute_ward(x)):
            own = members[int(a)], members[int(b)]
            assert set(own) == {left, right} and h == pytest.approx(height) and size == len(own[0] | own[1])
            members.append(own[0] | own[1])
        signs = groups.partition_signs(tree)
        assert signs.shape == (n - 1, n) and (signs[0] != 0).all()
        # each row splits what one side of an earlier row holds, and rows are orthogonal as balances
        ilr = np.array([[math.sqrt(q / (p * (p + q))) if v > 0 else -math.sqrt(p / (q * (p + q))) if v < 0 else 0 for v in row] for row in signs for p, q in [((row > 0).sum(), (row < 0).sum())]])
        assert np.allclose(ilr @ ilr.T, np.eye(n - 1))
        assert [len(t[1].split(",")) + len(t[2].split(",")) for t in groups.merge_table(tree, [str(i) for i in range(n)])] == [int(v) for v in tree[:, 3]]


def _leading_variance(x, frac):
    logs = np.log(x)
    t = np.array([[np.var(logs[:, i] - logs[:, j], ddof=1) for j in range(x.shape[1])] for i in range(x.shape[1])])
    signs = groups.groups_from_variation(t, list("abcd"), frac)["signs"]
    return max(np.var(math.sqrt(p * q / (p + q)) * (logs[:, row > 0].mean(1) - logs[:, row < 0].mean(1)), ddof=1) for row in signs for p, q in [((row > 0).sum(), (row < 0).sum())])


def test_subset_search(spark):
    r = np.random.default_rng(3)
    x = np.exp(r.standard_normal((60, 4)) * [1, 0.5, 0.7, 2] + 1000.0 * 0)
    site = [f"s{k % 5}" for k in range(60)]
    df = spark.createDataFrame([(s, *map(float, v)) for s, v in zip(site, x)], "site string, a double, b double, c double, d double")
    names, at = sorted(set(site)), np.array(site)
    score = lambda own: _leading_variance(x[np.isin(at, own)], 0.95)
    want = sorted(((score(c), c) for k in (2, 3) for c in itertools.combinations(names, k)), key=lambda p: -p[0])[:4]
    got = groups.search_subsets(df, list("abcd"), names, 2, 3, 4, color_frac=0.95)
    assert [c for _, c in got] == [c for _, c in want] and np.allclose([v for v, _ in got], [v for v, _ in want])
    chosen = ()
    for _ in range(3):
        chosen = max(((*chosen, s) for s in names if s not in chosen), key=score)
    assert chosen in [c for _, c in groups.search_subsets(df, list("abcd"), names, 1, 3, greedy=True, color_frac=0.95)]
    with pytest.raises(ValueError):
        groups.search_subsets(df, list("abcd"), names, 1, 3, max_combos=3)


def test_variance_of_large_means(spark):
    df = spark.createDataFrame([("s", math.exp(v), math.exp(-300.0)) for v in (300.0, 300.0001, 300.0002)] , "site string, a double, b double")
    subsets = spark.createDataFrame([(1, "s")], "subset_id int, site string")
    assert groups.subset_scores(df, subsets, ["a", "b"], ["a"], ["b"]).first().score == pytest.approx(0.5 * 1e-8, rel=1e-3)


def test_two_populations(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(-2, 0.5, 400), r.normal(1.5, 0.8, 600)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "v double")
    got = groups.population_split(df, "v", polish=60, tolerance=1e-12)
    m, s, w = np.array([-1.0, 1.0]), np.array([1.0, 1.0]), np.array([0.5, 0.5])
    for _ in range(3000):
        d = np.stack([w[k] * np.exp(-((x - m[k]) ** 2) / (2 * s[k])) / np.sqrt(2 * np.pi * s[k]) for k in (0, 1)])
        q = d / d.sum(0)
        w, m = q.mean(1), (q * x).sum(1) / q.sum(1)
        s = np.array([(q[k] * (x - m[k]) ** 2).sum() / q[k].sum() for k in (0, 1)]) + 1e-6
    assert got["bimodal"] and np.allclose(got["means"], m, atol=1e-3) and np.allclose(got["weights"], w, atol=1e-3)
    assert got["bic2"] == pytest.approx(5 * math.log(1000) - 2 * np.log(d.sum(0)).sum(), abs=1e-2)
    assert got["n_low"] + got["n_high"] == 1000
    one = groups.population_split(spark.createDataFrame([(float(v),) for v in r.normal(0, 1, 400)], "v double"), "v")
    assert not one["bimodal"]
    assert groups.resolve_threshold("antimode", got) == got["threshold"] and groups.resolve_threshold("antimode", one) == 0.0
    assert groups.resolve_threshold(0.25) == 0.25
    with pytest.raises(ValueError):
        groups.resolve_threshold("median")


def test_components_of_standardised_features(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((80, 3)) @ np.array([[2, 1, 0], [0, 1, 0.3], [0, 0, 0.5]])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    out, shares = learning.principal_components(df, list("abc"))
    z = (x - x.mean(0)) / x.std(0)
    value, vector = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(-value)
    assert np.allclose(shares, (value / value.sum())[order][:2])
    got = np.array([q.pc for q in out.orderBy("a").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vector[:, order[:2]])[np.argsort(x[:, 0])])


def test_importance_and_search(spark):
    r = np.random.default_rng(7)
    x = r.standard_normal((300, 3))
    y = 3 * x[:, 0] + 0.5 * x[:, 1]
    df = spark.createDataFrame([(*map(float, v), float(t), k % 3) for k, (v, t) in enumerate(zip(x, y))], "a double, b double, c double, y double, fold int")
    model = learning.ridge_model(list("abc"), "y", 0.0)(df)
    out = {q.feature: (q.mean, q.std) for q in learning.permutation_importance(df, model, list("abc"), "y", 8).collect()}
    # a shuffled feature of weight w costs twice its share of the variance
    for f, w, k in (("a", 3, 0), ("b", 0.5, 1)):
        assert out[f][0] == pytest.approx(2 * w * w * x[:, k].var() / y.var(), rel=0.35)
    assert abs(out["c"][0]) < 1e-6 and list(out)[0] == "a"
    table = spark.createDataFrame([(f"f{k}", float(k), 0.0) for k in range(-3, 40)], "feature string, mean double, std double")
    assert learning.keep_features(table, 0.25) == [f"f{k}" for k in range(39, 29, -1)]
    best, value = learning.random_search(df, {"alpha": [0.0, 1e6]}, lambda alpha: learning.ridge_model(list("abc"), "y", alpha), lambda p: learning.mean_fold_r2(p, "y"), 8)
    assert best == {"alpha": 0.0} and value == pytest.approx(1.0)
    rounds, each = learning.boosted_rounds(df, list("abc"), "y", "fold", 6, maxDepth=2)
    assert len(each) == 3 and rounds == max(1, int(np.median(each) * 1.1))
    out = learning.out_of_fold(df, learning.boosted(list("abc"), "y", maxIter=8, maxDepth=3))
    assert out.count() == 300 and learning.mean_fold_r2(out, "y") > 0.7


def test_classifier(spark):
    r = np.random.default_rng(9)
    x, c = r.standard_normal((240, 2)), np.arange(240) % 2
    x[:, 0] += 4 * c
    df = spark.createDataFrame([(*map(float, v), int(k), i % 3) for i, (v, k) in enumerate(zip(x, c))], "a double, b double, cls int, fold int")
    setting, value = learning.search_classifier(df, ["a", "b"], "cls", "fold", {"numTrees": [3, 6], "maxDepth": [2, 3]}, 3)
    assert value > 0.9 and set(setting) == {"numTrees", "maxDepth"}
    same = df.withColumn("prediction", F.col("cls").cast("double"))
    assert learning.weighted_f1(same, "cls") == 1.0


def test_outliers_of_each_class(spark):
    r = np.random.default_rng(10)
    rows = [(int(k), *map(float, v)) for k in (0, 1) for v in r.standard_normal((200, 2)) + 10 * k] + [(0, 30.0, 30.0), (1, -30.0, 30.0)] + [(2, 1.0, 1.0)] * 5 + [(None, 0.0, 0.0)]
    out = learning.mark_outliers(spark.createDataFrame(rows, "cls int, a double, b double"), ["a", "b"], "cls", 0.05).toPandas()
    assert len(out) == len(rows) and Counter(out[out.is_outlier].cls) == {0.0: 10, 1.0: 10}
    assert out[(out.a.abs() == 30)].is_outlier.all()


def test_leave_site_out_falls_back(spark):
    r = np.random.default_rng(11)
    rows = [(f"s{k % 4}", *map(float, np.exp(r.standard_normal(3))), float(r.standard_normal())) for k in range(80)]
    df = spark.createDataFrame(rows, "site string, a double, b double, c double, f double")
    calls = []

    def target(t):
        if len(calls) == 0 and t[0, 1] > 0:
            calls.append(1)  # the derivation from all rows
            return ["a"], ["b", "c"]
        raise ValueError("no cluster")

    out = learning.leave_site_out(df, ["a", "b", "c"], ["f"], "site", target)
    folds = out.select("site", "markers", "fallback").distinct()
    assert {(q.markers, q.fallback) for q in folds.collect()} <= {("a", True), ("a", False)} and folds.count() == 4
    assert tuple(learning.marker_stability(folds, ["a"]).first())[:2] == (4, 4)


def test_folds_of_groups(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 5), ("b", 4), ("c", 3), ("d", 3)) for _ in range(n)] + [("e",)], "g string")
    sizes = Counter(q.fold for q in metrics.with_folds(df, "g", 2).select("g", "fold").distinct().collect())
    assert sum(sizes.values()) == 5 and set(sizes) == {0, 1}
    assert sorted((q.g, q.fold) for q in metrics.with_folds(df, "g").select("g", "fold").distinct().collect()) == [(g, i) for i, g in enumerate("abcde")]
    xy = spark.createDataFrame([(float(10 * (k % 3)), float(k % 2) / 10) for k in range(30)], "x double, y double")
    assert learning.block_groups(xy, "x", "y", 3).select("block").distinct().count() == 3


def test_warp_between_zones(spark):
    # a plane over the source's own coordinates is read back at the target's pixel centres
    source = raster.Header(300_000.0, 2_600_000.0, 1000.0, 1000.0, 40, 40, "EPSG:32640")
    px = spark.createDataFrame([(i, j, 2 * (300_000 + (j + 0.5) * 1000) - 3 * (2_600_000 - (i + 0.5) * 1000)) for i in range(40) for j in range(40)], "r int, c int, v double")
    lon, lat = raster.lonlat_from_utm(np.array([320_000.0]), np.array([2_580_000.0]), "EPSG:32640")
    east, north = raster.utm_from_lonlat(lon, lat, "EPSG:32639")
    target = raster.Header(float(east[0]), float(north[0]), 500.0, 500.0, 6, 5, "EPSG:32639")
    got = raster.warp_bilinear(px, ["v"], source, target).collect()
    assert len(got) == 30
    for q in got:
        lon, lat = raster.lonlat_from_utm(np.array([target.x0 + (q.c + 0.5) * 500]), np.array([target.y0 - (q.r + 0.5) * 500]), "EPSG:32639")
        x, y = raster.utm_from_lonlat(lon, lat, "EPSG:32640")
        assert q.v == pytest.approx(2 * x[0] - 3 * y[0], abs=1e-3)
    rings = spark.createDataFrame([(1, 7, [(300_000.0, 2_600_000.0), (301_000.0, 2_600_000.0), (301_000.0, 2_599_000.0)])], "id int, label int, ring array<struct<x: double, y: double>>")
    there = raster.reproject_polygons(rings, "EPSG:32640", "EPSG:32639")
    back = raster.reproject_polygons(there, "EPSG:32639", "EPSG:32640").first()
    assert back.label == 7 and [(round(p.x, 3), round(p.y, 3)) for p in back.ring] == [(300_000.0, 2_600_000.0), (301_000.0, 2_600_000.0), (301_000.0, 2_599_000.0)]


def test_guards(spark):
    df = spark.createDataFrame([("1", 1.0, 0.0), ("1", 2.0, 3.0)], "serial string, a double, b double")
    grid = raster.Header(0, 1, 1, 1, 1, 1)
    for broken in (
        lambda: samples.require_unique(df, "serial"), lambda: samples.require_positive(df, ["a", "b"]), lambda: samples.require_rows(df, 3, "samples"),
        lambda: samples.require_columns(df, ["geometry"], "samples"), lambda: grid.require_crs("EPSG:32639"),
        lambda: raster.to_pixels(df.select(F.lit(9.0).alias("easting"), F.lit(9.0).alias("northing")), grid, require=True),
        lambda: samples.align(df.select("a"), df.select("b")),
    ):
        with pytest.raises(ValueError):
            broken()
    assert samples.require_rows(df, 2, "samples") is df and samples.require_columns(df, ["a"], "samples") is df
    with pytest.raises(Exception, match="class without a mapping"):
        df.select(samples.remap(F.col("a").cast("int"), {1: 2})).collect()


def test_gating_and_names(spark):
    px = spark.createDataFrame([(0.1, 0.2, 0.3)], "a double, b double, c double")
    assert indices.with_indices(px, "unknown").columns == px.columns
    assert indices.with_indices(px, "maxar_x").columns == px.columns  # its bands are missing
    named = indices.prefixed(px, "Emb_", ["a", "b"])
    assert named.columns == ["Emb_a", "Emb_b", "c"] and samples.feature_columns(named, ["Emb_"]) == ["Emb_a", "Emb_b"]


def test_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "flat.json").write_text('{"eo:bands": [{"name": "x", "common_name": "red"}]}')
    assert readers.band_names(spark, at("broken.json"), 2) == ["Band_1", "Band_2"]
    assert readers.band_names(spark, at("none.json"), 1, (at("flat.json"),)) == ["x"] and readers.band_index(spark, at("flat.json")) == {"red": 0}
    (tmp_path / "empty.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.band_index(spark, at("empty.json"))
    ring = '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"label": 3}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}'
    (tmp_path / "polygons.json").write_text(ring)
    row = readers.geojson(spark, at("polygons.json")).first()
    assert row.label == 3 and [(p.x, p.y) for p in row.ring] == [(0, 0), (1, 0), (1, 1)]
    px = spark.createDataFrame([(0, 0, 1.5), (3, 1, 2.5)], "r int, c int, v double")
    writers.tiles(px, at("tiles"), 2)
    assert sorted(map(tuple, readers.pixels(spark, at("tiles"), ["v"]).collect())) == [(0, 0, 1.5), (3, 1, 2.5)]


def test_stream_of_samples(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(f"s{k}", float(k + 1)), (f"s{k}", float(k + 3))], "site string, v double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("site string, v double").option("maxFilesPerTrigger", 1).parquet(source)
    query = each_batch(stream, lambda b: b.groupBy("site").agg(F.avg("v").alias("v")), out, str(tmp_path / "marks"))
    query.awaitTermination(120)
    assert sorted((r.site, r.v) for r in spark.read.parquet(out).collect()) == [("s0", 2.0), ("s1", 3.0)]
