"""All reference-side queries by name, each with the SQL that DuckDB answers in the same way."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coda, indices, text
from ..operators import groups, learning, metrics, raster, samples
from ..operators.lineage import scratch
from ..sources import geotiff, readers, writers
from . import fixtures
from .fixtures import PARTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in fixtures.DUCK.items())
X = list(PARTS)


def query(sql: str | None = None):
    """Register a query under its function's name; ``sql`` follows the common views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = WITH.replace("WITH", "WITH RECURSIVE", 1) + ", " + sql.removeprefix("RECURSIVE ") if sql.startswith("RECURSIVE ") else f"{WITH} {sql}" if sql.lstrip().startswith("SELECT") else f"{WITH}, {sql.lstrip()}"
        return f

    return add


def r6(digits: int = 6, **columns: Column) -> list[Column]:
    return [(F.round(v, digits) + F.lit(0.0)).alias(k) for k, v in columns.items()]


def s6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def named(prefix: str, values: list[Column], digits: int = 6) -> list[Column]:
    return r6(digits, **{f"{prefix}{i + 1}": v for i, v in enumerate(values)})


# --- SQL fragments: replaced and closed parts of the samples -----------------------------------------------------------
_POS = {p: f"greatest({p}, 0)" for p in X}
_SUM = " + ".join(_POS.values())
_ZEROS = " + ".join(f"(CASE WHEN {p} <= 0 THEN 1 ELSE 0 END)" for p in X)
_FIX = ", ".join(f"CASE WHEN {p} <= 0 THEN 0.0625 ELSE {v} / ({_SUM}) * (1 - ({_ZEROS}) * 0.0625) END AS {p}" for p, v in _POS.items())
FIXED = f"fixed AS (SELECT serial, site, type, easting, northing, {_FIX} FROM samples)"
_LN = " + ".join(f"ln({p})" for p in X)


def fixed(spark: SparkSession, sf: str) -> DataFrame:
    df = fixtures.samples(spark, sf)
    return df.withColumns(dict(zip(X, coda.multiplicative_replacement(X))))


# --- compositions -------------------------------------------------------------------------------------------------------


@query(f"SELECT serial, {', '.join(s6(f'{p} / (si + al + p + k)', f'c{i + 1}') for i, p in enumerate(X))} FROM samples")
def closure(spark, sf):
    return fixtures.samples(spark, sf).select("serial", *named("c", coda.closure(X)))


@query(f"{FIXED} SELECT serial, {', '.join(s6(p, f'c{i + 1}') for i, p in enumerate(X))} FROM fixed")
def mult_replacement(spark, sf):
    return fixtures.samples(spark, sf).select("serial", *named("c", coda.multiplicative_replacement(X)))


@query(f"{FIXED} SELECT serial, {', '.join(s6(f'ln({p}) - ({_LN}) / 4', f'z{i + 1}') for i, p in enumerate(X))} FROM fixed")
def clr(spark, sf):
    return fixed(spark, sf).select("serial", *named("z", coda.clr(X)))


@query(f"{FIXED} SELECT serial, {', '.join(s6(f'{p} / (si + al + p + k)', f'c{i + 1}') for i, p in enumerate(X))} FROM fixed")
def clr_inverse(spark, sf):
    z = fixed(spark, sf).select("serial", *[c.alias(p) for c, p in zip(coda.clr(X), X)])
    return z.select("serial", *named("c", coda.clr_inv(X)))


@query(f"{FIXED} SELECT serial, {', '.join(s6(f'ln({p}) - ln(si)', f'a{i + 1}') for i, p in enumerate(X[1:]))} FROM fixed")
def alr(spark, sf):
    return fixed(spark, sf).select("serial", *named("a", coda.alr(X)))


@query(f"{FIXED} SELECT serial, {', '.join(s6(f'{p} / (si + al + p + k)', f'c{i + 1}') for i, p in enumerate(X))} FROM fixed")
def alr_inverse(spark, sf):
    z = fixed(spark, sf).select("serial", *[c.alias(f"a{i}") for i, c in enumerate(coda.alr(X))])
    return z.select("serial", *named("c", coda.alr_inv(["a0", "a1", "a2"])))


_ILR = [f"sqrt({k}.0 / {k + 1}) * (({' + '.join(f'ln({p})' for p in X[:k])}) / {k} - ln({X[k]}))" for k in (1, 2, 3)]


@query(f"{FIXED} SELECT serial, {', '.join(s6(e, f'b{i + 1}') for i, e in enumerate(_ILR))} FROM fixed")
def ilr_balance(spark, sf):
    return fixed(spark, sf).select("serial", *named("b", coda.ilr(X)))


@query(f"{FIXED} SELECT serial, {', '.join(s6(f'{p} / (si + al + p + k)', f'c{i + 1}') for i, p in enumerate(X))} FROM fixed")
def ilr_inverse(spark, sf):
    z = fixed(spark, sf).select("serial", *[c.alias(f"b{i}") for i, c in enumerate(coda.ilr(X))])
    return z.select("serial", *named("c", coda.ilr_inv(["b0", "b1", "b2"])))


_BAL = "(ln(p) + ln(k)) / 2 - (ln(si) + ln(al)) / 2"


@query(f"{FIXED} SELECT serial, {s6(_BAL, 'balance')} FROM fixed")
def group_balance(spark, sf):
    df = fixed(spark, sf)
    return df.select("serial", *r6(balance=coda.balance_of(df, ["p", "k", "absent"], ["si", "al"])))


_ALPHA, _BETA = coda.symmetric_coefficients(4)
_S = math.sqrt((3 + math.sqrt(8)) / 8)
_SHARED = f"{_ALPHA!r} * (ln(p) + ln(k)) - {_BETA!r} * (ln(si) + ln(al))"


@query(f"{FIXED} SELECT serial, {s6(f'{_S!r} * ln(p / k) + {_SHARED}', 'zi')}, {s6(f'-{_S!r} * ln(p / k) + {_SHARED}', 'zj')} FROM fixed")
def symmetric_balance(spark, sf):
    zi, zj = coda.symmetric_balance(X, 2, 3)
    return fixed(spark, sf).select("serial", *r6(zi=zi, zj=zj))


_Q = (1 - _ALPHA) / 2


@query(f"{FIXED} SELECT serial, {s6(f'{_S!r} * (ln(p) - {_ALPHA!r} * ln(k) - {_Q!r} * (ln(si) + ln(al)))', 'zi')} FROM fixed")
def symmetric_balance_zero_sum(spark, sf):
    return fixed(spark, sf).select("serial", *r6(zi=coda.symmetric_balance(X, 2, 3, zero_sum=True)[0]))


_MEANS = ", ".join(f"exp(avg(ln({p} / (si + al + p + k)))) AS {p}" for p in X)
_CLOSED = ", ".join(s6(f"{p} / (si + al + p + k)", f"c{i + 1}") for i, p in enumerate(X))


@query(f"{FIXED}, m AS (SELECT site, {_MEANS} FROM fixed GROUP BY site) SELECT site, {_CLOSED} FROM m")
def comp_center_by_site(spark, sf):
    out = coda.center(fixed(spark, sf), X, ["site"])
    return out.select("site", *named("c", [F.col(p) for p in X]))


_MOVED = [f"(f.{p} / (f.si + f.al + f.p + f.k)) / (m.{p} / (m.si + m.al + m.p + m.k))" for p in X]
_MOVED_SQL = ", ".join(s6(f"({e}) / ({' + '.join(_MOVED)})", f"c{i + 1}") for i, e in enumerate(_MOVED))


@query(f"{FIXED}, m AS (SELECT {_MEANS} FROM fixed) SELECT serial, {_MOVED_SQL} FROM fixed f, m")
def centralize(spark, sf):
    return coda.centralize(fixed(spark, sf), X).select("serial", *named("c", [F.col(p) for p in X]))


@query(f"{FIXED}, m AS (SELECT {_MEANS} FROM fixed WHERE type = 'Background') SELECT serial, {_MOVED_SQL} FROM fixed f, m")
def perturb_global(spark, sf):
    df = fixed(spark, sf)
    mid = coda.center(df.where(samples.is_background()), X, suffix="_m")
    moved = coda.perturb_difference(X, [p + "_m" for p in X])
    return df.crossJoin(F.broadcast(mid)).select("serial", *named("c", moved))


# --- background removal -------------------------------------------------------------------------------------------------

_LOCAL = """{fixed}, sites AS (SELECT DISTINCT site FROM samples WHERE type <> 'Background'),
keyed AS (SELECT * FROM fixed WHERE site IN (SELECT site FROM sites)),
spot AS (SELECT site, avg(easting) AS cx, avg(northing) AS cy FROM keyed GROUP BY site),
near AS (SELECT s.site, b.si, b.al, b.p, b.k FROM spot s JOIN fixed b ON b.type = 'Background' AND sqrt((s.cx - b.easting) * (s.cx - b.easting) + (s.cy - b.northing) * (s.cy - b.northing)) <= {r}),
m AS (SELECT site, {means} FROM near GROUP BY site)"""


def _local(r: float) -> str:
    return _LOCAL.format(fixed=FIXED, r=r, means=_MEANS)


@query(f"{_local(500.0)}, j AS (SELECT f.site, {', '.join(f'({e}) / ({" + ".join(_MOVED)}) AS {p}' for p, e in zip(X, _MOVED))} FROM keyed f JOIN m USING (site)) SELECT site, count(*) AS n, {s6(f'avg({_BAL})', 'balance')} FROM j GROUP BY site")
def background_removal_local(spark, sf):
    """Mean background-corrected balance of each site (the flagship)."""
    out = samples.remove_background(fixtures.samples(spark, sf), X, 500.0).where("corrected")
    return out.groupBy("site").agg(F.count("*").alias("n"), *r6(balance=F.avg(coda.group_balance(["p", "k"], ["si", "al"]))))


@query(f"{_local(2.0)} SELECT r.serial, m.si IS NOT NULL AS corrected, {', '.join(s6(f'CASE WHEN m.si IS NULL THEN r.{p} ELSE ({e}) / ({" + ".join(_MOVED)}) END', f'c{i + 1}', 8) for i, (p, e) in enumerate(zip(X, _MOVED)))} FROM keyed f JOIN samples r USING (serial) LEFT JOIN m ON m.site = f.site")
def background_passthrough(spark, sf):
    out = samples.remove_background(fixtures.samples(spark, sf), X, 2.0)
    return out.select("serial", "corrected", *named("c", [F.col(p) for p in X], 8))


@query(f"{FIXED}, m AS (SELECT {_MEANS} FROM fixed WHERE type = 'Background') SELECT serial, {_MOVED_SQL} FROM fixed f, m WHERE site IN (SELECT site FROM samples WHERE type <> 'Background')")
def background_removal_global(spark, sf):
    out = samples.remove_background(fixtures.samples(spark, sf), X, None)
    return out.select("serial", *named("c", [F.col(p) for p in X]))


# --- collapse, filters, set operations ----------------------------------------------------------------------------------


@query(f"{FIXED}, px AS (SELECT *, CAST(floor((5000 - northing) / 250) AS INT) AS r, CAST(floor(easting / 200) AS INT) AS c FROM fixed), "
       f"g AS (SELECT r, c, count(*) AS n, min(serial) AS serial, {_MEANS}, {', '.join(f'arg_min({p}, serial) AS raw_{p}' for p in X)} FROM px WHERE r BETWEEN 0 AND 19 AND c BETWEEN 0 AND 24 GROUP BY r, c) "
       f"SELECT r, c, n, serial, {', '.join(s6(f'CASE WHEN n > 1 THEN {p} / (si + al + p + k) ELSE raw_{p} END', f'c{i + 1}') for i, p in enumerate(X))} FROM g")  # fmt: skip
def pixel_aggregate(spark, sf):
    grid = raster.Header(0, 5000, 200, 250, 20, 25)
    out = raster.aggregate_pixels(raster.to_pixels(fixed(spark, sf), grid), X)
    return out.select("r", "c", "n", "serial", *named("c", [F.col(p) for p in X]))


@query(f"{FIXED}, g AS (SELECT CAST(split_part(serial, '.', 1) AS BIGINT) AS parent, count(*) AS n, arg_min(site, serial) AS site, arg_min(type, serial) AS type, avg(easting) AS easting, avg(northing) AS northing, {_MEANS}, {', '.join(f'arg_min({p}, serial) AS raw_{p}' for p in X)} FROM fixed GROUP BY 1) "
       f"SELECT parent, n, site, type, {s6('easting', 'x')}, {s6('northing', 'y')}, {', '.join(s6(f'CASE WHEN n > 1 THEN {p} / (si + al + p + k) ELSE raw_{p} END', f'c{i + 1}') for i, p in enumerate(X))} FROM g")  # fmt: skip
def triple_collapse(spark, sf):
    out = samples.collapse_triples(fixed(spark, sf), X)
    return out.select("parent", "n", "site", "type", *r6(x=F.col("easting"), y=F.col("northing")), *named("c", [F.col(p) for p in X]))


@query("SELECT serial, site, type FROM samples WHERE site IN ('1', '2', '3', '4', '5') AND site NOT IN ('3') AND type LIKE 'COR%'")
def sample_filter(spark, sf):
    return samples.sample_filter(fixtures.samples(spark, sf), ["1", "2", "3", "4", "5"], ["3"], "COR", [], None).select("serial", "site", "type")


@query("SELECT type = 'Background' AS background, count(*) AS n FROM samples GROUP BY 1")
def background_split(spark, sf):
    return fixtures.samples(spark, sf).groupBy(samples.is_background().alias("background")).agg(F.count("*").alias("n"))


@query("SELECT type, site, count(*) AS n FROM samples GROUP BY type, site")
def value_counts(spark, sf):
    return fixtures.samples(spark, sf).groupBy("type", "site").agg(F.count("*").alias("n"))


@query(f"SELECT site, {s6('avg(easting)', 'cx')}, {s6('avg(northing)', 'cy')}, count(DISTINCT type) AS kinds FROM samples GROUP BY site")
def site_centroid(spark, sf):
    df = fixtures.samples(spark, sf)
    return df.groupBy("site").agg(*r6(cx=F.avg("easting"), cy=F.avg("northing")), F.countDistinct("type").alias("kinds"))


@query("SELECT r, c, emb[1] > 0 AS up FROM pixels WHERE len(list_filter(emb, lambda x: NOT isfinite(x))) = 0 AND nir + red > 0")
def feature_finite_filter(spark, sf):
    px = fixtures.pixels(spark, sf).where(samples.all_finite(["blue", "red", "nir", "swir1"])).where("nir + red > 0")
    return px.select("r", "c", (F.get("emb", F.lit(0)) > 0).alias("up"))


@query("SELECT r, c FROM pixels WHERE abs(blue) + abs(green) + abs(red) > 0.2")
def nonzero_pixels(spark, sf):
    px = fixtures.pixels(spark, sf).where(samples.any_nonzero(["blue", "green", "red"]))
    return px.where(raster.stack_sum([F.abs(b) for b in ("blue", "green", "red")]) > 0.2).select("r", "c")


@query("SELECT new AS cls, count(*) AS n FROM pixels p JOIN (VALUES (0, 1), (1, 2), (2, 1), (3, 2), (4, 3), (5, 1), (6, 2), (7, 3), (8, 1), (9, 2)) t(old, new) ON p.label = t.old GROUP BY 1")
def class_remap(spark, sf):
    table = dict(zip(range(10), (1, 2, 1, 2, 3, 1, 2, 3, 1, 2)))
    return fixtures.pixels(spark, sf).groupBy(samples.remap(F.col("label"), table).alias("cls")).agg(F.count("*").alias("n"))


@query(f"SELECT serial, {s6('y_pred - y_true', 'residual')}, {s6('least(greatest(y_pred, -1.0), 1.0)', 'clipped')} FROM pairs WHERE serial NOT IN (1, 5, 9)")
def residual_clip(spark, sf):
    df = samples.exclude_ids(fixtures.pairs(spark, sf), ["1", "5", "9"])
    return df.select("serial", *r6(residual=F.col("y_pred") - F.col("y_true"), clipped=samples.clip(F.col("y_pred"), -1.0, 1.0)))


_PREV = "(VALUES ('xgb', 'oof', 'a', 0.5), ('xgb', 'cv', 'a', 0.4), ('ridge', 'oof', 'a', 0.3)) t(model, eval, dataset, r2)"
_NEW = "(VALUES ('xgb', 'oof', 'a', 0.6, 0.9), ('ridge', 'oof', 'b', 0.2, 0.8)) t(model, eval, dataset, r2, auc)"


@query(f"SELECT model, eval, dataset, CAST(r2 AS DOUBLE) AS r2, CAST(NULL AS DOUBLE) AS auc FROM {_PREV} WHERE NOT (model = 'xgb' AND eval = 'oof') UNION ALL SELECT model, eval, dataset, CAST(r2 AS DOUBLE), CAST(auc AS DOUBLE) FROM {_NEW}")
def upsert_metrics(spark, sf):
    prev = spark.sql(f"SELECT model, eval, dataset, CAST(r2 AS DOUBLE) AS r2 FROM {_PREV.replace(' t(', ' AS t(')}")
    new = spark.sql(f"SELECT model, eval, dataset, CAST(r2 AS DOUBLE) AS r2, CAST(auc AS DOUBLE) AS auc FROM {_NEW.replace(' t(', ' AS t(')}")
    return samples.upsert(prev, new, ["model", "eval", "dataset", "absent"])


@query("SELECT serial, type, 'sample' AS kind FROM samples WHERE type <> 'Background' UNION ALL SELECT serial, type, 'background' FROM samples WHERE type = 'Background'")
def union_align(spark, sf):
    df = fixtures.samples(spark, sf)
    own = df.where(~samples.is_background()).select("serial", "type", F.lit("sample").alias("kind"))
    return own.unionByName(df.where(samples.is_background()).select("type", F.lit("background").alias("kind"), "serial"))


@query("SELECT serial FROM samples WHERE serial IN (SELECT serial FROM samples WHERE p > 0.05)")
def semi_serials(spark, sf):
    df = fixtures.samples(spark, sf)
    return df.join(df.where("p > 0.05").select("serial"), "serial", "left_semi").select("serial")


@query(f"{FIXED}, s AS (SELECT serial, si, al, p FROM fixed), g AS (SELECT serial, si / (si + al + p) AS si, al / (si + al + p) AS al, p / (si + al + p) AS p FROM s) SELECT serial, {s6('al', 'c1')}, {s6('p', 'c2')}, {s6('si', 'c3')} FROM g")
def subcomposition_align(spark, sf):
    df = fixed(spark, sf).select("serial", *X)
    training, _, shared = samples.align(df, df.drop("k"))
    return training.select("serial", *named("c", [F.col(p) for p in shared]))


# --- pairs of parts, balances -------------------------------------------------------------------------------------------

_PAIRS = list(itertools.combinations(X, 2))
_VARIATION = " UNION ALL ".join(f"SELECT '{a}' AS part_i, '{b}' AS part_j, var_samp(ln({a}) - ln({b})) AS t FROM fixed" for a, b in _PAIRS)


@query(f"{FIXED}, v AS ({_VARIATION}) SELECT part_i, part_j, {s6('t', 't')} FROM v")
def variation_matrix(spark, sf):
    return groups.variation_matrix(fixed(spark, sf), X).select("part_i", "part_j", *r6(t=F.col("t")))


SIGNS = np.array([[1, 1, -1, -1], [1, -1, 0, 0], [0, 0, 1, -1]])
_PB = ["(ln(si) + ln(al)) / 2 - (ln(p) + ln(k)) / 2", "sqrt(0.5) * (ln(si) - ln(al))", "sqrt(0.5) * (ln(p) - ln(k))"]


@query(f"{FIXED}, v AS ({' UNION ALL '.join(f'SELECT {i + 1} AS balance, var_samp({e}) AS variance FROM fixed' for i, e in enumerate(_PB))}) SELECT balance, {s6('variance', 'variance')}, {s6('100 * variance / sum(variance) OVER ()', 'pct')}, row_number() OVER (ORDER BY variance DESC, balance) AS rank FROM v")
def principal_balances(spark, sf):
    out = groups.principal_balances(fixed(spark, sf), X, SIGNS)
    return out.select("balance", *r6(variance=F.col("variance"), pct=F.col("pct")), F.col("rank").cast("bigint").alias("rank"))


_LABELS = [("si", 1), ("al", 1), ("p", 2), ("k", 3)]
_CLUSTER = f"{FIXED}, v AS ({_VARIATION}), l AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _LABELS)}) t(part, cluster)), s AS (SELECT cluster, count(*) AS size FROM l GROUP BY cluster), m AS (SELECT a.cluster, avg(t) AS mv FROM v JOIN l a ON a.part = part_i JOIN l b ON b.part = part_j AND a.cluster = b.cluster GROUP BY a.cluster)"


def _clusters(spark, sf):
    labels = spark.createDataFrame(_LABELS, "part string, cluster int")
    return groups.cluster_variation(groups.variation_matrix(fixed(spark, sf), X), labels)


@query(f"{_CLUSTER} SELECT cluster, size, mv IS NULL AS alone, {s6('coalesce(mv, 0)', 'mean_var')} FROM s LEFT JOIN m USING (cluster)")
def cluster_mean_variation(spark, sf):
    alone = F.col("mean_var") == F.lit(math.inf)
    return _clusters(spark, sf).select("cluster", "size", alone.alias("alone"), *r6(mean_var=F.when(alone, 0.0).otherwise(F.col("mean_var"))))


@query(f"{_CLUSTER} SELECT cluster, size, {s6('mv', 'mean_var')} FROM s JOIN m USING (cluster) WHERE size >= 2 ORDER BY mv, size DESC LIMIT 1")
def background_cluster(spark, sf):
    return groups.background_cluster(_clusters(spark, sf)).select("cluster", "size", *r6(mean_var=F.col("mean_var")))


@query()
def compositional_groups(spark, sf):
    found = groups.compositional_groups(fixtures.samples(spark, sf), X, 0.95)
    rows = [(p, int(c), p in found["markers"], k) for k, (p, c) in enumerate(zip(X, found["labels"]))]
    return spark.createDataFrame(rows, "part string, cluster int, marker boolean, ord int")


@query()
def partition_tree(spark, sf):
    found = groups.compositional_groups(fixtures.samples(spark, sf), X, 0.95)
    return spark.createDataFrame([(k, p, int(s)) for k, row in enumerate(found["signs"]) for p, s in zip(X, row)], "k int, part string, sign int")


_FILL = ", ".join(f"(SELECT coalesce(min({p}) FILTER ({p} > 0) * 1e-3, 1e-9) FROM samples WHERE type = 'Background') AS f_{p}" for p in X)
_SPEAR = f"""e AS (SELECT {', '.join(f'CASE WHEN {p} > 0 THEN {p} ELSE f_{p} END AS {p}' for p in X)} FROM samples, (SELECT {_FILL}) WHERE type = 'Background'),
z AS (SELECT {', '.join(f'ln({p}) - ({_LN}) / 4 AS {p}' for p in X)} FROM e),
q AS (SELECT {', '.join(f'rank() OVER (ORDER BY {p}) + (count(*) OVER (PARTITION BY {p}) - 1) / 2.0 AS {p}' for p in X)} FROM z),
c AS ({' UNION ALL '.join(f"SELECT '{a}' AS part_i, '{b}' AS part_j, corr({a}, {b}) AS rho FROM q" for a, b in _PAIRS)})"""


@query(f"{_SPEAR} SELECT part_i, part_j, round(rho, 3) + 0.0 AS rho FROM c")
def clr_spearman(spark, sf):
    df = fixtures.samples(spark, sf).where(samples.is_background())
    return groups.clr_spearman(df, X).select("part_i", "part_j", (F.round("rho", 3) + F.lit(0.0)).alias("rho"))


@query(f"{_SPEAR} SELECT part, count(*) AS n FROM (SELECT unnest([part_i, part_j]) AS part FROM c WHERE abs(rho) > 0.2) GROUP BY part")
def lithogenic_elements(spark, sf):
    return groups.lithogenic_elements(fixtures.samples(spark, sf).where(samples.is_background()), X, 0.2)


_SUBSETS = [(i, str(s)) for i, own in enumerate(itertools.combinations(range(1, 7), 2)) for s in own]


@query(f"{FIXED}, u AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b!r})' for a, b in _SUBSETS)}) t(subset_id, site)), b AS (SELECT site, {_BAL} AS b FROM fixed) SELECT subset_id, count(*) AS n, {s6('var_samp(b)', 'score')} FROM b JOIN u USING (site) GROUP BY subset_id")
def subset_search_scores(spark, sf):
    subsets = spark.createDataFrame(_SUBSETS, "subset_id int, site string")
    out = groups.subset_scores(fixed(spark, sf), subsets, X, ["p", "k"], ["si", "al"])
    return out.select("subset_id", "n", *r6(score=F.col("score")))


@query()
def subset_search_exhaustive(spark, sf):
    found = groups.search_subsets(fixed(spark, sf), X, ["1", "2", "3", "4", "5"], 2, 4, color_frac=0.95)
    return spark.createDataFrame([(k, ",".join(c), round(v, 6)) for k, (v, c) in enumerate(found)], "place int, sites string, score double")


@query()
def subset_search_greedy(spark, sf):
    found = groups.search_subsets(fixed(spark, sf), X, ["1", "2", "3", "4", "5", "6"], 1, 4, greedy=True, color_frac=0.95)
    return spark.createDataFrame([(k, ",".join(c), round(v, 6)) for k, (v, c) in enumerate(found)], "place int, sites string, score double")


_M, _V, _W = (-1.0, 1.5), (0.4, 0.6), (0.55, 0.45)
_D = [f"{_W[i]} * exp(-power(g - ({_M[i]}), 2) / (2 * {_V[i]})) / sqrt({_V[i]})" for i in (0, 1)]


@query(f"grid AS (SELECT -3.0::DOUBLE + i * (6.0::DOUBLE / 1999) AS g FROM range(2000) t(i)), d AS (SELECT g, abs(({_D[0]}) / (({_D[0]}) + ({_D[1]})) - 0.5) AS off FROM grid WHERE g BETWEEN {_M[0]} AND {_M[1]}) SELECT {s6('arg_min(g, off)', 'threshold')} FROM d")
def antimode_grid(spark, sf):
    g = F.lit(-3.0) + F.col("id") * (6.0 / 1999)
    d = [F.lit(_W[i]) * F.exp(-F.pow(F.col("g") - _M[i], 2) / (2 * _V[i])) / math.sqrt(_V[i]) for i in (0, 1)]
    grid = spark.range(2000).select(g.alias("g")).where(F.col("g").between(*_M))
    return grid.agg(*r6(threshold=F.min_by("g", F.abs(d[0] / (d[0] + d[1]) - 0.5))))


@query()
def gmm_split(spark, sf):
    out = groups.population_split(fixtures.pairs(spark, sf), "y_true")
    return spark.createDataFrame([(out["bimodal"], out["bic1"], out["bic2"], float(out.get("threshold") or 0.0))], "bimodal boolean, bic1 double, bic2 double, threshold double")


# --- spectral indices ---------------------------------------------------------------------------------------------------

_BANDS = ["blue", "green", "red", "rededge", "nir", "swir1", "swir2"]


def _bands(positive: bool = False) -> dict[str, Column]:
    return {b: (F.col(b) + 1) / 2 if positive else F.col(b) for b in _BANDS}


_PX = "px AS (SELECT r, c, " + ", ".join(f"({b} + 1) / 2 AS {b}" for b in _BANDS) + " FROM pixels)"
_PLAIN = {
    "NDVI": "(nir - red) / (nir + red + 1e-8)", "SAVI": "1.5 * (nir - red) / (nir + red + 0.5)", "BSI": "((swir1 + red) - (nir + blue)) / ((swir1 + red) + (nir + blue) + 1e-8)",
    "NDMI": "(nir - swir1) / (nir + swir1 + 1e-8)", "Clay_Index": "swir2 / (swir1 + 1e-8)", "NDWI": "(green - nir) / (green + nir + 1e-8)", "Calcite_Index": "(swir1 - swir2) / (swir1 + swir2 + 1e-8)",
}


@query(f"{_PX} SELECT r, c, {', '.join(s6(e, n) for n, e in _PLAIN.items())} FROM px")
def spectral_indices_plain(spark, sf):
    return fixtures.pixels(spark, sf).select("r", "c", *r6(**indices.plain_indices(_bands(True))))


_GUARDED = {
    "NDVI": "CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red + 1e-8) ELSE 0 END", "RE_NDVI": "CASE WHEN nir + rededge > 0 THEN (nir - rededge) / (nir + rededge + 1e-8) ELSE 0 END",
    "Blue_Red": "CASE WHEN red > 0 THEN blue / red ELSE 0 END", "Blue_NIR": "CASE WHEN nir > 0 THEN blue / nir ELSE 0 END",
    "BSI": "CASE WHEN (swir1 + red) + (nir + blue) <> 0 THEN ((swir1 + red) - (nir + blue)) / ((swir1 + red) + (nir + blue)) ELSE 0 END",
    "SAVI": "1.5 * (nir - red) / (nir + red + 0.5)",
}


@query(f"SELECT r, c, {', '.join(s6(e, n) for n, e in _GUARDED.items())} FROM pixels")
def spectral_indices_guarded(spark, sf):
    out = indices.guarded_indices(_bands())
    return fixtures.pixels(spark, sf).select("r", "c", *r6(**{k: out[k] for k in _GUARDED}))


@query(f"SELECT r, c, {s6('(2 * nir + 1 - sqrt(greatest((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red), 0))) / 2', 'MSAVI')} FROM pixels")
def msavi(spark, sf):
    return fixtures.pixels(spark, sf).select("r", "c", *r6(MSAVI=indices.guarded_indices(_bands())["MSAVI"]))


# --- rasters ------------------------------------------------------------------------------------------------------------

# the fixture's grid has 25 columns; a row of it is 250 m high at the small scales
_H = "(SELECT max(r) + 1 FROM pixels)"


def _grid(px: DataFrame) -> raster.Header:
    h = int(px.agg(F.max("r")).first()[0]) + 1
    return raster.Header(0, 5000, 200, 5000 / h, h, 25)


@query(f"SELECT serial, p.r, p.c, {s6('p.nir', 'nir')} FROM samples s LEFT JOIN pixels p ON p.r = CAST(floor((5000 - northing) / (5000.0::DOUBLE / {_H})) AS INT) AND p.c = CAST(floor(easting / 200) AS INT)")
def point_to_pixel(spark, sf):
    px = fixtures.pixels(spark, sf)
    spots = px.select("r", "c", F.col("r").alias("pr"), F.col("c").alias("pc"), "nir")
    out = raster.sample_at(fixtures.samples(spark, sf), spots, _grid(px))
    return out.select("serial", F.col("pr").alias("r"), F.col("pc").alias("c"), *r6(nir=F.col("nir")))


@query(f"SELECT r, c, {s6('CASE WHEN cls = 1 THEN red END', 'red')}, {s6('CASE WHEN cls = 1 THEN nir END', 'nir')} FROM pixels")
def mask_apply(spark, sf):
    px = fixtures.pixels(spark, sf)
    return raster.apply_mask(px.select("r", "c", "red", "nir"), px, ["red", "nir"]).select("r", "c", *r6(red=F.col("red"), nir=F.col("nir")))


@query(f"SELECT cls, count(*) AS n, {s6('100.0 * count(*) / sum(count(*)) OVER ()', 'pct_all')}, {s6('CASE WHEN cls <> 0 THEN 100.0 * count(*) / sum(CASE WHEN cls <> 0 THEN count(*) END) OVER () END', 'pct_valid')} FROM pixels GROUP BY cls")
def mask_coverage(spark, sf):
    return raster.coverage(fixtures.pixels(spark, sf)).select("cls", "n", *r6(pct_all=F.col("pct_all"), pct_valid=F.col("pct_valid")))


@query(f"t AS (SELECT i // 30 AS r, i % 30 AS c FROM range(900) g(i)), q AS (SELECT r, c, CAST(floor((r + 0.5) * (5000.0::DOUBLE / 30) / (5000.0::DOUBLE / {_H})) AS INT) AS sr, CAST(floor((c + 0.5) * (5000.0::DOUBLE / 30) / 200) AS INT) AS sc FROM t) SELECT CAST(q.r AS INT) AS r, CAST(q.c AS INT) AS c, {s6('p.nir', 'nir')} FROM q JOIN pixels p ON p.r = q.sr AND p.c = q.sc")
def nearest_resample(spark, sf):
    px = fixtures.pixels(spark, sf)
    out = raster.resample_nearest(px, ["nir"], _grid(px), raster.Header(0, 5000, 5000 / 30, 5000 / 30, 30, 30))
    return out.select("r", "c", *r6(nir=F.col("nir")))


_V0, _U0 = f"((r + 0.5) * (5000.0::DOUBLE / 30) / (5000.0::DOUBLE / {_H}) - 0.5)", "((c + 0.5) * (5000.0::DOUBLE / 30) / 200 - 0.5)"


@query(f"t AS (SELECT i // 30 AS r, i % 30 AS c FROM range(900) g(i)), q AS (SELECT r, c, {_V0} AS v, {_U0} AS u FROM t), k AS (SELECT r, c, CAST(floor(v) + i AS INT) AS sr, CAST(floor(u) + j AS INT) AS sc, abs(1 - i - (v - floor(v))) * abs(1 - j - (u - floor(u))) AS w FROM q, range(2) a(i), range(2) b(j)) SELECT CAST(k.r AS INT) AS r, CAST(k.c AS INT) AS c, {s6('sum(w * nir) / sum(w)', 'nir')} FROM k JOIN pixels p ON p.r = sr AND p.c = sc WHERE w > 0 GROUP BY k.r, k.c")
def bilinear_resample(spark, sf):
    px = fixtures.pixels(spark, sf)
    out = raster.resample_bilinear(px, ["nir"], _grid(px), raster.Header(0, 5000, 5000 / 30, 5000 / 30, 30, 30))
    return out.select("r", "c", *r6(nir=F.col("nir")))


@query(f"s AS (SELECT serial, CAST(floor((5000 - northing) / (5000.0::DOUBLE / {_H})) AS INT) AS sr, CAST(floor(easting / 200) AS INT) AS sc FROM samples) SELECT serial, {s6('median(nir)', 'nir')} FROM s JOIN pixels p ON p.r BETWEEN sr - 1 AND sr + 1 AND p.c BETWEEN sc - 1 AND sc + 1 WHERE sr BETWEEN 0 AND {_H} - 1 AND sc BETWEEN 0 AND 24 GROUP BY serial")
def median_window_clip(spark, sf):
    px = fixtures.pixels(spark, sf)
    spots = raster.to_pixels(fixtures.samples(spark, sf), _grid(px))
    return raster.window_median_clipped(spots, px, ["nir"], 3).select("serial", *r6(nir=F.col("nir")))


@query(f"o AS (SELECT i - 1 AS i, j - 1 AS j FROM range(3) a(i), range(3) b(j)) SELECT q.r, q.c, {s6('median(p.nir)', 'nir')} FROM pixels q, o JOIN pixels p ON p.r = least(greatest(q.r + i, 0), {_H} - 1) AND p.c = least(greatest(q.c + j, 0), 24) GROUP BY q.r, q.c")
def median_filter_nearest(spark, sf):
    px = fixtures.pixels(spark, sf)
    return raster.median_filter(px.select("r", "c", "nir"), ["nir"], 3, _grid(px)).select("r", "c", *r6(nir=F.col("nir")))


_REFLECT = lambda v, top: f"CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} >= {top} THEN 2 * {top} - 1 - ({v}) ELSE {v} END"
_BOX = f"h AS (SELECT {_H} AS h), o AS (SELECT i - 1 AS i, j - 1 AS j FROM range(3) a(i), range(3) b(j)), box AS (SELECT q.r, q.c, avg(p.nir) AS smooth FROM pixels q, o, h JOIN pixels p ON p.r = {_REFLECT('q.r + i', 'h')} AND p.c = {_REFLECT('q.c + j', '25')} GROUP BY q.r, q.c)"


@query(f"{_BOX} SELECT r, c, {s6('smooth', 'nir')} FROM box")
def box_filter(spark, sf):
    px = fixtures.pixels(spark, sf)
    return raster.box_filter(px, ["nir"], 3, _grid(px)).select("r", "c", *r6(nir=F.col("nir")))


_BOXP = _BOX.replace("avg(p.nir)", "avg((p.nir + 1) / 2)")


@query(f"{_BOXP}, x AS (SELECT r, c, (swir1 + 1) / 2 AS a, (swir1 + 1) / 2 * ((nir + 1) / 2) / smooth AS b FROM pixels JOIN box USING (r, c)) SELECT r, c, {s6('b * (SELECT avg(a) / (avg(b) + 1e-8) FROM x)', 'swir1')} FROM x")
def pansharpen_ratio(spark, sf):
    px = fixtures.pixels(spark, sf).select("r", "c", *[((F.col(b) + 1) / 2).alias(b) for b in ("nir", "swir1")])
    return raster.pansharpen(px, ["swir1"], "nir", 3, _grid(px)).select("r", "c", *r6(swir1=F.col("swir1")))


_RECTS = [(1, 7, 1, 210.0, 1210.0, 2010.0, 4010.0), (2, 8, 2, 810.0, 2610.0, 1010.0, 3010.0)]


def _rectangles(spark):
    rows = [(i, label, o, [(a, c), (b, c), (b, d), (a, d)]) for i, label, o, a, b, c, d in _RECTS]
    return spark.createDataFrame(rows, "id int, label int, ord int, ring array<struct<x: double, y: double>>")


_CENTRE = f"px AS (SELECT r, c, nir, (c + 0.5) * 200 AS x, 5000 - (r + 0.5) * (5000.0::DOUBLE / {_H}) AS y FROM pixels)"
_IN = "CASE WHEN x > 810 AND x < 2610 AND y > 1010 AND y < 3010 THEN 8 WHEN x > 210 AND x < 1210 AND y > 2010 AND y < 4010 THEN 7 ELSE 0 END"


@query(f"{_CENTRE} SELECT r, c, {_IN} AS label FROM px")
def rasterize_polygons(spark, sf):
    px = fixtures.pixels(spark, sf)
    return raster.rasterize(_rectangles(spark), _grid(px), pixels=px)


@query(f"{_CENTRE} SELECT r, c, {s6(f'CASE WHEN ({_IN}) > 0 THEN nir END', 'nir')} FROM px")
def aoi_clip(spark, sf):
    px = fixtures.pixels(spark, sf)
    return raster.clip_to(px.select("r", "c", "nir"), _rectangles(spark), _grid(px), ["nir"]).select("r", "c", *r6(nir=F.col("nir")))


@query(f"SELECT 'red' AS index, {s6('min(red)', 'lo')}, {s6('max(red)', 'hi')} FROM pixels UNION ALL SELECT 'nir', {s6('min(nir)', 'lo')}, {s6('max(nir)', 'hi')} FROM pixels")
def range_report(spark, sf):
    return raster.finite_range(fixtures.pixels(spark, sf), ["red", "nir"]).select("index", *r6(lo=F.col("lo"), hi=F.col("hi")))


@query()
def sieve(spark, sf):
    return raster.sieve(fixtures.pixels(spark, sf).select("r", "c", "cls"), 4)


def _as_float(e: str, name: str) -> str:
    return f"round(CAST(CAST({e} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {name}"


_STACK = _GUARDED | {"MSAVI": "(2 * nir + 1 - sqrt(greatest((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red), 0))) / 2"}
_STACK_SQL = ", ".join([_as_float(b, b) for b in _BANDS] + [_as_float(e, n) for n, e in _STACK.items()] + [_as_float(f"emb[{i + 1}]", f"Emb_A{i:02d}") for i in range(64)])


def _stacked(spark, sf):
    return raster.feature_stack(fixtures.pixels(spark, sf).select("r", "c", *_BANDS, "emb"), _bands(), "emb")


def _r4(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in ("r", "c")]
    return df.select("r", "c", *r6(4, **{c: F.col(c).cast("double") for c in rest}))


@query(f"SELECT r, c, {_STACK_SQL} FROM pixels")
def feature_stack(spark, sf):
    return _r4(_stacked(spark, sf))


@query(f"SELECT r, c, {_STACK_SQL} FROM pixels")
def feature_stack_sink(spark, sf):
    path = scratch(spark, "stack")
    writers.feature_stack(fixtures.pixels(spark, sf).select("r", "c", *_BANDS, "emb"), path, _bands(), "emb", tile=16)
    return _r4(spark.read.parquet(path).drop("tile_r", "tile_c"))


# fusion in SQL: a fine grid of k x k pixels for each coarse one, coarse bands bilinear, then a ratio to a moving mean
def _fusion(k: int, fine: dict[str, str], coarse: dict[str, str], sharpen: dict[str, str], size: int) -> str:
    lo, hi = -(size // 2), size - 1 - size // 2
    at = lambda v, top: f"CASE WHEN {v} < 0 THEN -({v}) - 1 WHEN {v} >= {top} THEN 2 * {top} - 1 - ({v}) ELSE {v} END"
    steps = [
        f"h AS (SELECT max(r) + 1 AS h FROM pixels), t AS (SELECT i // {25 * k} AS r, i % {25 * k} AS c FROM h, range(h * {25 * k * k}) g(i))",
        f"fine AS (SELECT t.r, t.c, {', '.join(f'{e} AS {n}' for n, e in fine.items())} FROM t JOIN pixels p ON p.r = t.r // {k} AND p.c = t.c // {k})",
        f"vu AS (SELECT r, c, (r + 0.5) / {k}::DOUBLE - 0.5 AS v, (c + 0.5) / {k}::DOUBLE - 0.5 AS u FROM t)",
        "kk AS (SELECT r, c, CAST(floor(v) + i AS INT) AS sr, CAST(floor(u) + j AS INT) AS sc, abs(1 - i - (v - floor(v))) * abs(1 - j - (u - floor(u))) AS w FROM vu, range(2) a(i), range(2) b(j))",
        f"wide AS (SELECT kk.r, kk.c, {', '.join(f'sum(w * ({e})) / sum(w) AS {n}' for n, e in coarse.items())} FROM kk JOIN pixels p ON p.r = sr AND p.c = sc WHERE w > 0 GROUP BY kk.r, kk.c)",
        f"o AS (SELECT i + ({lo}) AS i, j + ({lo}) AS j FROM range({size}) a(i), range({size}) b(j))",
        f"box AS (SELECT q.r, q.c, {', '.join(f'avg(f.{p}) AS {p}' for p in dict.fromkeys(sharpen.values()))} FROM t q, o, h JOIN fine f ON f.r = {at('q.r + i', f'(h * {k})')} AND f.c = {at('q.c + j', str(25 * k))} GROUP BY q.r, q.c)",
        f"raw AS (SELECT fine.*, {', '.join(f'wide.{n} * (fine.{sharpen[n]} / CASE WHEN box.{sharpen[n]} = 0 THEN 1e-8 ELSE box.{sharpen[n]} END) AS {n}, wide.{n} AS was_{n}' if n in sharpen else f'wide.{n}' for n in coarse)} FROM fine JOIN wide USING (r, c) JOIN box USING (r, c))",
        f"m AS (SELECT {', '.join(f'avg(was_{n}) / (avg({n}) + 1e-8) AS {n}' for n in sharpen)} FROM raw)",
    ]
    out = [s6(f"raw.{n}", n) for n in fine] + [s6(f"raw.{n} * m.{n}" if n in sharpen else f"raw.{n}", n) for n in coarse]
    return f"{', '.join(steps)} SELECT CAST(raw.r AS INT) AS r, CAST(raw.c AS INT) AS c, {', '.join(out)} FROM raw, m"


def _fused(spark, sf, k: int, fine: dict[str, Column], coarse: dict[str, Column], sharpen: dict[str, str], least: int):
    px = fixtures.pixels(spark, sf)
    grid = _grid(px)
    small = raster.Header(0, 5000, 200 / k, grid.dy / k, grid.height * k, 25 * k)
    near = raster.resample_nearest(px.select("r", "c", *[v.alias(n) for n, v in fine.items()]), list(fine), grid, small)
    out = raster.fuse(near, small, px.select("r", "c", *[v.alias(n) for n, v in coarse.items()]), grid, sharpen, least)
    return out.select("r", "c", *r6(**{n: F.col(n) for n in (*fine, *coarse)}))


_unit = lambda i: (F.get("emb", F.lit(i)).cast("double") + 1) / 2
_unit_sql = lambda i: f"(CAST(emb[{i + 1}] AS DOUBLE) + 1) / 2"
_S2 = ["B2_blue", "B3_green", "B4_red", "B5_rededge1", "B6_rededge2", "B7_rededge3", "B8_nir", "B8A_nir08", "B11_swir16", "B12_swir22"]
_PAN = dict(zip([f"S2_{b}" for b in _S2[:8]], ["SPOT_blue", "SPOT_green", "SPOT_red", "SPOT_red", "SPOT_nir", "SPOT_nir", "SPOT_nir", "SPOT_nir"]))
_SPOT = {"SPOT_red": "red", "SPOT_green": "green", "SPOT_blue": "blue", "SPOT_nir": "nir"}


@query(_fusion(2, {n: f"({b} + 1) / 2" for n, b in _SPOT.items()}, {f"S2_{b}": _unit_sql(i + 12) for i, b in enumerate(_S2)}, _PAN, 2))
def fuse_spot_sentinel(spark, sf):
    """Four fine and ten coarse bands, eight of them sharpened."""
    return _fused(spark, sf, 2, {n: (F.col(b) + 1) / 2 for n, b in _SPOT.items()}, {f"S2_{b}": _unit(i + 12) for i, b in enumerate(_S2)}, _PAN, 2)


_DRAG = [f"Drag_{i:02d}" for i in range(23)]
_REF = {"S2_red": "Drag_05", "S2_green": "Drag_03", "S2_nir": "Drag_20", "S2_swir": "Drag_22"}


@query(_fusion(3, {n: _unit_sql(i) for i, n in enumerate(_DRAG)}, {n: _unit_sql(i + 40) for i, n in enumerate(_REF)}, _REF, 3))
def fuse_hyperspectral(spark, sf):
    """Twenty-three fine and four coarse bands, each sharpened by the fine band next to it."""
    return _fused(spark, sf, 3, {n: _unit(i) for i, n in enumerate(_DRAG)}, {n: _unit(i + 40) for i, n in enumerate(_REF)}, _REF, 1)


_SWIR = ("S2_B11_swir16", "S2_B12_swir22")
_BOX11 = _BOXP.replace("range(3) a(i), range(3) b(j)", "range(11) a(i), range(11) b(j)").replace("i - 1 AS i, j - 1 AS j", "i - 5 AS i, j - 5 AS j")


@query(f"{_BOX11}, x AS (SELECT r, c, {', '.join(f'({b} + 1) / 2 AS a{i}, ({b} + 1) / 2 * ((nir + 1) / 2) / smooth AS b{i}' for i, b in enumerate(('swir1', 'swir2')))} FROM pixels JOIN box USING (r, c)) SELECT r, c, {', '.join(s6(f'b{i} * (SELECT avg(a{i}) / (avg(b{i}) + 1e-8) FROM x)', n) for i, n in enumerate(_SWIR))} FROM x")
def sharpen_swir(spark, sf):
    px = fixtures.pixels(spark, sf)
    named = px.select("r", "c", *[((F.col(b) + 1) / 2).alias(n) for b, n in (("nir", "SPOT_nir"), ("swir1", _SWIR[0]), ("swir2", _SWIR[1]))])
    return raster.sharpen_swir(named, _grid(px)).select("r", "c", *r6(**{n: F.col(n) for n in _SWIR}))


@query(f"t AS (SELECT i // 30 AS r, i % 30 AS c FROM range(900) g(i)), q AS (SELECT r, c, CAST(floor((r + 0.5) * (5000.0::DOUBLE / {_H}) / (5000.0::DOUBLE / 30)) AS INT) AS mr, CAST(floor((c + 0.5) * 200 / (5000.0::DOUBLE / 30)) AS INT) AS mc, nir FROM pixels), m AS (SELECT r, c, CASE WHEN (r + c) % 3 = 0 THEN 1 ELSE 2 END AS cls FROM t) SELECT q.r, q.c, {s6('CASE WHEN m.cls = 1 THEN nir END', 'nir')} FROM q LEFT JOIN m ON m.r = mr AND m.c = mc")
def mask_other_grid(spark, sf):
    px = fixtures.pixels(spark, sf)
    other = raster.Header(0, 5000, 5000 / 30, 5000 / 30, 30, 30)
    mask = spark.range(900).select(F.expr("CAST(id DIV 30 AS INT)").alias("r"), F.expr("CAST(id % 30 AS INT)").alias("c"), F.expr("CASE WHEN (id DIV 30 + id % 30) % 3 = 0 THEN 1 ELSE 2 END").alias("cls"))
    moved = raster.mask_on_grid(mask, other, _grid(px))
    return raster.apply_mask(px.select("r", "c", "nir"), moved, ["nir"]).select("r", "c", *r6(nir=F.col("nir")))


@query(f"SELECT s.serial, {s6('p.nir', 'nir')}, round(list_sum(list_transform(p.emb, lambda x: CAST(x AS DOUBLE))), 4) + 0.0 AS emb_sum FROM samples s JOIN pixels p ON p.r = CAST(floor((5000 - northing) / (5000.0::DOUBLE / {_H})) AS INT) AND p.c = CAST(floor(easting / 200) AS INT)")
def chem_bands_embeddings(spark, sf):
    px = fixtures.pixels(spark, sf)
    out = raster.features_at(fixtures.samples(spark, sf), px.select("r", "c", *_BANDS), px.select("r", "c", "emb"), _grid(px))
    total = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("serial", *r6(nir=F.col("nir")), (F.round(total, 4) + F.lit(0.0)).alias("emb_sum"))


@query("SELECT serial, s.site, n.kinds FROM (SELECT serial, site FROM samples WHERE p > 0.03) s LEFT JOIN (SELECT site, count(DISTINCT type) AS kinds FROM samples WHERE type <> 'Background' GROUP BY site) n USING (site)")
def sample_meta(spark, sf):
    df = fixtures.samples(spark, sf)
    meta = df.where(~samples.is_background()).groupBy("site").agg(F.countDistinct("type").alias("kinds"))
    return samples.attach(df.where("p > 0.03").select("serial", "site"), meta, "site", ["kinds"]).select("serial", "site", "kinds")


@query("SELECT r, c, CASE WHEN blue < 0 THEN 0 WHEN nir > red THEN 1 ELSE 2 END AS cls FROM pixels")
def classify_raster(spark, sf):
    px = fixtures.pixels(spark, sf).select("r", "c", F.when(F.col("blue") >= 0, F.col("blue")).alias("blue"), "red", "nir")
    return raster.classify_raster(px, lambda ok: ok.withColumn("prediction", F.when(F.col("nir") > F.col("red"), 1).otherwise(2)), ["blue", "red", "nir"])


@query(f"SELECT r, c, {s6('(blue + green + red + nir) / 4', 'y_pred')}, {s6('greatest(blue, green, red, nir) - least(blue, green, red, nir)', 'uncertainty')} FROM pixels")
def score_quantiles(spark, sf):
    px = fixtures.pixels(spark, sf).select("r", "c", "blue", "green", "red", "nir")
    out = learning.score_quantiles(px, learning.RowSpread, ["blue", "green", "red", "nir"])
    return out.select("r", "c", *r6(y_pred=F.col("y_pred"), uncertainty=F.col("uncertainty")))


@query(f"px AS (SELECT r, c, {', '.join(f'({b} + 1) / 2 AS {b}' for b in _BANDS)} FROM pixels) SELECT r, c, {', '.join(s6(e, n) for n, e in _PLAIN.items())} FROM px")
def index_gating(spark, sf):
    """Indices by a sensor's table of bands, found by a prefix of its name; an unknown sensor gets none."""
    names = indices.sensor_bands("fused_spot_s2_2024")
    own = {n: (F.col({"nir_narrow": "nir"}.get(role, role)) + 1) / 2 for role, n in names.items()}
    px = fixtures.pixels(spark, sf).select("r", "c", *[v.alias(n) for n, v in own.items()])
    out = indices.with_indices(indices.with_indices(px, "another sensor"), "fused_spot_s2_2024")
    return out.select("r", "c", *r6(**{n: F.col(n) for n in _PLAIN}))


@query()
def fuse_rasters(spark, sf):
    px = fixtures.pixels(spark, sf)
    coarse = _grid(px)
    fine = raster.Header(0, 5000, 100, coarse.dy / 2, coarse.height * 2, 50)
    pan = raster.resample_nearest(px.select("r", "c", ((F.col("red") + 1) / 2).alias("SPOT_red")), ["SPOT_red"], coarse, fine)
    return raster.fuse(pan, fine, px.select("r", "c", ((F.col("nir") + 1) / 2).alias("S2_nir")), coarse, {"S2_nir": "SPOT_red"})


@query("SELECT serial, easting + 400000 AS easting, northing + 2500000 AS northing FROM samples")
def utm_round_trip(spark, sf):
    df = fixtures.samples(spark, sf).select("serial", (F.col("easting") + 400000).alias("easting"), (F.col("northing") + 2500000).alias("northing"))
    out = raster.reproject_points(df, "EPSG:32640", "EPSG:32639")
    return raster.reproject_points(out, "EPSG:32639", "EPSG:32640").select("serial", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


# --- metrics ------------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS n, {s6('1 - sum(power(y_pred - y_true, 2)) / (var_pop(y_true) * count(*))', 'r2')}, {s6('sqrt(avg(power(y_pred - y_true, 2)))', 'rmse')}, {s6('avg(abs(y_pred - y_true))', 'mae')}, {s6('corr(y_true, y_pred)', 'pearson')} FROM pairs")
def regression_metrics(spark, sf):
    out = metrics.regression_metrics(fixtures.pairs(spark, sf))
    return out.select("n", *r6(**{k: F.col(k) for k in ("r2", "rmse", "mae", "pearson")}))


@query(f"SELECT {s6('avg(abs(y_pred - y_true) / abs(y_true))', 'mape')} FROM pairs WHERE abs(y_true) > 0.001")
def mape(spark, sf):
    return metrics.regression_metrics(fixtures.pairs(spark, sf).where("abs(y_true) > 0.001")).select(*r6(mape=F.col("mape")))


@query(f"SELECT {s6('ln(avg(abs(y_pred - y_true) / greatest(abs(y_true), 2.220446049250313e-16)))', 'ln_mape')} FROM pairs")
def mape_all_rows(spark, sf):
    # beside mape, whose SQL leaves out truths near zero; these decide the value, so its logarithm is compared
    return metrics.regression_metrics(fixtures.pairs(spark, sf)).select(*r6(ln_mape=F.ln("mape")))


_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in ("y_true", "y_pred"))


@query(f"q AS (SELECT {_RANKED} FROM pairs) SELECT {s6('corr(y_true, y_pred)', 'spearman')} FROM q")
def spearman(spark, sf):
    return metrics.spearman(fixtures.pairs(spark, sf)).select(*r6(spearman=F.col("spearman")))


_CELLS = "x AS (SELECT CAST(count(*) FILTER (y_true > 0 AND y_pred > 0) AS DOUBLE) AS tp, CAST(count(*) FILTER (y_true > 0 AND y_pred <= 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y_true <= 0 AND y_pred > 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_true <= 0 AND y_pred <= 0) AS DOUBLE) AS tn FROM pairs), y AS (SELECT *, tp + fn AS pos, fp + tn AS neg, tp + fn + fp + tn AS n, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / power(tp + fn + fp + tn, 2) AS pe FROM x)"


@query(f"{_CELLS} SELECT CAST(pos AS BIGINT) AS n_elevated, CAST(neg AS BIGINT) AS n_depleted, {s6('(tp + tn) / n', 'accuracy')}, {s6('(tp / pos + tn / neg) / 2', 'balanced_acc')}, {s6('(tp * tn - fp * fn) / sqrt(pos * neg * (tp + fp) * (fn + tn))', 'mcc')}, {s6('((tp + tn) / n - pe) / (1 - pe)', 'kappa')}, {s6('2 * tp / (2 * tp + fp + fn)', 'f1')}, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM y")
def agreement_metrics(spark, sf):
    out = metrics.agreement_metrics(fixtures.pairs(spark, sf))
    floats = ("accuracy", "balanced_acc", "mcc", "kappa", "f1")
    return out.select("n_elevated", "n_depleted", *r6(**{k: F.col(k) for k in floats}), "tn", "fp", "fn", "tp")


@query(f"q AS (SELECT y_true > 0 AS pos, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS k FROM pairs) SELECT {s6('(sum(k) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * CAST(count(*) FILTER (NOT pos) AS DOUBLE))', 'auc')} FROM q")
def auc_rank(spark, sf):
    return metrics.auc(fixtures.pairs(spark, sf), F.col("y_true") > 0).select(*r6(auc=F.col("auc")))


@query(f"g AS (SELECT round(y_pred, 1) AS threshold, CAST(count(*) FILTER (y_true > 0) AS DOUBLE) AS p, CAST(count(*) FILTER (y_true <= 0) AS DOUBLE) AS n FROM pairs GROUP BY 1) SELECT {s6('threshold', 'threshold')}, {s6('sum(n) OVER (ORDER BY threshold DESC) / sum(n) OVER ()', 'fpr')}, {s6('sum(p) OVER (ORDER BY threshold DESC) / sum(p) OVER ()', 'tpr')} FROM g")
def roc_curve(spark, sf):
    df = fixtures.pairs(spark, sf).withColumn("y_pred", F.round("y_pred", 1))
    return metrics.roc_curve(df, F.col("y_true") > 0).select(*r6(threshold=F.col("threshold"), fpr=F.col("fpr"), tpr=F.col("tpr")))


@query("SELECT y_true > 0 AS truth, y_pred > 0 AS predicted, count(*) AS n FROM pairs GROUP BY 1, 2")
def confusion_matrix(spark, sf):
    return metrics.confusion(fixtures.pairs(spark, sf), F.col("y_true") > 0, F.col("y_pred") > 0)


@query(f"c AS (SELECT label AS t, cls + (label % 2) AS q FROM pixels), s AS (SELECT t AS cls, count(*) AS support, count(*) FILTER (t = q) AS hit FROM c GROUP BY t), k AS (SELECT q AS cls, count(*) AS called FROM c GROUP BY q), j AS (SELECT cls, coalesce(support, 0) AS support, coalesce(hit / CAST(called AS DOUBLE), 0) AS p, coalesce(hit / CAST(support AS DOUBLE), 0) AS rc FROM s FULL JOIN k USING (cls)) SELECT cls, {s6('p', 'precision')}, {s6('rc', 'recall')}, {s6('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END', 'f1')}, support FROM j")
def classification_report(spark, sf):
    df = fixtures.pixels(spark, sf).select(F.col("label").alias("t"), (F.col("cls") + F.col("label") % 2).alias("q"))
    out = metrics.classification_report(df, "t", "q")
    return out.select("cls", *r6(precision=F.col("precision"), recall=F.col("recall"), f1=F.col("f1")), "support")


_BINS = "k AS (SELECT *, row_number() OVER (ORDER BY y_pred, serial) AS rn, count(*) OVER () AS n FROM pairs), b AS (SELECT *, CAST(least(5, greatest(1, ceil((rn - 1) * 5 / CAST(n - 1 AS DOUBLE)))) AS INT) AS bin FROM k)"


@query(f"{_BINS} SELECT bin, {s6('avg(y_true)', 'mean')}, {s6('stddev_samp(y_true) / sqrt(count(*))', 'sem')}, count(*) AS n FROM b GROUP BY bin")
def quantile_bin_lift(spark, sf):
    out = metrics.bin_summary(metrics.quantile_bins(fixtures.pairs(spark, sf)))
    return out.select("bin", *r6(mean=F.col("mean"), sem=F.col("sem")), "n")


@query(f"k AS (SELECT y_true > 0 AS pos, row_number() OVER (ORDER BY y_pred DESC, serial) AS rn, greatest(1, CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT)) AS k FROM pairs) SELECT max(k) AS k, {s6('avg(CAST(pos AS DOUBLE)) FILTER (rn <= k)', 'hit')}, {s6('avg(CAST(pos AS DOUBLE))', 'base')}, {s6('avg(CAST(pos AS DOUBLE)) FILTER (rn <= k) / avg(CAST(pos AS DOUBLE))', 'lift')} FROM k")
def top_fraction_lift(spark, sf):
    out = metrics.top_fraction(fixtures.pairs(spark, sf), F.col("y_true") > 0)
    return out.select("k", *r6(hit=F.col("hit"), base=F.col("base"), lift=F.col("lift")))


@query(f"SELECT site, count(*) AS n, {s6('avg(y_true)', 'mean_true')}, {s6('avg(y_pred)', 'mean_pred')} FROM pairs GROUP BY site")
def site_rollup(spark, sf):
    return metrics.site_rollup(fixtures.pairs(spark, sf)).select("site", "n", *r6(mean_true=F.col("mean_true"), mean_pred=F.col("mean_pred")))


_FOLD = "f AS (SELECT site, 1 - sum(power(y_pred - y_true, 2)) / nullif(var_pop(y_true) * count(*), 0) AS r2 FROM pairs GROUP BY site HAVING var_pop(y_true) > 0)"


@query(f"{_FOLD} SELECT {s6('quantile_cont(r2, 0.5)', 'median')}, {s6('quantile_cont(r2, 0.25)', 'q25')}, {s6('quantile_cont(r2, 0.75)', 'q75')}, {s6('avg(r2)', 'mean')}, {s6('stddev_samp(r2)', 'std')}, {s6('stddev_pop(r2)', 'std_pop')}, {s6('min(r2)', 'lo')}, {s6('max(r2)', 'hi')} FROM f")
def fold_quantiles(spark, sf):
    out = metrics.spread(metrics.group_r2(fixtures.pairs(spark, sf), "site"), "r2")
    return out.select(*r6(**{c: F.col(c) for c in out.columns}))


@query(f"SELECT cls, count(*) AS n, {s6('sum(count(*)) OVER () / (count(*) OVER () * CAST(count(*) AS DOUBLE))', 'weight')} FROM pixels GROUP BY cls")
def class_weights(spark, sf):
    return metrics.class_weights(fixtures.pixels(spark, sf), "cls").select("cls", "n", *r6(weight=F.col("weight")))


@query("k AS (SELECT r, c, cls, row_number() OVER (PARTITION BY cls ORDER BY (r * 7919 + c * 104729) % 10007, r, c) AS k FROM pixels) SELECT r, c, cls FROM k WHERE k <= (SELECT count(*) FROM pixels WHERE cls = 2) OR cls = 2")
def downsample_cap(spark, sf):
    order = [F.expr("(r * 7919 + c * 104729) % 10007"), F.col("r"), F.col("c")]
    return metrics.downsample(fixtures.pixels(spark, sf).select("r", "c", "cls"), "cls", 2, order)


@query("SELECT site, CAST(dense_rank() OVER (ORDER BY site) - 1 AS INT) AS fold FROM (SELECT DISTINCT site FROM samples)")
def logo_folds(spark, sf):
    return metrics.group_ids(fixtures.samples(spark, sf), "site").select("site", F.col("fold").cast("int").alias("fold"))


@query("k AS (SELECT serial, type, row_number() OVER (PARTITION BY type ORDER BY (serial * 7919) % 10007, serial) AS k, count(*) OVER (PARTITION BY type) AS n FROM pairs) SELECT serial, type, n > 1 AND k <= greatest(1, round_even(n * 0.2, 0)) AS is_test FROM k")
def stratified_split(spark, sf):
    df = fixtures.pairs(spark, sf).select("serial", "type")
    return metrics.stratified_split(df, "type", [F.expr("(serial * 7919) % 10007"), F.col("serial")])


@query("""RECURSIVE z AS (SELECT row_number() OVER (ORDER BY n DESC, site) AS k, n FROM (SELECT site, count(*) AS n FROM samples GROUP BY site)),
g AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load UNION ALL
      SELECT z.k, list_transform(range(1, 6), lambda i: load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN z.n ELSE 0 END) FROM g JOIN z ON z.k = g.k + 1)
SELECT CAST(i - 1 AS INT) AS fold, load[i] AS n FROM g, range(1, 6) t(i) WHERE k = (SELECT max(k) FROM z)""")
def groupkfold_sizes(spark, sf):
    return metrics.with_folds(fixtures.samples(spark, sf).select("serial", "site"), "site", 5).groupBy("fold").agg(F.count("*").alias("n"))


@query(f"""s AS (SELECT row_number() OVER (ORDER BY site) AS pick, avg(y_true) AS y, avg(y_pred) AS p FROM pairs GROUP BY site), m AS (SELECT count(*) AS n FROM s),
t AS (SELECT b, CAST('0x' || substr(md5(concat('42:', b, ':', j)), 1, 8) AS BIGINT) % n + 1 AS pick FROM m, range(1, 2001) x(b), range(1, n + 1) z(j)),
r AS (SELECT corr(y, p) AS r FROM t JOIN s USING (pick) GROUP BY b)
SELECT {s6('quantile_cont(r, 0.025)', 'lo')}, {s6('quantile_cont(r, 0.975)', 'hi')}, count(*) AS n FROM r WHERE isfinite(r)""")
def bootstrap_ci(spark, sf):
    out = metrics.bootstrap_ci(metrics.site_rollup(fixtures.pairs(spark, sf)).select("site", "mean_true", "mean_pred"))
    return out.select(*r6(lo=F.col("lo"), hi=F.col("hi")), "n")


_NUM = "(serial * 7919) % 10007"


@query(f"SELECT serial, CAST((row_number() OVER (ORDER BY {_NUM}, serial) - 1) % 5 AS INT) AS fold FROM pairs")
def kfold_shuffled(spark, sf):
    return metrics.shuffled_folds(fixtures.pairs(spark, sf), 5, [F.expr(_NUM), F.col("serial")]).select("serial", "fold")


@query(f"SELECT serial, type, CAST((row_number() OVER (PARTITION BY type ORDER BY {_NUM}, serial) - 1) % 3 AS INT) AS fold FROM pairs")
def kfold_stratified(spark, sf):
    return metrics.shuffled_folds(fixtures.pairs(spark, sf), 3, [F.expr(_NUM), F.col("serial")], "type").select("serial", "type", "fold")


@query(f"""q AS (SELECT y_true > 0 AS pos, {_RANKED}, row_number() OVER (ORDER BY y_pred DESC, serial) AS rn, greatest(1, CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT)) AS k FROM pairs)
SELECT {s6('corr(y_true, y_pred)', 'spearman')}, {s6('(sum(y_pred) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * CAST(count(*) FILTER (NOT pos) AS DOUBLE))', 'auc')}, max(k) AS k,
{s6('avg(CAST(pos AS DOUBLE)) FILTER (rn <= k)', 'hit')}, {s6('avg(CAST(pos AS DOUBLE))', 'base')}, {s6('avg(CAST(pos AS DOUBLE)) FILTER (rn <= k) / avg(CAST(pos AS DOUBLE))', 'lift')} FROM q""")
def summary_table(spark, sf):
    out = metrics.summary(fixtures.pairs(spark, sf), F.col("y_true") > 0)
    return out.select("k", *r6(**{c: F.col(c) for c in ("spearman", "auc", "hit", "base", "lift")}))


@query(f"""e AS (SELECT min(y_true) AS lo, max(y_true) AS hi, count(*) AS n FROM pairs), b AS (SELECT least(CAST(floor((y_true - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, lo, (hi - lo) / 50 AS w, n FROM pairs, e)
SELECT bin, {s6('any_value(lo) + (bin + 0.5) * any_value(w)', 'x')}, {s6('count(*) / CAST(any_value(n) AS DOUBLE) / any_value(w)', 'density')} FROM b GROUP BY bin""")
def density_table(spark, sf):
    return groups.density(fixtures.pairs(spark, sf), "y_true").select("bin", *r6(x=F.col("x"), density=F.col("density")))


# --- sources and sinks: written, read again, and held against the table they came from ------------------------------------


@query(f"SELECT site, {s6('avg(easting)', 'x')}, {s6('avg(northing)', 'y')}, count(*) AS n FROM samples GROUP BY site")
def geojson_scan(spark, sf):
    path = scratch(spark, "geojson")
    sites = fixtures.samples(spark, sf).groupBy("site").agg(F.avg("easting").alias("px"), F.avg("northing").alias("py"), F.count("*").alias("n"))
    writers.geojson(sites, path, "px", "py")
    return readers.geojson(spark, path).select("site", *r6(x=F.col("x"), y=F.col("y")), "n")


@query("SELECT r, c, round(CAST(CAST(nir AS FLOAT) AS DOUBLE), 6) + 0.0 AS nir, round(CAST(CAST(red AS FLOAT) AS DOUBLE), 6) + 0.0 AS red FROM pixels")
def geotiff_round_trip(spark, sf):
    path = scratch(spark, "geotiff").removeprefix("file://")
    px = fixtures.pixels(spark, sf)
    geotiff.write(px.select("r", "c", "nir", "red"), path, _grid(px), ["nir", "red"])
    # a file has every place of its square: those of the table are kept
    out = geotiff.read(spark, path, ["nir", "red"], grid=_grid(px)).join(px.select("r", "c"), ["r", "c"], "left_semi")
    return out.select("r", "c", *r6(nir=F.col("nir"), red=F.col("red")))


@query("SELECT r, c, r // 8 AS tile_r, c // 8 AS tile_c, " + s6("nir", "nir") + " FROM pixels")
def tiles_sink(spark, sf):
    path = scratch(spark, "tiles")
    writers.tiles(fixtures.pixels(spark, sf).select("r", "c", "nir"), path, 8)
    return spark.read.parquet(path).select("r", "c", "tile_r", "tile_c", *r6(nir=F.col("nir")))


@query("SELECT r, c, r // 1024 AS block, round(CAST(CAST(nir AS FLOAT) AS DOUBLE), 6) + 0.0 AS pred, round(CAST(CAST(red * red AS FLOAT) AS DOUBLE), 6) + 0.0 AS uncertainty FROM pixels")
def prediction_sink(spark, sf):
    path = scratch(spark, "prediction")
    writers.prediction(fixtures.pixels(spark, sf).select("r", "c", F.col("nir").alias("pred"), (F.col("red") * F.col("red")).alias("uncertainty")), path, ["pred", "uncertainty"])
    out = spark.read.parquet(path)
    return out.select("r", "c", "block", *r6(**{c: F.col(c).cast("double") for c in ("pred", "uncertainty")}))


@query("SELECT r, c, r // 4 AS block, cls FROM pixels WHERE cls <> 0")
def mask_sink(spark, sf):
    path = scratch(spark, "mask")
    writers.row_blocks(fixtures.pixels(spark, sf).where("cls <> 0").select("r", "c", "cls"), path, 4)
    return spark.read.parquet(path).select("r", "c", "block", "cls")


_RATIOS = {"NDVI": _GUARDED["NDVI"], "BSI": _GUARDED["BSI"]}


@query(f"v AS ({' UNION ALL '.join(f"SELECT '{n}' AS index, r, c, CAST(CAST({e} AS FLOAT) AS DOUBLE) AS value FROM pixels" for n, e in _RATIOS.items())}) SELECT index, r, c, round(value, 5) + 0.0 AS value FROM v")
def index_sink(spark, sf):
    path = scratch(spark, "indices")
    own = indices.guarded_indices(_bands())
    writers.indices(fixtures.pixels(spark, sf).select("r", "c", *[own[n].alias(n) for n in _RATIOS]), path, list(_RATIOS))
    return spark.read.parquet(path).select("index", "r", "c", *r6(5, value=F.col("value").cast("double")))


@query("SELECT site, CAST(count(*) AS VARCHAR) AS n FROM samples GROUP BY site")
def metrics_csv(spark, sf):
    path = scratch(spark, "metrics")
    if readers.metrics_or_none(spark, path) is not None:
        raise ValueError("a new path holds metrics")
    writers.metrics_csv(fixtures.samples(spark, sf).groupBy("site").agg(F.count("*").alias("n")), path)
    return readers.metrics_or_none(spark, path)


@query("SELECT count(*) AS rows, 'ridge' AS model, '2024-05-01T00:00:00' AS at FROM samples")
def run_metadata(spark, sf):
    path = scratch(spark, "run")
    writers.run_metadata(spark, path, {"model": "ridge", "rows": fixtures.samples(spark, sf).count(), "at": "2024-05-01T00:00:00"})
    return spark.read.text(path).select(F.from_json("value", "rows bigint, model string, at string").alias("x")).select("x.*")


_ASSETS = {"assets": {"image": {"eo:bands": [{"name": "B1", "common_name": "blue"}, {"name": "B2", "common_name": "red"}, {"name": "B3", "common_name": "red"}]}}}


@query("SELECT * FROM (VALUES ('name', 'B1', 0), ('name', 'B2', 1), ('name', 'B3', 2), ('alias', 'B1', 0), ('alias', 'B2', 1), ('alias', 'B3', 2), ('absent', 'Band_1', 0), ('absent', 'Band_2', 1), ('length', 'Band_1', 0), ('common', 'blue', 0), ('common', 'red', 2)) t(kind, name, place)")
def band_metadata(spark, sf):
    path, absent = scratch(spark, "bands"), scratch(spark, "none")
    writers.text(spark, path, json.dumps(_ASSETS))
    found = {"name": readers.band_names(spark, path, 3), "alias": readers.band_names(spark, absent, 3, (path,)), "absent": readers.band_names(spark, absent, 2), "length": readers.band_names(spark, path, 1)}
    rows = [(k, n, i) for k, names in found.items() for i, n in enumerate(names)] + [("common", n, i) for n, i in readers.band_index(spark, path).items()]
    return spark.createDataFrame(rows, "kind string, name string, place int")


@query("SELECT CASE label % 3 WHEN 0 THEN 2 ELSE 1 END AS cls, CASE label % 3 WHEN 0 THEN 'bare' ELSE 'other' END AS name, count(*) AS n FROM pixels GROUP BY 1, 2")
def class_remap_file(spark, sf):
    path = scratch(spark, "remap")
    writers.text(spark, path, json.dumps({"reference_class": 2, "remap": {str(i): 2 if i % 3 == 0 else 1 for i in range(10)}, "class_names": {"1": "other", "2": "bare"}}))
    table, reference, names = readers.class_remap(spark, path)
    out = fixtures.pixels(spark, sf).groupBy(samples.remap(F.col("label"), table).alias("cls")).agg(F.count("*").alias("n"))
    return out.select("cls", F.when(F.col("cls") == reference, names[2]).otherwise(names[1]).alias("name"), "n")


@query(f"SELECT serial, p < 0.05 AS p_below, k < 0.03 AS k_below, {s6('si * 0.4674', 'Si')}, {s6('al * 0.5293', 'Al')} FROM samples")
def limits_and_oxides(spark, sf):
    limits, factors = scratch(spark, "lod"), scratch(spark, "oxides")
    writers.text(spark, limits, json.dumps({"p": 0.05, "k": 0.03, "zr": None}))
    writers.text(spark, factors, json.dumps([{"Oxide": "SiO2", "Element": "Si", "Factor": 0.4674}, {"Oxide": "Al2O3", "Element": "Al", "Factor": 0.5293}]))
    df = samples.lod_flags(fixtures.samples(spark, sf), readers.lod_table(spark, limits))
    df = df.select("serial", "p_below", "k_below", F.col("si").alias("SiO2"), F.col("al").alias("Al2O3"))
    out = samples.oxides_to_elements(df, readers.oxide_table(spark, factors))
    return out.select("serial", "p_below", "k_below", *r6(Si=F.col("Si"), Al=F.col("Al")))


@query("SELECT r, c, " + ", ".join(f"emb[{i + 1}] AS Emb_A{i:02d}" for i in range(64)) + " FROM pixels")
def embedding_scan(spark, sf):
    path = scratch(spark, "embeddings")
    fixtures.pixels(spark, sf).select("r", "c", F.col("emb").alias("embedding")).write.parquet(path)
    return readers.embeddings(spark, path)


# --- names, dates, small operators -----------------------------------------------------------------------------------------


@query("SELECT serial, coalesce(CASE WHEN site IN ('1', '2') THEN NULL ELSE type END, 'CORRAL') AS type FROM samples")
def fill_type(spark, sf):
    df = fixtures.samples(spark, sf).withColumn("type", F.when(F.col("site").isin("1", "2"), F.lit(None)).otherwise(F.col("type")))
    return samples.fill_type(df, "CORRAL").select("serial", "type")


@query("SELECT * FROM (VALUES ('background', 'Elevation,Mg,P,Res,is_imputed'), ('raster', 'Mg,N,P,Res'), ('validation', 'Elevation,Mg,N,P'), ('groups', 'Elevation,Mg,N,P,Res'), ('triples', 'Mg,N,P,Res'), ('lithogenic', 'Mg,N')) t(mode, parts)")
def part_detection(spark, sf):
    df = spark.createDataFrame([], "Serial string, Site string, Type string, Easting double, Northing double, Longitude double, Latitude double, Elevation double, is_imputed bigint, Mg double, P double, N int, Res double")
    return spark.createDataFrame([(m, ",".join(sorted(samples.detect_parts(df, m)))) for m in samples.EXCLUDED], "mode string, parts string")


@query(f"SELECT serial, {s6('CASE WHEN p > 0 THEN ln(k / p) END', 'v')} FROM samples WHERE p > 0 AND k > 0")
def infinite_dropped(spark, sf):
    df = fixtures.samples(spark, sf).withColumn("v", F.when(F.col("k") > 0, F.ln("k")).otherwise(F.lit(float("-inf"))) - F.when(F.col("p") > 0, F.ln("p")).otherwise(F.lit(float("-inf"))))
    return df.select("serial", samples.finite_or_null(F.col("v")).alias("v")).where("v IS NOT NULL").select("serial", *r6(v=F.col("v")))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug, CAST(split_part(p_partkey || '.7', '.', 1) AS BIGINT) AS parent FROM part")
def name_functions(spark, sf):
    df = fixtures.table(spark, sf, "part")
    parent = F.split(F.concat(F.col("p_partkey").cast("string"), F.lit(".7")), r"\.")[0].cast("bigint")
    return df.select("p_partkey", text.slug(F.col("p_name")).alias("slug"), parent.alias("parent"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995")
def year_range(spark, sf):
    df = fixtures.table(spark, sf, "orders").where(text.in_years(F.col("o_orderdate"), 1994, 1995))
    return df.select("o_orderkey", text.iso_timestamp(F.col("o_orderdate")).alias("at"))


@query("n AS (SELECT r_name AS a FROM region) SELECT 2 AS size, x.a || ',' || y.a AS members FROM n x JOIN n y ON x.a < y.a UNION ALL SELECT 3, x.a || ',' || y.a || ',' || z.a FROM n x JOIN n y ON x.a < y.a JOIN n z ON y.a < z.a")
def combinations(spark, sf):
    out = groups.combination_table(fixtures.table(spark, sf, "region").select("r_name"), "r_name", 2, 3)
    return out.select("size", text.joined(F.col("members")).alias("members"))


@query(f"{_SPEAR} SELECT part_i, part_j, round(rho, 3) + 0.0 AS rho FROM c WHERE abs(rho) > 0.05 ORDER BY abs(rho) DESC LIMIT 3")
def strongest_pairs(spark, sf):
    df = fixtures.samples(spark, sf).where(samples.is_background())
    return groups.strong_pairs(groups.clr_spearman(df, X), 0.05).limit(3).select("part_i", "part_j", (F.round("rho", 3) + F.lit(0.0)).alias("rho"))


@query("SELECT site, type, serial FROM samples ORDER BY site, type, serial LIMIT 25")
def sorted_head(spark, sf):
    return fixtures.samples(spark, sf).select("site", "type", "serial").orderBy("site", "type", "serial").limit(25)


@query("i AS (SELECT p_partkey AS k, 'f' || p_partkey AS feature, ((p_partkey * 7919) % 1009) / 1000.0 - 0.4 AS mean FROM part WHERE p_partkey <= 60) SELECT feature FROM i WHERE mean > 0 ORDER BY mean DESC, feature LIMIT (SELECT greatest(5, CAST(ceil(count(*) * 0.25) AS INT)) FROM i WHERE mean > 0)")
def kept_features(spark, sf):
    k = fixtures.table(spark, sf, "part").where("p_partkey <= 60").select("p_partkey")  # sixty features, whatever the scale
    importance = k.select(F.concat(F.lit("f"), "p_partkey").alias("feature"), (((F.col("p_partkey") * 7919) % 1009) / 1000.0 - 0.4).alias("mean"))
    return spark.createDataFrame([(f,) for f in learning.keep_features(importance, 0.25)], "feature string")


_CLOSE3 = [f"{p} / (si + al + p)" for p in ("al", "p", "si")]


@query(f"""{FIXED}, v AS (SELECT serial, type, easting, 'validation' AS origin, si, al, p FROM fixed WHERE site IN ('1', '2', '3')
UNION ALL SELECT serial, type, easting, 'training', si, al, p FROM fixed WHERE site NOT IN ('1', '2', '3') AND type = 'Background')
SELECT serial, type, origin, easting AS Easting, CAST(NULL AS DOUBLE) AS Northing, {', '.join(s6(e, f'c{i + 1}') for i, e in enumerate(_CLOSE3))} FROM v""")
def validation_alignment(spark, sf):
    df = fixed(spark, sf).withColumnRenamed("easting", "Easting").drop("northing")
    near = F.col("site").isin("1", "2", "3")
    training = df.where(~near).withColumn("Northing", F.lit(None).cast("double"))
    out, shared = samples.align_for_validation(training, df.where(near).drop("k"), columns=("serial",), places=("Easting", "Northing"))
    return out.select("serial", "type", "origin", "Easting", "Northing", *named("c", [F.col(c) for c in shared]))


# --- models -------------------------------------------------------------------------------------------------------------


@query(f"a AS (SELECT covar_pop(si, si) * count(*) + 1 AS xx, covar_pop(al, al) * count(*) + 1 AS yy, covar_pop(si, al) * count(*) AS xy, covar_pop(si, p) * count(*) AS xt, covar_pop(al, p) * count(*) AS yt, avg(si) AS mx, avg(al) AS my, avg(p) AS mt FROM samples), w AS (SELECT (xt * yy - yt * xy) / (xx * yy - xy * xy) AS w1, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS w2, * FROM a) SELECT {s6('w1', 'w1')}, {s6('w2', 'w2')}, {s6('mt - w1 * mx - w2 * my', 'intercept')} FROM w")
def ridge_closed_form(spark, sf):
    w, b = learning.ridge(fixtures.samples(spark, sf), ["si", "al"], "p")
    return spark.createDataFrame([(*w, b)], "w1 double, w2 double, intercept double").select(*r6(w1=F.col("w1"), w2=F.col("w2"), intercept=F.col("intercept")))


def _ridge_sql(name: str, where: str) -> str:
    """Closed form of the ridge regression of p on si and al over some rows, as a table of one row."""
    sums = "covar_pop(si, si) * count(*) + 1 AS xx, covar_pop(al, al) * count(*) + 1 AS yy, covar_pop(si, al) * count(*) AS xy, covar_pop(si, p) * count(*) AS xt, covar_pop(al, p) * count(*) AS yt, avg(si) AS mx, avg(al) AS my, avg(p) AS mt"
    return f"a_{name} AS (SELECT {sums} FROM parted WHERE {where}), {name} AS (SELECT w1, w2, mt - w1 * mx - w2 * my AS w0 FROM (SELECT (xt * yy - yt * xy) / (xx * yy - xy * xy) AS w1, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS w2, mx, my, mt FROM a_{name}))"


_PARTED = "parted AS (SELECT *, CAST(site AS INT) % 3 AS fold FROM samples)"


@query(f"{_PARTED}, {', '.join(_ridge_sql(f'w{k}', f'fold <> {k}') for k in range(3))}, o AS ({' UNION ALL '.join(f'SELECT serial, fold, w1 * si + w2 * al + w0 AS y_pred FROM parted, w{k} WHERE fold = {k}' for k in range(3))}) SELECT serial, fold, {s6('y_pred', 'y_pred')} FROM o")
def ridge_out_of_fold(spark, sf):
    df = fixtures.samples(spark, sf).withColumn("fold", F.col("site").cast("int") % 3)
    return learning.out_of_fold(df, learning.ridge_model(["si", "al"], "p")).select("serial", "fold", *r6(y_pred=F.col("y_pred")))


@query(f"{_PARTED}, {_ridge_sql('tr', 'fold > 0')}, {_ridge_sql('fin', 'TRUE')} SELECT serial, {s6('tr.w1 * si + tr.w2 * al + tr.w0', 'y_pred')}, {s6('fin.w1 * si + fin.w2 * al + fin.w0', 'y_last')} FROM parted, tr, fin WHERE fold = 0")
def train_test_refit(spark, sf):
    df = fixtures.samples(spark, sf)
    held = F.col("site").cast("int") % 3 == 0
    out, last = learning.fit_and_refit(df.where(~held), df.where(held), learning.ridge_model(["si", "al"], "p"))
    out = last.transform(out.withColumnRenamed("y_pred", "first")).select("serial", F.col("first").alias("y_pred"), F.col("y_pred").alias("y_last"))
    return out.select("serial", *r6(y_pred=F.col("y_pred"), y_last=F.col("y_last")))


_V4 = ["blue", "green", "red", "nir"]
_SD = " + ".join(f"power(a.{b} - b.{b}, 2)" for b in _V4)


@query(f"m AS (SELECT a.r, a.c, a.cls AS c1, b.cls AS c2, avg(sqrt({_SD})) AS m FROM pixels a JOIN pixels b ON (a.r, a.c) <> (b.r, b.c) GROUP BY a.r, a.c, a.cls, b.cls), s AS (SELECT r, c, c1, min(m) FILTER (c1 = c2) AS a, min(m) FILTER (c1 <> c2) AS b FROM m GROUP BY r, c, c1) SELECT c1 AS cls, {s6('avg((b - a) / greatest(a, b))', 'silhouette')}, count(*) AS n FROM s GROUP BY c1")
def silhouette_exact(spark, sf):
    # the whole raster; the SQL compares 20 rows of pixels, which is all there are on sf0.001 and sf0.01
    px = fixtures.pixels(spark, sf).withColumn("key", F.col("r") * 25 + F.col("c"))
    return learning.silhouette(px, _V4, "cls", "key").select("cls", *r6(silhouette=F.col("silhouette")), "n")


_XY = ["blue", "green", "red", "rededge", "swir1"]


@query()
def gbt_oof(spark, sf):
    px = fixtures.pixels(spark, sf).select("r", "c", *_XY, "nir").withColumn("fold", F.col("r") % 3)
    out = learning.out_of_fold(px, learning.boosted(_XY, "nir", maxIter=8, maxDepth=3))
    return out.select("r", "c", "fold", *r6(y_pred=F.col("y_pred")))


@query()
def strict_leave_site_out(spark, sf):
    def target(variation):
        found = groups.groups_from_variation(variation, X, 0.95)
        return found["markers"] or ["p"], found["background"]

    out = learning.leave_site_out(fixed(spark, sf), X, ["easting", "northing"], "site", target)
    return out.groupBy("site", "markers", "fallback").agg(F.count("*").alias("n"), *r6(y_true=F.avg("y_true"), y_pred=F.avg("y_pred"), threshold=F.first("threshold")))


@query()
def marker_stability(spark, sf):
    """How many folds derive the markers that all sites together give."""
    found = groups.compositional_groups(fixed(spark, sf), X, 0.95)
    folds = strict_leave_site_out(spark, sf).select("markers", "fallback")
    return learning.marker_stability(folds, found["markers"] or ["p"])


@query()
def boosting_rounds(spark, sf):
    px = fixtures.pixels(spark, sf).select(*_XY, "nir", (F.col("r") % 3).alias("fold"))
    rounds, best = learning.boosted_rounds(px, _XY, "nir", "fold", 12, maxDepth=3)
    return spark.createDataFrame([(rounds, best)], "rounds int, best array<int>")


@query()
def regressor_search(spark, sf):
    px = fixtures.pixels(spark, sf).select(*_XY, "nir", (F.col("r") % 3).alias("fold"))
    space = {"maxDepth": [2, 3], "stepSize": [0.1, 0.3]}
    best, score = learning.random_search(px, space, lambda **k: learning.boosted(_XY, "nir", maxIter=4, **k), lambda out: learning.mean_fold_r2(out, "nir"), 2)
    return spark.createDataFrame([(str(sorted(best.items())), score)], "setting string, score double")


@query()
def classifier_search(spark, sf):
    px = fixtures.pixels(spark, sf).where("cls <> 0").select("cls", *_V4, (F.col("r") % 3).alias("fold"))
    best, score = learning.search_classifier(px, _V4, "cls", "fold", {"numTrees": [5, 10], "maxDepth": [3, 5]}, 2)
    return spark.createDataFrame([(str(sorted(best.items())), score)], "setting string, score double")


@query()
def permutation_importance(spark, sf):
    px = fixtures.pixels(spark, sf).select(*_XY, "nir")
    return learning.permutation_importance(px, learning.boosted(_XY, "nir", maxIter=5, maxDepth=3)(px), _XY, "nir", 5)


@query()
def isolation_forest(spark, sf):
    px = fixtures.pixels(spark, sf).select("r", "c", "cls", *_V4)
    return learning.mark_outliers(px, _V4, "cls").groupBy("cls").agg(F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers"))


@query()
def pca2(spark, sf):
    out, _ = learning.principal_components(fixtures.pixels(spark, sf).select("r", "c", *_XY), _XY)
    return out.select("r", "c", *r6(pc1=F.abs(F.get("pc", F.lit(0))), pc2=F.abs(F.get("pc", F.lit(1)))))


@query()
def kmeans_blocks(spark, sf):
    return learning.block_groups(fixtures.samples(spark, sf).select("serial", "easting", "northing"), "easting", "northing", 5).groupBy("block").agg(F.count("*").alias("n"))


@query()
def forest_classifier(spark, sf):
    px = fixtures.pixels(spark, sf).select("r", "c", "cls", *_V4)
    weighted = px.join(F.broadcast(metrics.class_weights(px, "cls").select("cls", "weight")), "cls")
    model = learning.forest_classifier(weighted, _V4, "cls", "weight", numTrees=10)
    return model.transform(px).groupBy("cls", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query(f"SELECT r, c, {s6('(blue + green + red + nir) / 4', 'y_pred')} FROM pixels WHERE cls = 1")
def score_raster(spark, sf):
    masked = fixtures.pixels(spark, sf).where("cls = 1").select("r", "c", *_V4)  # the mask goes below the scorer
    return learning.score_partitions(masked, learning.RowMean, _V4).select("r", "c", *r6(y_pred=F.col("y_pred")))
