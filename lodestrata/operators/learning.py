"""Models over feature tables: plain regressions from sums, boosted trees, folds, importance, outliers, components."""

from __future__ import annotations

import itertools
import pickle
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, drop, ship


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> tuple[list[float], float]:
    """Coefficients and intercept of an unstandardised ridge regression, from one pass of sums."""
    cols = [*features, target]
    pairs = list(itertools.combinations_with_replacement(cols, 2))
    s = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m {c}") for c in cols], *[F.covar_pop(a, b).alias(f"c {a} {b}") for a, b in pairs]).first()
    n, cov = s["n"], {(a, b): s[f"c {a} {b}"] for a, b in pairs}
    get = lambda a, b: cov.get((a, b), cov.get((b, a)))
    xx = np.array([[get(a, b) * n for b in features] for a in features]) + alpha * np.eye(len(features))
    w = np.linalg.solve(xx, np.array([get(a, target) * n for a in features]))
    return w.tolist(), float(s[f"m {target}"] - sum(w[i] * s[f"m {c}"] for i, c in enumerate(features)))


class LinearModel:
    """What ``transform`` of a fitted pipeline does, for a ridge regression."""

    def __init__(self, features: list[str], weights: list[float], intercept: float):
        self.features, self.weights, self.intercept = features, weights, intercept

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("y_pred", linear(self.features, self.weights, self.intercept))


def ridge_model(features: list[str], target: str, alpha: float = 1.0) -> Callable[[DataFrame], LinearModel]:
    return lambda train: LinearModel(features, *ridge(train, features, target, alpha))


def linear(features: list[str], weights: list[float], intercept: float) -> Column:
    return sum((F.col(c) * w for c, w in zip(features, weights)), F.lit(intercept))


def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip")


def boosted(features: list[str], target: str, **settings):
    """A fitting function: rows to a model with ``transform`` (squared error; the robust loss has no Spark form)."""
    defaults = {"maxIter": 30, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42}

    def fit(train: DataFrame):
        stages = [assemble(features), GBTRegressor(labelCol=target, predictionCol="y_pred", **(defaults | settings))]
        return Pipeline(stages=stages).fit(train)

    return fit


def out_of_fold(df: DataFrame, fit: Callable[[DataFrame], object], fold: str = "fold") -> DataFrame:
    """Predictions of each fold's rows by a model that saw none of them."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = [fit(df.where(F.col(fold) != k)).transform(df.where(F.col(fold) == k)) for k in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("features")


def fit_and_refit(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], object]) -> tuple[DataFrame, object]:
    """Predictions of the test rows by a model of the training rows, and a last model of both together."""
    return fit(train).transform(test).drop("features"), fit(train.unionByName(test))


def boosted_rounds(df: DataFrame, features: list[str], target: str, fold: str, most: int = 60, **settings) -> tuple[int, list[int]]:
    """The number of boosting rounds: a tenth more than the median of the folds' best rounds (rounded down), and these.

    Each fold's model stops early on its held-out rows (Spark's validation column)."""
    best = []
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        marked = df.withColumn("__held", F.col(fold) == k)
        stages = [assemble(features), GBTRegressor(labelCol=target, predictionCol="y_pred", maxIter=most, validationIndicatorCol="__held", seed=42, **settings)]
        best.append(Pipeline(stages=stages).fit(marked).stages[-1].getNumTrees)
    return max(1, int(float(np.median(best)) * 1.1)), best


def mean_fold_r2(predicted: DataFrame, target: str, fold: str = "fold") -> float:
    """The mean over folds of R2; folds with a constant truth are left out."""
    from .metrics import group_r2

    return float(group_r2(predicted, fold, True, target, "y_pred").agg(F.avg("r2")).first()[0] or 0.0)


def random_search(df: DataFrame, space: dict[str, list], build: Callable[..., Callable], score: Callable[[DataFrame], float], draws: int = 20, seed: int = 42) -> tuple[dict, float]:
    """The best of seeded random settings by out-of-fold score."""
    r, best = random.Random(seed), (None, -float("inf"))
    for _ in range(draws):
        setting = {k: r.choice(v) for k, v in space.items()}
        value = score(out_of_fold(df, build(**setting)))
        if value > best[1]:
            best = (setting, value)
    return best


def permutation_importance(df: DataFrame, model, features: list[str], target: str, repeats: int = 5) -> DataFrame:
    """(feature, mean, std) drop of R2 when a feature's values are shuffled among rows.

    Rows are numbered once in range buckets by a hash; a shuffle gives each row the value of a row some places on, a
    different step for each repeat, so values meet rows in one equality join and no task holds all rows."""
    from .metrics import regression_metrics, row_ranks

    n = df.count()
    out = []
    if n:
        base = regression_metrics(model.transform(df), target, "y_pred").first()["r2"]
        key = F.xxhash64(F.lit(42), *features, target)
        numbered = cut(row_ranks(df.select(*features, target), [key, *[F.col(c) for c in (*features, target)]]).drop("n"))
        for i, f in enumerate(features):
            drops = []
            for k in range(repeats):
                step = 1 + (7919 * (k + 1) + 104729 * (i + 1)) % max(n - 1, 1)
                moved = numbered.select(((F.col("rn") + step - 1) % n + 1).alias("rn"), F.col(f).alias("__moved"))
                shuffled = numbered.join(moved, "rn").drop(f, "rn").withColumnRenamed("__moved", f)
                drops.append(base - regression_metrics(model.transform(shuffled), target, "y_pred").first()["r2"])
            out.append((f, float(np.mean(drops)), float(np.std(drops))))
        drop(numbered)
    return df.sparkSession.createDataFrame(out, "feature string, mean double, std double").orderBy(F.desc("mean"), "feature")


def keep_features(importance: DataFrame, fraction: float) -> list[str]:
    """The best share of features with a positive importance, five at least."""
    positive = importance.where("mean > 0")
    n = max(5, int(np.ceil(positive.count() * fraction)))
    return [r["feature"] for r in positive.orderBy(F.desc("mean"), "feature").limit(n).collect()]


def score_partitions(df: DataFrame, model_fn: Callable[[], object], features: list[str], out: str = "y_pred") -> DataFrame:
    """Predictions of any estimator with ``predict``, in Arrow batches; rows with a value that is not finite get null.

    Put filters and masks below this: the optimizer cannot push them through Python."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_fn()
        for b in batches:
            x = b[features].to_numpy(float)
            ok = np.isfinite(x).all(1)
            y = np.full(len(b), np.nan)
            if ok.any():
                y[ok] = np.asarray(model.predict(x[ok]), float)
            yield b.assign(**{out: pd.Series(y, index=b.index).where(ok, None)})

    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


def score_quantiles(df: DataFrame, model_fn: Callable[[], object], features: list[str], out: str = "y_pred") -> DataFrame:
    """As ``score_partitions`` for an estimator whose ``predict`` gives a row of three quantiles (low, middle, high) for
    each row: the middle one as ``out``, and high less low as ``uncertainty``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double, uncertainty double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_fn()
        for b in batches:
            x = b[features].to_numpy(float)
            ok = np.isfinite(x).all(1)
            q = np.full((len(b), 3), np.nan)
            if ok.any():
                q[ok] = np.asarray(model.predict(x[ok]), float)
            columns = {out: q[:, 1], "uncertainty": q[:, 2] - q[:, 0]}
            yield b.assign(**{k: pd.Series(v, index=b.index).where(ok, None) for k, v in columns.items()})

    ship(df.sparkSession)
    return df.mapInPandas(run, schema)


class RowSpread:
    """The plainest estimator of quantiles: the least, mean and largest feature of a row."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x.min(1), x.mean(1), x.max(1)], 1)


class RowMean:
    """The plainest estimator: the mean of a row's features."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x.mean(1)


def block_groups(df: DataFrame, x: str, y: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``block``: KMeans on coordinates, with as many blocks as distinct places at most."""
    places = df.select(x, y).distinct().limit(k).count()
    model = KMeans(k=max(min(k, places), 2), seed=seed, featuresCol="__xy", predictionCol="block").fit(assemble([x, y], "__xy").transform(df))
    return model.transform(assemble([x, y], "__xy").transform(df)).drop("__xy")


def principal_components(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """``df`` with ``pc`` (an array) of standardised features (population deviation), and the explained shares."""
    n = df.count()
    scaled = StandardScaler(inputCol="features", outputCol="__z", withMean=True, withStd=True)
    model = Pipeline(stages=[assemble(features), scaled, PCA(k=k, inputCol="__z", outputCol="__pc")]).fit(df)
    unit = (n / max(n - 1, 1)) ** 0.5
    out = model.transform(df).withColumn("pc", F.transform(vector_to_array("__pc"), lambda v: v * unit))
    return out.drop("features", "__z", "__pc"), model.stages[-1].explainedVariance.toArray().tolist()


def silhouette(df: DataFrame, features: list[str], cls: str, key: str, block_rows: int = 2000) -> DataFrame:
    """(cls, silhouette, n) by exact Euclidean distances between all rows, block by block.

    Quadratic by nature: a task holds two blocks of about ``block_rows`` rows and gives each row's sum of distances for
    each class of the other block, so only sums are shuffled."""
    classes = [r[0] for r in df.select(cls).where(F.col(cls).isNotNull()).distinct().collect()]
    kind = df.schema[cls].dataType.simpleString()
    place = F.coalesce(F.array_position(F.array(*[F.lit(c).cast(kind) for c in classes]), F.col(cls)) - 1, F.lit(-1)) if classes else F.lit(-1)
    blocks = max(1, -(-df.count() // block_rows))
    rows = df.select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), place.cast("int").alias("c"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    width = [f"x{i}" for i in range(len(features))]
    packed = rows.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("k", "c", *width)).alias("rows"))
    one = cut(packed.select("block", F.col("rows.k").alias("k"), F.col("rows.c").alias("c"), *[F.col(f"rows.{w}").alias(w) for w in width]))
    names = ["k", "c", *width]
    both = one.select(*[F.col(x).alias(f"a_{x}") for x in names]).crossJoin(one.select(*[F.col(x).alias(f"b_{x}") for x in names]))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                k1, k2, c2 = np.asarray(r["a_k"]), np.asarray(r["b_k"]), np.asarray(r["b_c"])
                d = np.zeros((len(k1), len(k2)))
                for w in width:
                    d += np.subtract.outer(np.asarray(r[f"a_{w}"], float), np.asarray(r[f"b_{w}"], float)) ** 2
                other = k1[:, None] != k2[None, :]
                d = np.where(other, np.sqrt(d), 0.0)
                for c in np.unique(c2[c2 >= 0]):
                    n = other[:, c2 == c].sum(1)
                    yield pd.DataFrame({"k1": k1, "c1": r["a_c"], "c2": c, "s": d[:, c2 == c].sum(1), "n": n})[n > 0]

    ship(df.sparkSession)
    sums = both.repartition(min(blocks * blocks, 1024)).mapInPandas(run, f"k1 {key_type}, c1 int, c2 int, s double, n bigint")
    means = sums.groupBy("k1", "c1", "c2").agg((F.sum("s") / F.sum("n")).alias("m"))
    own = F.max(F.when(F.col("c1") == F.col("c2"), F.col("m"))).alias("a")
    other = F.min(F.when((F.col("c1") != F.col("c2")) & (F.col("c1") >= 0), F.col("m"))).alias("b")
    s = means.groupBy("k1", "c1").agg(own, other)
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    name = F.get(F.array(*[F.lit(c).cast(kind) for c in classes]), F.when(F.col("c1") >= 0, F.col("c1"))) if classes else F.lit(None).cast(kind)
    return s.groupBy(name.alias("cls")).agg(F.avg(value).alias("silhouette"), F.count("*").alias("n"))


def search_classifier(df: DataFrame, features: list[str], cls: str, fold: str, space: dict[str, list], draws: int = 40, weight: str | None = None, seed: int = 42) -> tuple[dict, float]:
    """The best of seeded random settings of a forest by the mean over folds of the weighted F1."""
    r, best = random.Random(seed), ({}, -1.0)
    folds = sorted(x[0] for x in df.select(fold).distinct().collect())
    tried = set()
    for _ in range(draws):
        setting = {k: r.choice(v) for k, v in space.items()}
        if (mark := repr(sorted(setting.items()))) in tried:
            continue
        tried.add(mark)
        out = out_of_fold(df, lambda train, s=setting: forest_classifier(train, features, cls, weight, **s), fold)
        value = float(np.mean([weighted_f1(out.where(F.col(fold) == k), cls) for k in folds]))
        if value > best[1]:
            best = (setting, value)
    return best


def weighted_f1(predicted: DataFrame, cls: str) -> float:
    from .metrics import classification_report

    report = classification_report(predicted.withColumn("prediction", F.col("prediction").cast(predicted.schema[cls].dataType)), cls, "prediction")
    return float(report.agg(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).first()[0] or 0.0)


def forest_classifier(train: DataFrame, features: list[str], cls: str, weight: str | None = None, **settings):
    kind = RandomForestClassifier(labelCol=cls, featuresCol="features", **({"seed": 42} | settings))
    return Pipeline(stages=[assemble(features), kind.setWeightCol(weight) if weight else kind]).fit(train)


# --- isolation forest -----------------------------------------------------------------------------------------------


def _expected_depth(m: float) -> float:
    return 0.0 if m <= 1 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m


def isolation_forest(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> tuple[list, int]:
    """Trees of random cuts, each on its own sample of rows: nested (feature, cut, below, above), or a leaf's depth."""
    r = np.random.default_rng(seed)
    n = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(n, 2))))

    def grow(own: np.ndarray, level: int):
        spread = x[own].max(0) - x[own].min(0) if len(own) else np.zeros(x.shape[1])
        open_ = np.flatnonzero(spread > 0)
        if level >= limit or len(own) <= 1 or not len(open_):
            return level + _expected_depth(len(own))
        f = int(r.choice(open_))
        at = float(r.uniform(x[own, f].min(), x[own, f].max()))
        low = x[own, f] < at
        return f, at, grow(own[low], level + 1), grow(own[~low], level + 1)

    return [grow(r.choice(len(x), n, replace=False), 0) for _ in range(trees)], n


def forest_scores(forest: tuple[list, int], x: np.ndarray) -> np.ndarray:
    """Anomaly scores (higher: more unusual)."""
    grown, n = forest
    depth = np.zeros(len(x))
    for tree in grown:
        todo = [(tree, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, tuple):
                f, at, below, above = node
                low = x[rows, f] < at
                todo += [(below, rows[low]), (above, rows[~low])]
            else:
                depth[rows] += node
    return 2.0 ** (-depth / len(grown) / max(_expected_depth(n), 1e-9))


def mark_outliers(df: DataFrame, features: list[str], cls: str, contamination: float = 0.05, least: int = 10, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """``df`` with ``is_outlier``: the most unusual share of each class; classes of fewer than ``least`` rows keep all.

    Each class has one forest, grown on the ``trees * sample`` of its rows with the smallest hashes (at most, by nature of
    the method); every row is scored by its class's forest in Arrow batches, and the cut is an exact rank over the class."""
    from .metrics import row_ranks

    names, at_most = list(features), trees * sample
    key = F.xxhash64(F.lit(seed), *names)
    ranked = row_ranks(df.select(cls, *[F.col(f).cast("double").alias(f) for f in names]), [key, *[F.col(f) for f in names]], [cls])
    drawn = ranked.where((F.col("rn") <= at_most) & (F.col("n") >= least))
    kind = df.schema[cls].dataType.simpleString()

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cls": [pdf[cls].iloc[0]], "forest": [pickle.dumps(isolation_forest(pdf[names].to_numpy(float), trees, sample, seed))]})

    ship(df.sparkSession)
    forests = cut(drawn.groupBy(cls).applyInPandas(grow, f"cls {kind}, forest binary"))
    # a row for each class with a bounded forest
    held = {r["cls"]: r["forest"] for r in forests.toLocalIterator()}
    shared = df.sparkSession.sparkContext.broadcast(held)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", __score double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grown = {k: pickle.loads(v) for k, v in shared.value.items()}
        for b in batches:
            out = np.zeros(len(b))
            for c, rows in b.groupby(cls).indices.items():
                if c in grown:
                    out[rows] = forest_scores(grown[c], b[names].to_numpy(float)[rows])
            yield b.assign(__score=out)

    scored = row_ranks(df.mapInPandas(score, schema), [F.desc("__score"), key, *[F.col(f) for f in names]], [cls])
    flag = (F.col("n") >= least) & (F.col("rn") <= F.floor(F.col("n") * F.lit(contamination)))
    return scored.withColumn("is_outlier", flag).select(*df.columns, "is_outlier")


def leave_site_out(df: DataFrame, parts: list[str], features: list[str], site: str, fit_target: Callable[[np.ndarray], tuple[list[str], list[str]]], alpha: float = 1.0) -> DataFrame:
    """Out-of-site predictions with the target derived again from the training sites of every fold, for any number of
    sites: each fold's sums are those of all sites less its own.  Columns: site, y_true, y_pred, markers, fallback,
    threshold.  ``threshold`` is the mean balance of the training rows; ``fallback`` tells folds whose derivation failed
    (``fit_target`` raised ValueError) and took that of all rows.

    One pass gives each site's sums and products of features and logarithms of parts, about the means of all rows; folds
    are then fitted site by site in Arrow batches.  ``fit_target`` gets the training rows' variation matrix of ``parts``.
    Parts are positive, features not null."""
    z = {**{f: F.col(f).cast("double") for f in features}, **{p: F.ln(p) for p in parts}}
    names, k = [f"z{i}" for i in range(len(z))], len(features)
    means = df.agg(F.count("*").alias("n"), *[F.avg(v).alias(n) for n, v in zip(names, z.values())]).first()
    if not means["n"]:
        nothing = {"y_true": "double", "y_pred": "double", "markers": "string", "fallback": "boolean", "threshold": "double"}
        return df.select(site, *[F.lit(None).cast(v).alias(c) for c, v in nothing.items()])
    mean = np.array([means[n] for n in names])
    centred = df.select(F.col(site).alias("site"), *[(v - float(m)).alias(n) for n, v, m in zip(names, z.values(), mean)])
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(n).alias(f"s{n}") for n in names], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs]]
    moments = cut(centred.groupBy("site").agg(*sums))
    cols = moments.columns[1:]
    every = np.array(moments.agg(*[F.sum(c).alias(c) for c in cols]).first(), float)

    def variation(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, total = sums[0], sums[1 : 1 + len(names)]
        scatter = np.zeros((len(names), len(names)))
        for (i, j), q in zip(pairs, sums[1 + len(names) :]):
            scatter[i, j] = scatter[j, i] = q - total[i] * total[j] / n
        logs = scatter[k:, k:]
        return scatter, (np.diag(logs)[:, None] + np.diag(logs)[None, :] - 2 * logs) / (n - 1)

    whole = fit_target(variation(every)[1])
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own in batch[cols].to_numpy(float):
                rest = every - own
                n, total = rest[0], rest[1 : 1 + len(names)]
                if n < 2:
                    raise ValueError("a fold needs two training rows")
                scatter, t = variation(rest)
                try:
                    (num, den), fallback = fit_target(t), False
                except ValueError:
                    (num, den), fallback = whole, True
                scale = np.sqrt(len(num) * len(den) / (len(num) + len(den)))
                u = np.array([scale * ((p in num) / len(num) - (p in den) / len(den)) for p in parts])
                w = np.linalg.solve(scatter[:k, :k] + alpha * np.eye(k), scatter[:k, k:] @ u)
                at = mean + total / n
                out.append((u.tolist(), w.tolist(), float(at[k:] @ u - at[:k] @ w), ",".join(sorted(num)), fallback, float(at[k:] @ u)))
            found = ["u", "w", "b", "markers", "fallback", "threshold"]
            yield pd.DataFrame(out, columns=found).assign(site=batch["site"].to_numpy())[["site", *found]]

    kind = moments.schema["site"].dataType.simpleString()
    models = cut(moments.mapInPandas(run, f"site {kind}, u array<double>, w array<double>, b double, markers string, fallback boolean, threshold double")).withColumnsRenamed({c: f"__{c}" for c in ("site", "u", "w", "b", "markers", "fallback", "threshold")})
    weighted = lambda c, values: sum((F.get(c, F.lit(i)) * v for i, v in enumerate(values)), F.lit(0.0))
    y, p = weighted("__u", list(z.values())[k:]), weighted("__w", list(z.values())[:k]) + F.col("__b")
    return df.join(models, F.col(site) == F.col("__site")).select(site, y.alias("y_true"), p.alias("y_pred"), *[F.col(f"__{c}").alias(c) for c in ("markers", "fallback", "threshold")])


def marker_stability(folds: DataFrame, markers: list[str]) -> DataFrame:
    """(folds, same, fallbacks) of one row for each fold with its markers: how many equal the full derivation."""
    full = ",".join(sorted(markers))
    return folds.agg(F.count("*").alias("folds"), F.count_if(F.col("markers") == full).alias("same"), F.count_if("fallback").alias("fallbacks"))
