"""Regression, agreement and ranking metrics as aggregates; folds and splits as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import bounded, cut

Y, P = "y_true", "y_pred"


def dealt_by_range(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """``df`` in range buckets with their number ``__b``, as a written table: every plan that reads it sees the same
    buckets (a range exchange that is planned twice may sample other bounds)."""
    return cut(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()))


def _along(by: list[str]):
    """The buckets of a group in order: a row for each bucket and group."""
    return Window.partitionBy(*(by or [F.lit(1)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)


def _placed(local: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Rows with what the buckets before theirs hold; null groups are groups too."""
    named = totals.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(["__b", *by])})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(["__b", *by])])
    return local.join(named, same).drop(*[f"__k{i}" for i in range(len(by) + 1)])


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, rank) of each distinct value, ties averaged.

    Values are first counted, then bucketed by range: a window runs inside a bucket and the few buckets' totals are
    added, so no single task sees all values."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    dealt = dealt_by_range(counts, [*by, value])
    own = Window.partitionBy("__b", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("__before", F.coalesce(F.sum("c").over(own), F.lit(0)))
    totals = dealt.groupBy("__b", *by).agg(F.sum("c").alias("__n"))
    base = totals.select("__b", *by, F.coalesce(F.sum("__n").over(_along(by)), F.lit(0)).alias("__base"))
    return _placed(local, base, by).select(*by, value, (F.col("__base") + F.col("__before") + (F.col("c") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, a: str = Y, b: str = P) -> DataFrame:
    ra, rb = value_ranks(df, a).withColumnRenamed("rank", "ra"), value_ranks(df, b).withColumnRenamed("rank", "rb")
    return df.select(a, b).join(ra, a).join(rb, b).agg(F.corr("ra", "rb").alias("spearman"))


def regression_metrics(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """n, r2 (1 - SSE/SST), rmse, mae, pearson, mape in one pass."""
    e = F.col(p) - F.col(y)
    sse, sst = F.sum(e * e), F.var_pop(y) * F.count(y)
    return df.agg(
        F.count("*").alias("n"), (1 - F.try_divide(sse, sst)).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.corr(y, p).alias("pearson"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"),
    )


def agreement_metrics(df: DataFrame, threshold: float = 0.0, y: str = Y, p: str = P) -> DataFrame:
    """Confusion cells of value > threshold, and what follows from them (null where the truth has one class)."""
    t, q = F.col(y) > threshold, F.col(p) > threshold
    cells = df.agg(*[F.count_if(c).cast("double").alias(k) for k, c in (("tp", t & q), ("fn", t & ~q), ("fp", ~t & q), ("tn", ~t & ~q))])
    c = {k: F.col(k) for k in ("tp", "fn", "fp", "tn")}
    n, pos, neg = c["tp"] + c["fn"] + c["fp"] + c["tn"], c["tp"] + c["fn"], c["fp"] + c["tn"]
    both = (pos > 0) & (neg > 0)
    chance = (pos * (c["tp"] + c["fp"]) + neg * (c["fn"] + c["tn"])) / (n * n)
    accuracy = (c["tp"] + c["tn"]) / n
    mcc = F.coalesce(F.try_divide(c["tp"] * c["tn"] - c["fp"] * c["fn"], F.sqrt(pos * neg * (c["tp"] + c["fp"]) * (c["fn"] + c["tn"]))), F.lit(0.0))
    return cells.select(
        pos.cast("bigint").alias("n_elevated"), neg.cast("bigint").alias("n_depleted"), accuracy.alias("accuracy"),
        F.when(both, (F.try_divide(c["tp"], pos) + F.try_divide(c["tn"], neg)) / 2).alias("balanced_acc"), F.when(both, mcc).alias("mcc"),
        F.when(both, F.try_divide(accuracy - chance, 1 - chance)).alias("kappa"),
        F.when(both, F.coalesce(F.try_divide(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]), F.lit(0.0))).alias("f1"),
        *[c[k].cast("bigint").alias(k) for k in ("tn", "fp", "fn", "tp")],
    )


def auc(df: DataFrame, positive: Column, score: str = P) -> DataFrame:
    """Mann-Whitney AUC from average ranks; null with one class."""
    ranked = df.select(positive.alias("__pos"), score).join(value_ranks(df, score), score)
    n1, n0 = F.count_if("__pos").cast("double"), F.count_if(~F.col("__pos")).cast("double")
    return ranked.agg(F.try_divide(F.sum(F.when(F.col("__pos"), F.col("rank"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def roc_curve(df: DataFrame, positive: Column, score: str = P) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct score, highest first."""
    at = df.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    dealt = dealt_by_range(at, [F.desc(score)])
    own = Window.partitionBy("__b").orderBy(F.desc(score))
    cum = dealt.withColumns({"tp": F.sum("p").over(own), "fp": F.sum("n").over(own)})
    totals = dealt.groupBy("__b").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn"))
    whole = Window.partitionBy(F.lit(1))
    base = totals.select("__b", F.coalesce(F.sum("sp").over(_along([])), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(_along([])), F.lit(0)).alias("bn"), F.sum("sp").over(whole).alias("all_p"), F.sum("sn").over(whole).alias("all_n"))
    return _placed(cum, base, []).select(F.col(score).alias("threshold"), F.try_divide((F.col("fp") + F.col("bn")).cast("double"), F.col("all_n")).alias("fpr"), F.try_divide((F.col("tp") + F.col("bp")).cast("double"), F.col("all_p")).alias("tpr"))


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    return df.groupBy(truth.alias("truth"), predicted.alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(cls, precision, recall, f1, support)."""
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    by_truth = cells.groupBy(F.col(truth).alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = cells.groupBy(F.col(predicted).alias("cls")).agg(F.sum("n").alias("called"))
    out = by_truth.join(by_pred, "cls", "full")
    p, r = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("called")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), F.lit(0.0))
    return out.select("cls", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.coalesce("support", F.lit(0)).alias("support"))


def row_ranks(df: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """``df`` with its place ``rn`` (from 1) in a total order and the number of rows ``n``, within groups if ``by`` names
    them: range buckets, so that neither all rows nor a large group meet in one task."""
    by = by or []
    dealt = dealt_by_range(df, [*by, *order])
    local = dealt.withColumn("__rn", F.row_number().over(Window.partitionBy("__b", *by).orderBy(*order)))
    totals = dealt.groupBy("__b", *by).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    base = totals.select("__b", *by, F.coalesce(F.sum("__n").over(_along(by)), F.lit(0)).alias("__base"), F.sum("__n").over(whole).alias("n"))
    return _placed(local, base, by).withColumn("rn", F.col("__base") + F.col("__rn")).drop("__b", "__rn", "__base")


def quantile_bins(df: DataFrame, value: str = P, bins: int = 5, tie: str = "serial") -> DataFrame:
    """``df`` with ``bin`` 1..bins of the ranked value (first come first on ties)."""
    ranked = row_ranks(df, [F.col(value).asc(), F.col(tie).asc()])
    spot = F.ceil(F.try_divide((F.col("rn") - 1) * F.lit(bins), (F.col("n") - 1).cast("double")))
    return ranked.withColumn("bin", F.least(F.lit(bins), F.greatest(F.lit(1), F.coalesce(spot, F.lit(1)))).cast("int")).drop("rn", "n")


def bin_summary(binned: DataFrame, y: str = Y) -> DataFrame:
    sem = F.coalesce(F.try_divide(F.stddev_samp(y), F.sqrt(F.count(y).cast("double"))), F.lit(0.0))
    return binned.groupBy("bin").agg(F.avg(y).alias("mean"), sem.alias("sem"), F.count("*").alias("n"))


def top_fraction(df: DataFrame, positive: Column, fraction: float = 0.2, score: str = P, tie: str = "serial") -> DataFrame:
    """(k, hit, base, lift): positives among the highest-scored fraction."""
    ranked = row_ranks(df.withColumn("__pos", positive), [F.col(score).desc(), F.col(tie).asc()])
    k = F.greatest(F.lit(1), F.bround(F.col("n") * fraction, 0)).cast("bigint")
    top = F.col("rn") <= k
    out = ranked.agg(F.max(k).alias("k"), F.avg(F.when(top, F.col("__pos").cast("double"))).alias("hit"), F.avg(F.col("__pos").cast("double")).alias("base"))
    return out.withColumn("lift", F.try_divide(F.col("hit"), F.col("base")))


def summary(df: DataFrame, positive: Column, fraction: float = 0.2, y: str = Y, p: str = P, tie: str = "serial") -> DataFrame:
    """One row: spearman, auc, k, hit, base, lift."""
    out = spearman(df, y, p).crossJoin(auc(df, positive, p))
    return out.crossJoin(top_fraction(df, positive, fraction, p, tie))


def site_rollup(df: DataFrame, by: str = "site", y: str = Y, p: str = P) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(y).alias("mean_true"), F.avg(p).alias("mean_pred"))


def spread(df: DataFrame, value: str) -> DataFrame:
    q = lambda x: F.percentile(value, F.lit(x))
    return df.agg(q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.stddev_pop(value).alias("std_pop"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def group_r2(df: DataFrame, by: str, skip_constant: bool = True, y: str = Y, p: str = P) -> DataFrame:
    """(by, n, r2); groups with a constant truth are left out on request."""
    e = F.col(p) - F.col(y)
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.var_pop(y).alias("v"), F.sum(e * e).alias("sse"))
    out = out.withColumn("r2", 1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n")))
    return (out.where("v > 0") if skip_constant else out).select(by, "n", "r2")


def _number(text: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def bootstrap_ci(sites: DataFrame, draws: int = 2000, y: str = "mean_true", p: str = "mean_pred", seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(lo, hi, n) of the correlation of site means over resamples of as many sites as there are, drawn with replacement.

    The j-th draw of a resample takes the site whose number is a hash of (seed, resample, j).  Sites are numbered once
    and draws are the rows of a range, so that the optimizer knows how many there are: up to ``BROADCAST_ROWS`` sites go
    to the draws, more meet them in a shuffle.  Undefined draws are dropped."""
    ranked = row_ranks(sites.select(F.col(y).alias("y"), F.col(p).alias("p"), F.struct(*sites.columns).alias("site")), [F.col("site")])
    ranked = cut(ranked.select(F.col("rn").alias("pick"), "y", "p"))
    n = ranked.count()
    place = sites.sparkSession.range(draws * n).select(F.expr(f"id DIV {max(n, 1)} + 1").alias("b"), F.expr(f"id % {max(n, 1)} + 1").alias("j"))
    taken = place.select("b", (_number(F.concat_ws(":", F.lit(seed), "b", "j")) % max(n, 1) + 1).alias("pick"))
    rows = taken.join(bounded(ranked, n), "pick")
    # the correlation by centred sums: corr() keeps means and co-moments, which do not cancel
    r = rows.groupBy("b").agg(F.corr("y", "p").alias("r")).where("r IS NOT NULL AND NOT isnan(r)")
    return r.agg(F.percentile("r", F.lit(low)).alias("lo"), F.percentile("r", F.lit(high)).alias("hi"), F.count("*").alias("n"))


# --- weights, samples, folds ----------------------------------------------------------------------------------------


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """(cls, n, weight) with weight n_all / (classes * n)."""
    counts = df.groupBy(cls).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))  # a row for each class
    return counts.select(cls, "n", (F.sum("n").over(one) / (F.count("*").over(one) * F.col("n"))).alias("weight"))


def downsample(df: DataFrame, cls: str, reference: int, order: list[Column]) -> DataFrame:
    """At most as many rows of each class as the reference class has, first in ``order`` (a hash for a random sample).

    ``order`` decides within a class; a hot class is thinned before it is ranked: rows beyond the first ones of their
    bucket cannot be among the first of the class."""
    target = df.where(F.col(cls) == reference).count()
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != cls and "array" not in dict(df.dtypes)[c]]), F.lit(64)))
    near = dealt.withColumn("__k", F.row_number().over(Window.partitionBy(cls, "__salt").orderBy(*order))).where(F.col("__k") <= target)
    return near.withColumn("__k", F.row_number().over(Window.partitionBy(cls).orderBy(*order))).where((F.col("__k") <= target) | (F.col(cls) == reference)).drop("__k", "__salt")


def group_ids(df: DataFrame, by: str) -> DataFrame:
    """(by, fold): one fold for each group, in sorted order."""
    return df.select(by).distinct().withColumn("fold", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(by)) - 1)


def group_folds(sizes: list[tuple], folds: int) -> dict:
    """Group -> fold: largest groups first, each to the fold with fewest rows."""
    load, out = [0] * folds, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], str(x[0]))):
        k = load.index(min(load))
        out[name], load[k] = k, load[k] + n
    return out


def with_folds(df: DataFrame, by: str, folds: int | None = None) -> DataFrame:
    """``df`` with ``fold``: leave one group out, or ``folds`` folds of about equal size where groups are more.

    Balancing takes one number for each group to the driver; groups are sites or blocks.  Leaving one out does not."""
    groups_ = df.groupBy(by).agg(F.count("*").alias("n"))
    if folds is None or groups_.limit(folds + 1).count() <= folds:
        table = value_ranks(df, by).select(F.col(by).alias("__by"), "rank")
        numbered = row_ranks(table, [F.col("__by").cast("string")]).select("__by", (F.col("rn") - 1).cast("int").alias("fold"))
    else:
        chosen = group_folds([(r[by], r["n"]) for r in groups_.where(F.col(by).isNotNull()).toLocalIterator()], folds)
        kind = df.schema[by].dataType.simpleString()
        numbered = df.sparkSession.createDataFrame([(g, k) for g, k in chosen.items()], f"__by {kind}, fold int")
    return df.join(numbered, F.col(by) == F.col("__by")).drop("__by")


def shuffled_folds(df: DataFrame, folds: int, order: list[Column], stratum: str | None = None) -> DataFrame:
    """``df`` with ``fold``: rows in a hash order dealt out in turn, within strata if one is named."""
    ranked = row_ranks(df, order, [stratum] if stratum else None)
    return ranked.withColumn("fold", ((F.col("rn") - 1) % folds).cast("int")).drop("rn", "n")


def stratified_split(df: DataFrame, stratum: str, order: list[Column], test: float = 0.2) -> DataFrame:
    """``df`` with ``is_test``: a share of each stratum, at least one row of two or more, none of a single one."""
    ranked = row_ranks(df, order, [stratum])
    held = (F.col("n") > 1) & (F.col("rn") <= F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test), 0)))
    return ranked.withColumn("is_test", held).drop("n", "rn")
