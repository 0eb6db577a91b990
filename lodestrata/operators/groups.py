"""Grouping of parts: log-ratio variation, Ward trees, principal balances, subset search, population split."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import coda
from .metrics import value_ranks


def _pairs(parts: list[str]) -> list[tuple[str, str]]:
    return list(itertools.combinations(parts, 2))


def variation_matrix(df: DataFrame, parts: list[str], by: list[str] | None = None) -> DataFrame:
    """(part_i, part_j, t) with the sample variance of ln(x_i/x_j), for i before j: one pass over the rows."""
    aggs = [F.var_samp(F.ln(a) - F.ln(b)).alias(f"t{i}") for i, (a, b) in enumerate(_pairs(parts))]
    wide = df.groupBy(*(by or [])).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("part_i"), F.lit(b).alias("part_j"), F.col(f"t{i}").alias("t")) for i, (a, b) in enumerate(_pairs(parts))])
    return wide.select(*(by or []), F.explode(rows).alias("x")).select(*(by or []), "x.*")


def matrix_of(rows, parts: list[str]) -> np.ndarray:
    place = {p: i for i, p in enumerate(parts)}
    out = np.zeros((len(parts), len(parts)))
    for r in rows:
        i, j = place[r["part_i"]], place[r["part_j"]]
        out[i, j] = out[j, i] = r["t"]
    return out


def ward(distance: np.ndarray) -> np.ndarray:
    """Ward linkage (Lance-Williams) of a distance matrix: rows (left, right, height, size); left has the smaller number.

    Ties go to the pair with the smallest numbers."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    ids, size, out = list(range(n)), [1] * n, []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b = sorted((ids[i], ids[j]))
        out.append((a, b, h, size[i] + size[j]))
        for k in range(len(ids)):
            if k not in (i, j) and np.isfinite(d[i, k]):
                s = size[i] + size[j] + size[k]
                d[i, k] = d[k, i] = math.sqrt(((size[i] + size[k]) * d[i, k] ** 2 + (size[j] + size[k]) * d[j, k] ** 2 - size[k] * h**2) / s)
        d[j, :] = d[:, j] = np.inf
        ids[i], size[i] = n + step, size[i] + size[j]
    return np.array(out, float).reshape(-1, 4)


def partition_signs(tree: np.ndarray) -> np.ndarray:
    """Sequential binary partition of a tree, inner nodes in pre-order: +1 on left leaves, -1 on right ones."""
    n = len(tree) + 1
    members = np.vstack([np.eye(n, dtype=int), np.zeros((n - 1, n), int)])  # which leaves hang below each node
    for k, (a, b) in enumerate(tree[:, :2].astype(int)):
        members[n + k] = members[a] | members[b]
    out, open_nodes = [], [2 * n - 2]
    while open_nodes:
        node = open_nodes.pop()
        if node >= n:
            a, b = tree[node - n, :2].astype(int)
            out.append(members[a] - members[b])
            open_nodes += [b, a]
    return np.array(out)


def cut(tree: np.ndarray, height: float) -> list[int]:
    """Cluster labels (from 1, by first leaf) below a height."""
    n = len(tree) + 1
    parent = list(range(2 * n - 1))
    for k, (a, b, h, _) in enumerate(tree):
        if h <= height:
            parent[int(a)] = parent[int(b)] = n + k

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    names: dict[int, int] = {}
    return [names.setdefault(root(i), len(names) + 1) for i in range(n)]


def balances(parts: list[str], signs: np.ndarray) -> list[Column]:
    return [coda.group_balance([p for p, s in zip(parts, row) if s > 0], [p for p, s in zip(parts, row) if s < 0]) for row in signs]


def principal_balances(df: DataFrame, parts: list[str], signs: np.ndarray) -> DataFrame:
    """(balance, variance, pct, rank): each balance's sample variance, its share, and its place."""
    wide = df.agg(*[F.var_samp(b).alias(f"v{k}") for k, b in enumerate(balances(parts, signs))])
    rows = F.array(*[F.struct(F.lit(k + 1).alias("balance"), F.col(f"v{k}").alias("variance")) for k in range(len(signs))])
    long = wide.select(F.explode(rows).alias("x")).select("x.*")
    # as many rows as parts
    everything = Window.partitionBy(F.lit(1))
    return long.withColumns({
        "pct": F.try_divide(100 * F.col("variance"), F.sum("variance").over(everything)),
        "rank": F.row_number().over(everything.orderBy(F.desc("variance"), "balance")),
    })


def cluster_variation(variation: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, size, mean_var): mean variation of pairs inside each cluster; infinite for a single part."""
    a = labels.select(F.col("part").alias("part_i"), F.col("cluster").alias("ci"))
    b = labels.select(F.col("part").alias("part_j"), F.col("cluster").alias("cj"))
    inside = variation.join(F.broadcast(a), "part_i").join(F.broadcast(b), "part_j").where("ci = cj").groupBy(F.col("ci").alias("cluster")).agg(F.avg("t").alias("m"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(inside, "cluster", "left").select("cluster", "size", F.coalesce("m", F.lit(math.inf)).alias("mean_var"))


def background_cluster(clusters: DataFrame, prefer: str = "stable") -> DataFrame:
    """The cluster (of two parts or more) that varies least, or that is largest."""
    some = clusters.where("size >= 2")
    order = [F.asc("mean_var"), F.desc("size")] if prefer == "stable" else [F.desc("size"), F.asc("mean_var")]
    return some.orderBy(*order, "cluster").limit(1)


def compositional_groups(df: DataFrame, parts: list[str], color_frac: float = 0.6, prefer: str = "stable") -> dict:
    """Markers, background parts and the leading balance of closed samples.  The driver sees a parts-by-parts matrix."""
    closed = df.select(*[c.alias(p) for c, p in zip(coda.multiplicative_replacement(parts), parts)])
    t = matrix_of(variation_matrix(closed, parts).collect(), parts)
    return groups_from_variation(t, parts, color_frac, prefer)


def groups_from_variation(t: np.ndarray, parts: list[str], color_frac: float = 0.6, prefer: str = "stable") -> dict:
    tree = ward(np.sqrt(t))
    signs = partition_signs(tree)
    labels = cut(tree, color_frac * tree[-1, 2])
    inside = {}
    for c in set(labels):
        own = [i for i, x in enumerate(labels) if x == c]
        if len(own) >= 2:
            inside[c] = (float(np.mean([t[i, j] for i, j in itertools.combinations(own, 2)])), len(own))
    if not inside:
        raise ValueError("no cluster has two parts")
    key = (lambda c: (inside[c][0], -inside[c][1])) if prefer == "stable" else (lambda c: (-inside[c][1], inside[c][0]))
    best = min(inside, key=key)
    return {"tree": tree, "signs": signs, "labels": labels, "background": [p for p, x in zip(parts, labels) if x == best], "markers": [p for p, x in zip(parts, labels) if x != best]}


def site_moments(df: DataFrame, parts: list[str], site: str = "site") -> DataFrame:
    """(site, n, means and squared deviations of every log ratio): they combine over sites without cancelling, so every
    subset and every leave-one-out variation matrix comes from them without another pass over the samples."""
    x = {f"{a}|{b}": F.ln(a) - F.ln(b) for a, b in _pairs(parts)}
    return df.groupBy(site).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"m {k}") for k, v in x.items()], *[(F.var_pop(v) * F.count(v)).alias(f"d {k}") for k, v in x.items()])


def subset_scores(df: DataFrame, subsets: DataFrame, parts: list[str], numerator: list[str], denominator: list[str], site: str = "site") -> DataFrame:
    """(subset_id, n, score): sample variance of a balance over each subset (subset_id, site)."""
    b = coda.group_balance(numerator, denominator)
    moments = df.groupBy(site).agg(F.count("*").alias("n"), F.avg(b).alias("m"), (F.var_pop(b) * F.count(b)).alias("d"))
    met = subsets.join(moments, site)
    total = met.groupBy("subset_id").agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("d").alias("inside"), F.collect_list(F.struct("n", "m")).alias("sites"))
    between = F.aggregate("sites", F.lit(0.0), lambda a, s: a + s["n"] * (s["m"] - F.col("mean")) * (s["m"] - F.col("mean")))
    return total.select("subset_id", "n", F.try_divide(F.col("inside") + between, F.col("n") - 1).alias("score"))


def search_subsets(df: DataFrame, parts: list[str], sites: list[str], k_min: int, k_max: int, top: int = 10, max_combos: int = 40_000, greedy: bool = False, site: str = "site", by_share: bool = False, color_frac: float = 0.6) -> list[tuple]:
    """Site subsets by the variance (or share) of their leading balance: (score, sites), best first.

    One pass over the samples gives moments for each site; all subsets (``max_combos`` at most, an error beyond) are
    scored from these few rows.
    """
    rows = {r[site]: r for r in site_moments(df.where(F.col(site).isin(sites)), parts, site).collect()}
    names = _pairs(parts)
    where = np.array([(parts.index(a), parts.index(b)) for a, b in names]).T
    held = {s: (r["n"], np.array([r[f"m {a}|{b}"] for a, b in names]), np.array([r[f"d {a}|{b}"] for a, b in names])) for s, r in rows.items()}

    def score(chosen: tuple) -> float | None:
        own = [held[s] for s in chosen if s in held]
        n = sum(x[0] for x in own)
        if n < 3:
            return None
        mean = sum(x[0] * x[1] for x in own) / n
        t = np.zeros((len(parts), len(parts)))
        t[where[0], where[1]] = t[where[1], where[0]] = sum(x[2] + x[0] * (x[1] - mean) ** 2 for x in own) / (n - 1)
        try:
            signs = groups_from_variation(t, parts, color_frac)["signs"]
        except ValueError:
            return None
        # the variance of a balance is a sum over the variation matrix
        out = []
        for row in signs:
            r, s = (row > 0).sum(), (row < 0).sum()
            w = np.where(row > 0, math.sqrt(s / (r * (r + s))), np.where(row < 0, -math.sqrt(r / (s * (r + s))), 0.0))
            out.append(-0.5 * float(w @ t @ w))
        return max(out) / sum(out) if by_share and sum(out) > 0 else max(out)

    if greedy:
        chosen, out = (), []
        while len(chosen) < k_max:
            tries = [(v, c) for s in sites if s not in chosen if (v := score(c := (*chosen, s))) is not None]
            if not tries:
                break
            best = max(tries, key=lambda x: x[0])
            chosen = best[1]
            out.append(best)
        return sorted(out, key=lambda x: -x[0])[:top]
    total = sum(math.comb(len(sites), k) for k in range(k_min, k_max + 1))
    if total > max_combos:
        raise ValueError(f"{total} combinations; at most {max_combos}")
    scored = [(v, c) for k in range(k_min, k_max + 1) for c in itertools.combinations(sites, k) if (v := score(c)) is not None]
    return sorted(scored, key=lambda x: -x[0])[:top]


def combination_table(names: DataFrame, column: str, k_min: int, k_max: int) -> DataFrame:
    """(size, members) of all sets of ``k_min`` to ``k_max`` of the (few) names, members in order."""
    sets = names.select(F.array(column).alias("members"), F.col(column).alias("last")).where(F.col("last").isNotNull())
    found = sets if k_min <= 1 else sets.limit(0)
    for k in range(2, k_max + 1):
        more = names.select(F.col(column).alias("next"))
        sets = sets.join(more, F.col("next") > F.col("last")).select(F.concat("members", F.array("next")).alias("members"), F.col("next").alias("last"))
        found = found.unionByName(sets) if k >= k_min else found
    return found.select(F.size("members").alias("size"), "members")


# --- correlation of parts -------------------------------------------------------------------------------------------


def clr_spearman(df: DataFrame, parts: list[str]) -> DataFrame:
    """(part_i, part_j, rho): Spearman correlation of centred log ratios, each part ranked in its own group."""
    fills = df.agg(*[F.coalesce(F.min(F.when(F.col(p) > 0, F.col(p))) * 1e-3, F.lit(1e-9)).alias(f"f_{p}") for p in parts])
    filled = df.crossJoin(F.broadcast(fills)).select(*[F.when(F.col(p) > 0, F.col(p)).otherwise(F.col(f"f_{p}")).alias(p) for p in parts])
    ratios = filled.select(F.monotonically_increasing_id().alias("row"), *[c.alias(p) for c, p in zip(coda.clr(parts), parts)])
    long = ratios.select("row", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("v")) for p in parts])).alias("x")).select("row", "x.*")
    ranked = long.join(value_ranks(long, "v", ["part"]), ["part", "v"]).groupBy("row").pivot("part", parts).agg(F.first("rank"))
    corr = ranked.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(_pairs(parts))])
    rows = F.array(*[F.struct(F.lit(a).alias("part_i"), F.lit(b).alias("part_j"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(_pairs(parts))])
    return corr.select(F.explode(rows).alias("x")).select("x.*")


def strong_pairs(correlations: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs correlated beyond ``least``, strongest first."""
    return correlations.where(F.abs("rho") > least).orderBy(F.desc(F.abs("rho")), "part_i", "part_j")


def merge_table(tree: np.ndarray, parts: list[str]) -> list[tuple[int, str, str, float, int]]:
    """A tree as rows for a drawing: (step, left members, right members, height, size)."""
    n, names = len(parts), [[p] for p in parts]
    out = []
    for k, (a, b, h, size) in enumerate(tree):
        left, right = names[int(a)], names[int(b)]
        names.append(left + right)
        out.append((k, ",".join(left), ",".join(right), float(h), int(size)))
    return out


def density(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, x, density): a histogram for a drawing, as shares per unit, over the range of the finite values."""
    v = F.col(value)
    good = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    edge = good.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    rows = good.select(v.alias("v")).crossJoin(F.broadcast(edge)).select(F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).alias("bin"), "lo", width.alias("w"), "n")
    return rows.groupBy("bin").agg((F.first("lo") + (F.col("bin") + 0.5) * F.first("w")).alias("x"), (F.count("*") / F.first("n") / F.first("w")).alias("density"))


def lithogenic_elements(background: DataFrame, parts: list[str], least: float = 0.5) -> DataFrame:
    """(part, n): how often each part is in a pair correlated beyond ``least``, most often first."""
    strong = clr_spearman(background, parts).where(F.abs("rho") > least)
    return strong.select(F.explode(F.array("part_i", "part_j")).alias("part")).groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part")


# --- populations ----------------------------------------------------------------------------------------------------


def histogram(df: DataFrame, value: str, bins: int = 4000) -> list[tuple[float, int]]:
    """(bin mean, count): at most ``bins`` rows reach the driver, whatever the input; finite values only."""
    v = F.col(value)
    good = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    lo, hi = good.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return []
    width = (hi - lo) / bins or 1.0
    rows = good.groupBy(F.floor((v - lo) / width).alias("b")).agg(F.avg(value).alias("m"), F.count("*").alias("n")).orderBy("b").collect()
    return [(r["m"], r["n"]) for r in rows]


def population_split(df: DataFrame, value: str, polish: int = 20, tolerance: float = 1e-9) -> dict:
    """One or two normal populations by BIC; of two, the antimode between their means.

    EM starts on a fine histogram and ends on the values themselves: the last rounds are aggregate passes over all rows,
    until the mean log likelihood settles (``polish`` passes at most)."""
    h = histogram(df, value)
    if not h:
        return {"bimodal": False}
    x, n = np.array([a for a, _ in h]), np.array([b for _, b in h], float)
    total, mean = n.sum(), (x * n).sum() / n.sum()
    v = F.col(value)
    good = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))).select(v.cast("double").alias("x"))
    # variances carry a small ridge, so that repeated values leave no population without width
    var = max(float(good.agg(F.var_pop("x")).first()[0] or 0.0), 1e-12) + 1e-6
    one = -0.5 * total * (math.log(2 * math.pi * var) + (var - 1e-6) / var)
    cum = np.cumsum(n) / total
    m = np.array([x[np.searchsorted(cum, 0.2)], x[min(np.searchsorted(cum, 0.8), len(x) - 1)]])
    spread, w, two = np.array([var / 4, var / 4]), np.array([0.5, 0.5]), -np.inf
    for _ in range(500):
        d = np.stack([w[k] * np.exp(-((x - m[k]) ** 2) / (2 * spread[k])) / np.sqrt(2 * np.pi * spread[k]) for k in (0, 1)])
        now = (n * np.log(d.sum(0) + 1e-300)).sum()
        r = d / (d.sum(0) + 1e-300) * n
        w, m = r.sum(1) / total, (r * x).sum(1) / np.maximum(r.sum(1), 1e-12)
        spread = np.stack([(r[k] * (x - m[k]) ** 2).sum() / max(r[k].sum(), 1e-12) for k in (0, 1)]) + 1e-6
        if abs(now - two) < 1e-9 * total:
            break
        two = now
    two = -np.inf
    for _ in range(polish):
        logs = [F.lit(math.log(max(w[k], 1e-300)) - 0.5 * math.log(2 * math.pi * spread[k])) - (F.col("x") - float(m[k])) ** 2 / (2 * float(spread[k])) for k in (0, 1)]
        top = F.greatest(*logs)
        each = good.select("x", (top + F.ln(F.exp(logs[0] - top) + F.exp(logs[1] - top))).alias("l"), logs[0].alias("a"))
        each = each.select("l", F.exp(F.col("a") - F.col("l")).alias("r"), (F.col("x") - float(mean)).alias("y"))
        r, y = F.col("r"), F.col("y")
        s = each.agg(F.sum("l").alias("l"), *[F.sum(e).alias(k) for k, e in (("r0", r), ("r1", 1 - r), ("m0", r * y), ("m1", (1 - r) * y), ("q0", r * y * y), ("q1", (1 - r) * y * y))]).first()
        mass = np.maximum([s["r0"], s["r1"]], 1e-12)
        near = np.array([s["m0"], s["m1"]]) / mass
        w, m, spread = mass / total, near + mean, np.maximum(np.array([s["q0"], s["q1"]]) / mass - near**2, 0) + 1e-6
        if abs(s["l"] - two) < tolerance * total:
            two = s["l"]
            break
        two = s["l"]
    bic1, bic2 = 2 * math.log(total) - 2 * one, 5 * math.log(total) - 2 * two
    out = {"bimodal": bool(bic2 < bic1), "bic1": float(bic1), "bic2": float(bic2)}
    if out["bimodal"]:
        o = np.argsort(m)
        m, spread, w = m[o], spread[o], w[o]
        lo, hi = good.agg(F.min("x"), F.max("x")).first()
        out |= {"means": m.tolist(), "weights": w.tolist(), "variances": spread.tolist(), "threshold": antimode(m, spread, w, float(lo), float(hi))}
        low = good.agg(F.count_if(F.col("x") < out["threshold"])).first()[0]
        out |= {"n_low": int(low), "n_high": int(total) - int(low)}
    return out


def antimode(m, v, w, low: float, high: float, points: int = 2000) -> float:
    """The grid point between the means where the lower population's share is nearest to one half."""
    grid = np.linspace(low, high, points)
    grid = grid[(grid >= m[0]) & (grid <= m[1])]
    d = [w[k] * np.exp(-((grid - m[k]) ** 2) / (2 * v[k])) / math.sqrt(v[k]) for k in (0, 1)]
    return float(grid[np.argmin(np.abs(d[0] / (d[0] + d[1]) - 0.5))])


def resolve_threshold(setting, split: dict | None = None) -> float:
    """A number as it is; ``antimode`` from a split, or zero."""
    if isinstance(setting, (int, float)):
        return float(setting)
    if setting == "antimode":
        return float((split or {}).get("threshold") or 0.0)
    raise ValueError(f"unknown threshold {setting!r}")
