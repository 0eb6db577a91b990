"""Sample tables: filters, part detection, background removal, alignment, collapse, upsert."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coda
from .lineage import bounded, cut

BACKGROUND = ("BACKGROUND", "Background", "B")
_FLAGS = {"is_imputed", "is_outlier"}
_PLACE = {"Easting", "Northing", "Longitude", "Latitude"}
_IDS = {"Serial", "Site", "Type", "index", "geometry", "field_1"}
#: Columns that are no parts, by the rule of each consumer.
EXCLUDED = {
    "background": _IDS | _PLACE,
    "raster": _IDS | _PLACE | _FLAGS | {"Elevation"},
    "validation": _PLACE | _FLAGS | {"Res"},
    "groups": _IDS | _PLACE | _FLAGS,
    "triples": _IDS | _PLACE | _FLAGS | {"Elevation"},
    "lithogenic": _IDS | _PLACE | _FLAGS | {"Elevation", "Res", "P", "K", "Ca", "Sr"},
}


def detect_parts(df: DataFrame, mode: str) -> list[str]:
    """Element columns by the rule of a consumer; ``background`` takes doubles and longs only."""
    kinds = (T.DoubleType, T.LongType) if mode == "background" else T.NumericType
    out = [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in EXCLUDED[mode]]
    return sorted(out) if mode == "validation" else out


def feature_columns(df: DataFrame, prefixes: list[str]) -> list[str]:
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def _as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def sample_filter(df: DataFrame, sites=None, not_sites=None, type_prefix=None, types=None, not_types=None, drop_outliers=False, site="site", kind="type", outlier="is_outlier") -> DataFrame:
    """Conjunctive filter; an empty or missing list does not filter; null counts as the text ``None``."""
    tests = []
    if sites:
        tests.append(_as_text(F.col(site)).isin([str(s) for s in sites]))
    if not_sites:
        tests.append(~_as_text(F.col(site)).isin([str(s) for s in not_sites]))
    if type_prefix:
        tests.append(_as_text(F.col(kind)).startswith(type_prefix))
    if types:
        tests.append(_as_text(F.col(kind)).isin([str(t) for t in types]))
    if not_types:
        tests.append(~_as_text(F.col(kind)).isin([str(t) for t in not_types]))
    if drop_outliers and outlier in df.columns:
        tests.append(~F.coalesce(F.col(outlier).cast("boolean"), F.lit(False)))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def is_background(kind: str = "type") -> Column:
    return F.coalesce(F.col(kind).isin(*BACKGROUND), F.lit(False))


def fill_type(df: DataFrame, value: str | None, kind: str = "type") -> DataFrame:
    return df.withColumn(kind, F.coalesce(kind, F.lit(value))) if value else df


def all_finite(columns: list[str]) -> Column:
    return F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))


def any_nonzero(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.abs(F.col(c)) for c in columns]) > 0


def finite_or_null(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def exclude_ids(df: DataFrame, ids: list[str], key: str = "serial") -> DataFrame:
    return df.where(~F.col(key).cast("string").isin([str(i) for i in ids])) if ids else df


def remap(c: Column, table: dict[int, int], strict: bool = True) -> Column:
    """Classes by a lookup; with ``strict`` an unknown class is an error."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return F.when(c.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("class without a mapping: "), c.cast("string")))) if strict else found


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """Raises when a key occurs twice (joins by it would multiply rows)."""
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} is not unique: {twice[0][0]}")
    return df


def require_positive(df: DataFrame, parts: list[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [(F.col(p) <= 0) | F.col(p).isNull() for p in parts])
    if df.where(bad).limit(1).collect():
        raise ValueError("parts must be positive; replace zeros first")
    return df


# --- distance join --------------------------------------------------------------------------------------------------


def within(left: DataFrame, right: DataFrame, radius: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Inner join of points at most ``radius`` apart (inclusive), by a grid of cells of that size.

    The left side is put into its own and the eight neighbouring cells, so the join is an equality on cells with the
    distance as a residual: it hash-joins at any size, and splits where a cell is hot.
    """
    cell = float(radius) if radius > 0 else 1.0
    lx, ly, rx, ry = (F.col(c) for c in (*left_xy, *right_xy))
    around = F.explode(F.array(*[F.struct((F.floor(lx / cell) + i).alias("i"), (F.floor(ly / cell) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.withColumn("__cell", around)
    b = right.withColumn("__cell_r", F.struct(F.floor(rx / cell).alias("i"), F.floor(ry / cell).alias("j")))
    near = F.sqrt((lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)) <= radius
    return a.join(b, (F.col("__cell") == F.col("__cell_r")) & near).drop("__cell", "__cell_r")


def means_within(spots: DataFrame, key: str, points: DataFrame, values: list[str], radius: float, spot_xy: tuple[str, str], point_xy: tuple[str, str], split: int = 8) -> DataFrame:
    """(key, values...): means of the points at most ``radius`` from each spot; spots without any are missing.

    Points are summed once for each cell of ``radius / split``.  Cells that lie wholly inside a spot's circle give their
    sums; only points of cells that its border crosses are met one by one (those at one place as one), so pairs grow with
    the border of the circle and not with its area.

    Spots become many rows each, which are never broadcast: cells and points are, if they are few."""
    cell = float(radius) / split if radius > 0 else 1.0
    (sx, sy), (px, py) = (tuple(F.col(c) for c in xy) for xy in (spot_xy, point_xy))
    sums_of = lambda df, by, n: df.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values], n.alias("__n"))
    placed = points.select(px.cast("double").alias("__px"), py.cast("double").alias("__py"), *values).where(~F.isnan("__px") & ~F.isnan("__py"))
    spread = sums_of(placed, ["__px", "__py"], F.count("*"))
    dealt = cut(spread.withColumns({"__i": F.floor(F.col("__px") / cell), "__j": F.floor(F.col("__py") / cell)}))
    totals = cut(sums_of(dealt, ["__i", "__j"], F.sum("__n")))
    reach = F.sequence(F.lit(-split - 1), F.lit(split + 1))
    around = spots.select(F.col(key), sx.alias("__sx"), sy.alias("__sy"), F.explode(reach).alias("__a")).select("*", F.explode(reach).alias("__b"))
    around = around.withColumns({"__i": F.floor(F.col("__sx") / cell) + F.col("__a"), "__j": F.floor(F.col("__sy") / cell) + F.col("__b")})

    def gaps(at: str, number: str) -> tuple[Column, Column]:
        """The least and the largest distance along one axis from a spot to a cell."""
        low, high = F.col(number) * cell - F.col(at), (F.col(number) + 1) * cell - F.col(at)
        return F.greatest(F.lit(0.0), low, -high), F.greatest(F.abs(low), F.abs(high))

    (x0, x1), (y0, y1) = gaps("__sx", "__i"), gaps("__sy", "__j")
    # a hair's breadth to either side of the circle counts as border, where points are measured exactly
    around = around.withColumns({"__near": F.sqrt(x0 * x0 + y0 * y0), "__far": F.sqrt(x1 * x1 + y1 * y1)})
    around = around.where(F.col("__near") <= radius * (1 + 1e-9) + 1e-9)
    whole = F.col("__far") <= radius * (1 - 1e-9) - 1e-9
    inside = around.where(whole).join(bounded(totals, totals.count()), ["__i", "__j"]).select(key, *values, "__n")
    dx, dy = F.col("__sx") - F.col("__px"), F.col("__sy") - F.col("__py")
    border = around.where(~whole).join(bounded(dealt, dealt.count()), ["__i", "__j"]).where(F.sqrt(dx * dx + dy * dy) <= radius)
    sums = inside.unionByName(border.select(key, *values, "__n")).groupBy(key).agg(*[F.sum(v).alias(v) for v in values], F.sum("__n").alias("__n"))
    return sums.select(key, *[(F.col(v) / F.col("__n")).alias(v) for v in values])


def site_centroids(df: DataFrame, site="site", x="easting", y="northing") -> DataFrame:
    return df.groupBy(site).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"))


def remove_background(df: DataFrame, parts: list[str], buffer: float | None = 500.0, site="site", kind="type", x="easting", y="northing") -> DataFrame:
    """Samples as compositions relative to the background around their site.

    Background rows within ``buffer`` of a site's centroid (all of them for ``None``) give the site's centre; each row of
    the site, background or not, is divided by it and closed.  Rows of sites without any pass as they are, neither
    corrected nor closed; rows without a site are dropped.  ``corrected`` tells the two apart.
    """
    # columns of their own for what each part needs of all parts: as one formula they pass 64 KB of generated code
    names, fixed, apart = ([f"{k}{p}" for p in parts] for k in ("b_", "__x_", "__d_"))
    replaced = dict(zip(fixed, coda.multiplicative_replacement(parts)))
    # logarithms of closed background rows are taken once, before rows meet sites
    logs = [F.ln(c).alias(n) for c, n in zip(coda.closure(fixed), names)]
    bg = df.where(is_background(kind)).withColumns(replaced).select(F.col(x).alias("bx"), F.col(y).alias("by"), *logs)
    # one row for each site: what follows is written, so that the optimizer knows its size before it plans the join
    seen = df.where(F.col(site).isNotNull()).groupBy(F.col(site).alias("__site")).agg(F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.bool_or(~is_background(kind)).alias("__own"))
    spots = seen.where("__own")
    if buffer is None:
        centers = spots.select("__site").crossJoin(F.broadcast(bg.agg(*[F.avg(n).alias(n) for n in names])))
    else:
        spots = cut(spots)
        near = means_within(spots, "__site", bg, names, buffer, ("cx", "cy"), ("bx", "by"))
        centers = spots.select("__site").join(near, "__site", "left")
    centers = cut(centers.select("__site", *[F.exp(n).alias(n) for n in names]))
    joined = df.join(centers, F.col(site) == F.col("__site")).drop("__site")
    # the centre's difference, closed below
    joined = joined.withColumns(replaced).withColumns({d: F.try_divide(c, F.col(n)) for d, c, n in zip(apart, coda.closure(fixed), names)})
    there = F.col(names[0]).isNotNull()
    out = {p: F.when(there, m).otherwise(F.col(p)) for p, m in zip(parts, coda.closure(apart))}
    return joined.withColumns(out | {"corrected": there}).drop(*names, *fixed, *apart)


# --- collapse and alignment -----------------------------------------------------------------------------------------


def collapse(df: DataFrame, parts: list[str], keys: list[str | Column], order: Column, first: list[str], means: list[str] = ()) -> DataFrame:
    """One row for each group: its centre if it has several rows, the row itself if one (not closed again)."""
    mids = [F.exp(F.avg(F.ln(c))).alias(f"__m_{p}") for c, p in zip(coda.closure(parts), parts)]
    raw = [F.first(p).alias(f"__r_{p}") for p in parts]
    grouped = df.groupBy(*keys).agg(F.count("*").alias("n"), *mids, *raw, *[F.min_by(c, order).alias(c) for c in first], *[F.avg(c).alias(c) for c in means])
    closed = coda.closure([f"__m_{p}" for p in parts])
    out = grouped.withColumns({p: F.when(F.col("n") > 1, m).otherwise(F.col(f"__r_{p}")) for p, m in zip(parts, closed)})
    return out.drop(*[f"__{k}_{p}" for k in "mr" for p in parts])


def collapse_triples(df: DataFrame, parts: list[str], serial="serial", first=("site", "type"), means=("easting", "northing")) -> DataFrame:
    """Repeated measurements ``n.1, n.2, ...`` as one row of their parent n."""
    parent = F.split(F.col(serial), r"\.")[0].cast("bigint").alias("parent")
    return collapse(df, parts, [parent], F.col(serial), list(first), list(means))


def align(training: DataFrame, validation: DataFrame, mode: str = "validation") -> tuple[DataFrame, DataFrame, list[str]]:
    """Both frames reduced to their shared parts, replaced and closed; other columns stay."""
    shared = sorted(set(detect_parts(training, mode)) & set(detect_parts(validation, mode)))
    if not shared:
        raise ValueError("no shared parts")

    def reduced(df: DataFrame) -> DataFrame:
        alone = [c for c in detect_parts(df, mode) if c not in shared]
        return df.drop(*alone).withColumns(dict(zip(shared, coda.multiplicative_replacement(shared))))

    return reduced(training), reduced(validation), shared


def align_for_validation(training: DataFrame, validation: DataFrame, kind: str = "type", places=("Easting", "Northing", "Longitude", "Latitude"), columns: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Validation rows aligned to the training parts, with the training background attached as its reference.

    Coordinates that the validation lacks are null.  Shared parts are replaced and closed over all rows of the result;
    ``origin`` tells validation rows from attached ones."""
    training, validation, shared = align(training, validation)
    keep = [c for c in (*columns, kind, *places) if c in training.columns or c in validation.columns]

    def shaped(df: DataFrame, origin: str) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        other = {f.name.lower(): f.dataType for f in (*training.schema, *validation.schema)}
        own = [F.col(have[c.lower()]).alias(c) if c.lower() in have else F.lit(None).cast(other[c.lower()]).alias(c) for c in keep]
        return df.select(*own, *shared, F.lit(origin).alias("origin"))

    rows = shaped(validation, "validation").unionByName(shaped(training.where(is_background(kind)), "training"))
    return rows, shared


def attach(df: DataFrame, meta: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with columns of the meta row of their key (null without one)."""
    return df.join(meta.select(key, *columns), key, "left")


def require_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{what}: {n} rows, at least {least} are needed")
    return df


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"{what}: no column {', '.join(absent)}")
    return df


def upsert(existing: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` in place of existing ones with equal keys (as texts); columns are united.  Keys that the existing frame
    lacks are ignored."""
    if existing is None or not existing.columns:
        return rows
    on = [k for k in keys if k in existing.columns]
    if not on:
        return existing.unionByName(rows, allowMissingColumns=True)
    new = rows.select(*[F.col(k).cast("string").alias(f"__{k}") for k in on]).distinct()
    match = reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.col(f"__{k}") for k in on])
    return existing.join(new, match, "left_anti").unionByName(rows, allowMissingColumns=True)


def lod_flags(df: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """For each analyte with a limit of detection: whether the value is below it."""
    return df.withColumns({f"{a}_below": F.col(a) < F.lit(float(v)) for a, v in limits.items() if v is not None and a in df.columns})


def oxides_to_elements(df: DataFrame, factors: dict[str, tuple[str, float]]) -> DataFrame:
    """Element columns from oxide columns by their factors."""
    return df.withColumns({e: F.col(o) * F.lit(f) for o, (e, f) in factors.items() if o in df.columns})
