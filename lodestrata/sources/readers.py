"""Sources: GeoJSON, band metadata, remap and lookup tables, metric files, pixel tables."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as rows: properties as columns, a point's coordinates as x and y, a polygon's outer ring as ``ring``.

    A FeatureCollection is one JSON value and cannot be split: land it as Parquet once."""
    raw = spark.read.option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("ord", "f")).select("ord", "f.*")
    names = f.schema["properties"].dataType.names if "properties" in f.columns else []
    coords = f.schema["geometry"].dataType["coordinates"].dataType.simpleString()
    depth = coords.count("array<")
    if depth == 1:
        place = [F.col("geometry.coordinates")[0].alias("x"), F.col("geometry.coordinates")[1].alias("y")]
    elif depth == 3:
        place = [F.transform(F.col("geometry.coordinates")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring")]
    else:
        place = [F.col("geometry.coordinates").alias("coordinates")]
    return f.select("ord", *[F.col(f"properties.`{n}`").alias(n) for n in names], *place)


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def _eo_bands(meta: dict) -> list[dict]:
    bands = [b for a in meta.get("assets", {}).values() for b in a.get("eo:bands", [])]
    return bands or meta.get("eo:bands", [])


def band_names(spark: SparkSession, path: str, count: int, aliases: tuple[str, ...] = ()) -> list[str]:
    """Names from a sidecar file, or the first of its other names that is there; ``Band_1`` and so on where there is
    none, or it is broken or of another length."""
    for at in (path, *aliases):
        try:
            names = [b["name"] for b in _eo_bands(json.loads(_text(spark, at)))]
        except AnalysisException:  # no such file
            continue
        except (KeyError, TypeError, ValueError, AttributeError):
            break
        if len(names) == count:
            return names
        break
    return [f"Band_{i + 1}" for i in range(count)]


def band_index(spark: SparkSession, path: str) -> dict[str, int]:
    """common_name -> place; of duplicates the last counts."""
    bands = _eo_bands(json.loads(_text(spark, path)))
    if not bands:
        raise ValueError("the metadata has no bands")
    return {b["common_name"]: i for i, b in enumerate(bands) if b.get("common_name")}


def class_remap(spark: SparkSession, path: str) -> tuple[dict[int, int], int | None, dict[int, str]]:
    meta = json.loads(_text(spark, path))
    return {int(k): int(v) for k, v in meta["remap"].items()}, meta.get("reference_class"), {int(k): v for k, v in meta.get("class_names", {}).items()}


def metrics_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("header", True).csv(path)
    except AnalysisException:
        return None


def lod_table(spark: SparkSession, path: str) -> dict[str, float | None]:
    return {k: None if v is None else float(v) for k, v in json.loads(_text(spark, path)).items()}


def oxide_table(spark: SparkSession, path: str) -> dict[str, tuple[str, float]]:
    return {r["Oxide"]: (r["Element"], float(r["Factor"])) for r in json.loads(_text(spark, path))}


def pixels(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("r", "c", *bands) if bands else df


def embeddings(spark: SparkSession, path: str, prefix: str = "Emb_A", size: int = 64) -> DataFrame:
    """A landed embedding raster (r, c, embedding) as one column for each band."""
    df = spark.read.parquet(path)
    return df.select("r", "c", *[F.get("embedding", F.lit(i)).alias(f"{prefix}{i:02d}") for i in range(size)])
