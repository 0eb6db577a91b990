"""Sinks: pixel tables by tile or index, metric files, run metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(pixels: DataFrame, path: str, tile: int = 256) -> None:
    """Partitioned by square tiles."""
    rows = pixels.withColumns({"tile_r": F.expr(f"r DIV {tile}"), "tile_c": F.expr(f"c DIV {tile}")})
    rows.repartition("tile_r", "tile_c").write.mode("overwrite").partitionBy("tile_r", "tile_c").parquet(path)


def row_blocks(pixels: DataFrame, path: str, rows: int = 1024) -> None:
    pixels.withColumn("block", F.expr(f"r DIV {rows}")).repartition("block").write.mode("overwrite").partitionBy("block").parquet(path)


def feature_stack(pixels: DataFrame, path: str, bands: dict, embedding: str | None = None, size: int = 64, tile: int = 256) -> None:
    """The feature stack of a raster, by tile."""
    from ..operators.raster import feature_stack as stack

    tiles(stack(pixels, bands, embedding, size), path, tile)


def text(spark, path: str, content: str) -> None:
    """One small text file (in a folder, as Spark writes it)."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def geojson(points: DataFrame, path: str, x: str, y: str) -> None:
    """Points as one FeatureCollection: one JSON value, so for tables of some thousand rows (sites, polygons)."""
    rest = [c for c in points.columns if c not in (x, y)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"))
    whole = points.select(feature.alias("f")).groupBy().agg(F.collect_list("f").alias("features"))
    rows = whole.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def prediction(pixels: DataFrame, path: str, columns: list[str] = ("pred",)) -> None:
    """One or more value columns (prediction, uncertainty) as floats."""
    row_blocks(pixels.select("r", "c", *[F.col(c).cast("float").alias(c) for c in columns]), path)


def indices(pixels: DataFrame, path: str, names: list[str]) -> DataFrame:
    """One partition for each index; returns (index, lo, hi) of finite values."""
    from ..operators.raster import finite_range

    long = pixels.select("r", "c", F.explode(F.array(*[F.struct(F.lit(n).alias("index"), F.col(n).cast("float").alias("value")) for n in names])).alias("x")).select("r", "c", "x.*")
    long.write.mode("overwrite").partitionBy("index").parquet(path)
    return finite_range(pixels, names)


def metrics_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def run_metadata(spark, path: str, meta: dict) -> None:
    rows = spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(path)
