"""The engine's inputs as views of the TPC-style tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = ["si", "al", "p", "k"]

SAMPLES = """SELECT concat_ws('.', CAST(l_orderkey AS {s}), CAST(l_linenumber AS {s}), CAST(l_partkey AS {s}), CAST(l_suppkey AS {s}), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS {s})) AS serial,
  CAST(l_suppkey AS {s}) AS site,
  CASE WHEN l_returnflag = 'R' THEN 'Background' WHEN l_linestatus = 'F' THEN 'CORRAL' ELSE 'CORAL' END AS type,
  CAST((l_suppkey * 7919) % 5000 + (l_orderkey % 97) AS DOUBLE) AS easting,
  CAST((l_suppkey * 104729) % 5000 + (l_linenumber * 13) % 89 AS DOUBLE) AS northing,
  l_quantity / 100 AS si, l_extendedprice / 100000 AS al, l_discount AS p, l_tax AS k
FROM {t}"""

PIXELS_SPARK = """SELECT CAST(floor(vec_id / 25) AS INT) AS r, CAST(vec_id % 25 AS INT) AS c,
  CAST(embedding[1] AS DOUBLE) AS blue, CAST(embedding[2] AS DOUBLE) AS green, CAST(embedding[3] AS DOUBLE) AS red,
  CAST(embedding[5] AS DOUBLE) AS rededge, CAST(embedding[7] AS DOUBLE) AS nir, CAST(embedding[10] AS DOUBLE) AS swir1,
  CAST(embedding[11] AS DOUBLE) AS swir2, embedding AS emb, label, CASE label % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS cls
FROM {t}"""
PIXELS_DUCK = PIXELS_SPARK
for _i in (11, 10, 7, 5, 3, 2, 1):
    PIXELS_DUCK = PIXELS_DUCK.replace(f"embedding[{_i}]", f"embedding[{_i + 1}]")

# a value that was rounded to zero counts as half of the last digit: its logarithm is defined in both engines
PAIRS = """SELECT event_id AS serial, user_id AS site, event_type AS type, ln(greatest(value, 0.005) / 50) AS y_true,
  ln(greatest(value, 0.005) / 50) * 0.5 + ((event_id * 7919) % 1000) / CAST(500.0 AS DOUBLE) - 1 AS y_pred
FROM {t}"""

#: The same views for the oracle.
DUCK = {
    "samples": SAMPLES.format(s="VARCHAR", t="lineitem"),
    "pixels": PIXELS_DUCK.format(t="embeddings"),
    "pairs": PAIRS.format(t="events"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql, t=table(spark, sf_dir, name))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SAMPLES.replace("{s}", "STRING"), "lineitem")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PIXELS_SPARK, "embeddings")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, PAIRS, "events")
