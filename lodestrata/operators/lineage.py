"""Cutting lineage: tables in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``; a temporary one in local sessions only."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestrata-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestrata/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch(df.sparkSession, "lineage")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of so many short rows, as a side of a join: a broadcast up to ``BROADCAST_ROWS``, else a shuffle.  Either way
    the other side is never broadcast: where rows are exploded, the optimizer takes them for as few as before."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def drop(df: DataFrame) -> None:
    """Delete a table that ``cut`` wrote and nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per context (a no-op for workers that already import it)."""
    sc, mark = spark.sparkContext, "_lodestrata_shipped"
    if getattr(sc, mark, False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="lodestrata"), f"{package.name}_workers.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(archive)
    setattr(sc, mark, True)
