"""Session plumbing shared by the corpus operators.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``; they are ordinary Parquet tables, so a
lost executor costs the tasks that were running on it and nothing else.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "_lodestrata_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per context (a no-op for workers that already import it)."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lodestrata")
    archive = os.path.join(folder, "lodestrata_workers.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"{package.name}/{p.relative_to(package)}")
    sc.addPyFile(archive)
    setattr(sc, _SHIPPED, True)


BATCH = {"maxRecordsPerBatch": 2000, "maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python from now on to about what is worked on at once: Spark's own bound is most of a
    task's rows, which then lie in the JVM's and the worker's memory several times.  Smaller bounds stay."""
    for name, most in BATCH.items():
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where the session names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestrata-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_SCOPES: dict[str, list[str]] = {}
_OPEN: list[str] = []


@contextmanager
def scope(name: str):
    """Tables that operators write in here can be released together."""
    _OPEN.append(name)
    try:
        yield
    finally:
        _OPEN.pop()


def release(spark: SparkSession, name: str) -> None:
    """Delete the tables of a scope: only once what was made from them is written itself."""
    for path in _SCOPES.pop(name, []):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def new_table(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _SCOPES.setdefault(_OPEN[-1], []).append(path)
    return path


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends at files that survive any executor."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that ``persist`` wrote and nothing reads any more."""
    remove(df.sparkSession, df.written_at)


def text_of(column: str = "text"):
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that clash with none of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"
"""Rows never learned from (null ids have no remainder and count as not held out)."""


def at_most(rows: int) -> int:
    """The bound of a sample of about ``rows`` rows: far above what chance gives, reached only where rows repeat."""
    return rows + rows // 10 + 100


def hash_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` rows of ``df`` (all if it has fewer), the same ones in every run: those whose hash of ``columns``
    is below a threshold that their number gives.  Never over ``at_most(rows)``, even where rows repeat, so that no task
    sends more than its share to the driver."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) < F.lit(int((1 << 40) * (rows / n)))).limit(at_most(rows))
