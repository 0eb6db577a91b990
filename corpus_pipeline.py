"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, line_dedup, near_copies, packing, quality_rules, simhash
from lodestrata.llm.tokens import vocabulary


def stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage frees the working tables of the stage before, whose result is a written table by then, and sends small batches
    to Python."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = f"pipeline {sf_dir}"
        common.release(spark, name)
        common.small_batches(spark)
        with common.scope(name):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those that lose all their lines go."""
    out = line_dedup.dedup_lines(docs).where("NOT emptied").select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or nearly equal fingerprints, then one of each group of near copies."""
    return near_copies.keep_one(simhash.keep_one(docs))


@stage
def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    (row,) = common.fresh(docs, "own")
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias(row), "text")
    clean = decontaminate.remove_documents(decontaminate.scan(packed, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return clean.select(f"{row}.*", "text").select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    return packing.digests(packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), 2048, end_id=1))


STAGES = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]

#: XXH64 fingerprints can't be had in SQL: the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = common.persist(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
