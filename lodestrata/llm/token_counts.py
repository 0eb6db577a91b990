"""Token counts with a digest cache (operator 6).

Counts are stored under the digest of the normalised content, in one folder for each digest of a tokenizer's file.
Contents are joined to the stored counts, each distinct miss is encoded once, and the new counts are appended to the
cache.  The cache is an ordinary table that outlives the call; the query takes the one that the session names in
``spark.lodestrata.tokenCounts``, and an empty one of its own where none is named.

Defined results: null texts are empty and have no tokens; repeated rows each get their row; an empty table gives no rows
and leaves the cache as it was.  Other columns of the input are kept as they are; columns named as the results go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import common
from .textprep import slices
from .tokens import encoder

_CACHE = "digest binary, n_tokens bigint, tokenizer string"


def version(tokenizer: str) -> str:
    """A digest of the tokenizer's file: counts of another version are never taken for this one's."""
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def normalised(text: Column, blanks_dropped: bool) -> Column:
    """Content whose token count is the same: with blanks dropped, runs of blanks and newlines are one blank."""
    return F.trim(F.regexp_replace(text, "[ \n]+", " ")) if blanks_dropped else text


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _counter(path: str):
    def pieces(batches: Iterator[pa.RecordBatch]):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            for batch in slices(batches, "content"):
                yield batch, [len(x) for x in model.encode(batch.column(1).to_pylist(), num_threads=1)]
        else:
            enc = encoder(path)
            for batch in slices(batches, "content"):
                yield batch, np.diff(enc.encode(batch.column(1))[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, n in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, blanks_dropped: bool = False) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of its texts; new counts are appended to the table at ``cache``.

    ``cache_use`` of the result tells how many distinct contents there were and how many of them were misses."""
    spark = docs.sparkSession
    common.ship(spark)
    mine = version(tokenizer)
    docs = docs.drop("n_bytes", "n_tokens")
    stored = stored_counts(spark, cache).where(F.col("tokenizer") == mine).select(F.col("digest").alias("known"), F.lit(True).alias("hit"))
    key, content = common.fresh(docs, "digest", "content")
    text = common.text_of()
    # a hot content meets its copies on the map side: one row for each digest and task is shuffled
    distinct = docs.select(normalised(text, blanks_dropped).alias(content)).select(digest(F.col(content)).alias("digest"), content)
    distinct = distinct.groupBy("digest").agg(F.first(content).alias("content"))
    use = Observation()
    # two writers may have stored the same content: of equal counts the least is taken, here and below
    looked_up = distinct.join(stored.distinct(), F.col("digest") == F.col("known"), "left").observe(use, F.count("*").alias("contents"), F.count_if(F.col("hit").isNull()).alias("misses"))
    counted = looked_up.where("hit IS NULL").select("digest", "content").mapInArrow(_counter(tokenizer), "digest binary, n_tokens bigint")
    counted.withColumn("tokenizer", F.lit(mine)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored_counts(spark, cache).where(F.col("tokenizer") == mine)
    # written, so that both sides of the join are plain exchanges, whose hot partitions can be split
    counts = common.persist(counts.groupBy(F.col("digest").alias(key)).agg(F.min("n_tokens").alias("n_tokens")), "counts")
    rows = docs.withColumns({key: digest(normalised(text, blanks_dropped)), "n_bytes": F.octet_length(text).cast("bigint")})
    out = rows.join(counts, key).drop(key)
    out.cache_use = use.get
    return out


def stored_counts(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none if nothing has been stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.schema(_CACHE).parquet(cache) if there else spark.createDataFrame([], _CACHE)


def op6(spark, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    cache = spark.conf.get("spark.lodestrata.tokenCounts", "") or common.new_table(spark, "token-counts")
    out = count_tokens(docs, vocabulary("word_bpe_49k.json"), cache, blanks_dropped=True)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
