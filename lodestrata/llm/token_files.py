"""Token-id files (operator 4): compressed segments of whole documents in ascending document order.

The container is a Parquet table, one row for each segment: ``part``, ``seg`` and ``before`` (the ids of the part's
earlier segments) give its place, ``doc_ids`` and
``lengths`` its documents, ``blob`` the coded ids (see ``idcodec``).  Spark's committer writes it, so a lost executor
leaves no half-written file.

Defined results: null texts are empty; an empty text gives the end id alone; rows with equal or null ids keep one place
each (nulls first, equal ids in the order of their text); an empty table gives an empty set of files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, idcodec
from .textprep import SLICE_BYTES, slices
from .tokens import encoder

SEGMENT_IDS = 8 << 20  # 2048 blocks, coded side by side
_SEGMENTS = "part int, seg int, before bigint, doc_ids array<bigint>, lengths array<int>, blob binary"
_DOCS = "part int, place bigint, doc_id bigint, n_tokens bigint, ids binary"


def _coder(path: str, end_id: int | None, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, before = TaskContext.get().partitionId(), 0, 0
        enc, held, names, lengths, total = encoder(path, 600_000), [], [], [], 0

        def flush():
            row = {"part": [part], "seg": [seg], "before": [before], "doc_ids": [names], "lengths": [lengths], "blob": [idcodec.encode(np.concatenate(held))]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary())]))

        for batch in slices(batches, "text", 2 * SLICE_BYTES):  # larger slices hold fewer distinct pieces in all
            ids, offs = enc.encode(batch.column(1))
            if end_id is not None:
                ids = np.insert(ids, offs[1:], end_id)
                offs = offs + np.arange(len(offs))
            for lo, hi, name in zip(offs[:-1].tolist(), offs[1:].tolist(), batch.column(0).to_pylist()):
                held.append(ids[lo:hi])
                names.append(name)
                lengths.append(hi - lo)
                total += hi - lo
                if total >= segment_ids:
                    yield flush()
                    before, seg = before + total, seg + 1
                    held, names, lengths, total = [], [], [], 0
        if names:
            yield flush()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = idcodec.decode(row["blob"])
            ends = np.cumsum(np.array(row["lengths"], np.int64))
            starts = ends - np.array(row["lengths"], np.int64)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([row["part"]] * len(ends), pa.int32()),
                "place": pa.array(starts + row["before"]),
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "n_tokens": pa.array(ends - starts),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            })


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode ``docs`` (doc_id, text) and write its files under ``path``, documents in ascending ``doc_id``."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_of().alias("text"))
    key = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id"), key).sortWithinPartitions(F.col("doc_id"), key)
    rows.mapInArrow(_coder(tokenizer, end_id, segment_ids), _SEGMENTS).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Documents from files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian u32)."""
    common.ship(spark)
    files = spark.read.schema(_SEGMENTS).parquet(path)
    # a part's size stands in its last segment; parts are as many as there were tasks
    n = F.col("before") + F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = files.select("part", n.alias("n")).groupBy("part").agg(F.max("n").alias("n"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    docs = files.mapInArrow(_reader, _DOCS).join(F.broadcast(parts), "part")
    return docs.select("doc_id", (F.col("place") + F.col("base")).alias("start"), "n_tokens", "ids")


def op4(spark, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary

    path = common.new_table(spark, "token-files")
    write(common.documents(spark, sf_dir), path, vocabulary("word_bpe_49k.json"), end_id=2)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
