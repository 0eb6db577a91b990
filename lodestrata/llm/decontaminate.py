"""Benchmark decontamination (operator 8): a broadcast set of test n-grams, scanned over training token windows.

Words of a document that are in the benchmark's vocabulary get its word numbers; only where a whole window of them
stands is the window's hash looked up, and every hit is verified word by word.  Windows are of ``n`` words; an item with
fewer words is one window of its own length.

What is broadcast is a block of items of ``block_bytes`` of UTF-8 text (or one longer item): its words, and for each
window a hash and a place, about 16 bytes a word, as arrays.  A larger benchmark is scanned block by block; each pass
writes its hits alone, and these meet the documents in one join at the end.  Memory depends on one block, never on the
benchmark's size.

Defined results: null and empty texts have no words and no hits; repeated rows and equal ids each get their row; an
empty benchmark marks nothing; an item whose id is null is listed as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textprep import ALNUM, LOWER, Words, gather_ranges, index_in, raw, slices
from .tokens import forget

BLOCK_BYTES = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of word numbers (columns in order)."""
    h = np.zeros(rows.shape[0], np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ (rows[:, k].astype(np.uint64) + np.uint64(1))) * _ODD
        h ^= h >> np.uint64(29)
    return h


class Grams:
    """The windows of a block of items, by length: sorted hashes, and where in the block's words each window stands."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.ids = [name for name, _ in items]
        buf, offs = raw(pa.array([t or "" for _, t in items], pa.string()))
        words = Words(LOWER[buf] if len(buf) else buf, offs, ALNUM)
        coded = words.column().dictionary_encode()
        self.vocabulary: pa.Array = coded.dictionary
        self.numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        self.first, counts = words.first, words.counts()
        each = np.minimum(counts, n)  # the length of an item's windows
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(each[each > 0]).tolist():
            own = np.flatnonzero(each == size)
            at, _ = gather_ranges(words.first[own], counts[own] - size + 1)
            h = self._hashes(at, size)
            order = np.argsort(h, kind="stable")
            self.lengths[size] = h[order], at[order].astype(np.int32)

    def _hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([_hash(self.numbers[at[k : k + 65536, None] + np.arange(size)]) for k in range(0, len(at), 65536)])

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words are hit, and the items found in each row."""
        hit, items = np.zeros(len(words), bool), {}
        if not len(words) or not self.lengths:
            return hit, items
        number = index_in(words.column(), self.vocabulary)
        known = number >= 0
        row_end = np.repeat(words.first[1:], words.counts())
        run = np.zeros(len(words) + 1, np.int64)
        np.cumsum(~known, out=run[1:])
        for size, (hashes, places) in self.lengths.items():
            if size > len(words):
                continue
            at = np.flatnonzero((run[size:] == run[:-size]) & (np.arange(len(words) - size + 1) + size <= row_end[: len(words) - size + 1]))
            if not len(at):
                continue
            windows = number[at[:, None] + np.arange(size)]
            h = _hash(windows)
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo):
                same = places[lo[k] : hi[k]]
                same = same[(self.numbers[same[:, None] + np.arange(size)] == windows[k]).all(1)]
                if len(same):
                    hit[at[k] : at[k] + size] = True
                    row = int(np.searchsorted(words.first, at[k], "right")) - 1
                    items.setdefault(row, set()).update((np.searchsorted(self.first, same, "right") - 1).tolist())
        return hit, items


_SCAN = "n_words bigint, n_hit bigint, hits array<int>, items array<string>"


def merged(spans: list[int]) -> list[int]:
    """Place pairs in order, overlapping ones joined."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scanner(shared, text: str, hits_only: bool):
    """Adds the words hit (as place pairs: first, past the last) and the items found to each row, or to rows that have
    any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        grams: Grams = shared.value
        for batch in slices(batches, text):
            buf, offs = raw(batch.column(batch.schema.get_field_index(text)))
            words = Words(LOWER[buf] if len(buf) else buf, offs, ALNUM)
            hit, items = grams.scan(words)
            spans = [[] for _ in range(batch.num_rows)]
            for row in np.unique(np.searchsorted(words.first, np.flatnonzero(hit), "right") - 1):
                own = np.concatenate([[0], hit[words.first[row] : words.first[row + 1]].astype(np.int8), [0]])
                edge = np.diff(own)
                spans[row] = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1).ravel().tolist()
            found = [sorted({grams.ids[i] for i in items.get(row, ())}) for row in range(batch.num_rows)]
            columns = dict(zip(batch.schema.names, batch.columns))
            if hits_only:
                columns.pop(text)
            n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
            columns |= {"n_words": pa.array(words.counts(), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hits": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))}
            out = pa.RecordBatch.from_pydict(columns)
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if hits_only else out

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several blocks' hits as one: overlapping places joined."""
    for batch in batches:
        spans = [merged([p for own in row for p in own]) for row in batch.column(1).to_pylist()]
        n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), pa.array(spans, pa.list_(pa.int32())), batch.column(2)], ["rid", "n_hit", "hits", "items"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        length = len(r.t.encode())
        if block and size + length > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += length
    yield block


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (null texts read as empty) with ``n_words``, ``n_hit``, ``hits`` and ``items``; columns so named go."""
    spark = docs.sparkSession
    common.ship(spark)
    out = docs.drop("n_words", "n_hit", "hits", "items").withColumn("text", common.text_of())
    types = lambda df: "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    blocks = _blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return out.mapInArrow(_scanner(spark.sparkContext.broadcast(Grams(block, n)), "text", False), types(out) + _SCAN)
    (rid,) = common.fresh(out, "rid")
    rows = common.persist(out.withColumn(rid, F.monotonically_increasing_id()), "decontamination")  # row numbers are now fixed
    slim, found = rows.select(F.col(rid).alias("rid"), "text"), []
    while block is not None:
        shared = spark.sparkContext.broadcast(Grams(block, n))
        found.append(common.persist(slim.mapInArrow(_scanner(shared, "text", True), f"rid bigint, {_SCAN}"), "hits"))
        shared.destroy()
        block, following = following, next(blocks, None)
    every = spark.read.schema(found[0].schema).parquet(*[x.written_at for x in found])
    several = every.groupBy("rid").agg(F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    several = common.persist(several.mapInArrow(_merger, "rid bigint, n_hit bigint, hits array<int>, items array<string>"), "merged-hits")
    for table in found:
        common.drop(table)
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counted = rows.withColumn("n_words", F.regexp_count(plain, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("bigint"))
    both = counted.join(several.withColumnRenamed("rid", f"{rid}_hit"), F.col(rid) == F.col(f"{rid}_hit"), "left")
    empty = {"n_hit": F.lit(0).cast("bigint"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    return both.withColumns({k: F.coalesce(k, v) for k, v in empty.items()}).select(*out.columns, "n_words", *empty)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        place = batch.schema.get_field_index("text")
        buf, offs = raw(batch.column(place))
        words = Words(LOWER[buf] if len(buf) else buf, offs, ALNUM)
        texts, spans = batch.column(place).to_pylist(), batch.column(batch.schema.get_field_index("hits")).to_pylist()
        for row, hits in enumerate(spans):
            if hits:
                own, raw_text = words.first[row], buf[offs[row] : offs[row + 1]].tobytes()
                keep, at = [], 0
                for a, b in sorted(zip(hits[::2], hits[1::2])):
                    lo, hi = int(words.start[own + a] - offs[row]), int(words.end[own + b - 1] - offs[row])
                    keep.append(raw_text[at:lo] if lo > at else b"")
                    at = max(at, hi)
                texts[row] = b"".join([*keep, raw_text[at:]]).decode()
        columns = dict(zip(batch.schema.names, batch.columns)) | {"text": pa.array(texts, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


def remove_spans(scanned: DataFrame) -> DataFrame:
    """Scanned documents with the words hit cut out of their texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema)
    return scanned.mapInArrow(_cutter, schema)


def remove_documents(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.size("hits") == 0)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH it AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
x AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)),
h AS (SELECT r, x.size, i, item_id FROM x JOIN g USING (size, gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
