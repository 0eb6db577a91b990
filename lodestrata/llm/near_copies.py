"""Near copies by shingle similarity: the pipeline's own rule, beside the fingerprints of operator 5.

Texts are lower-cased (A-Z) and split at ASCII white space.  Two are near copies if the Jaccard similarity of their sets
of word shingles is ``similarity`` or more.  Candidates share one of the keys of a level, each of some minima of hashed
shingles: at a similarity of 0.8 a pair shares a key with probability 0.99993 at the first level, 0.9993 and 0.9991 at
those after (computed), and more above.  Every candidate is checked on the whole sets.

Documents that share a key are compared pair by pair, unless they are more than ``crowd``.  Those meet in rounds: first
each is compared with one document, the one that leads the most of its crowded keys, and near copies go; then each that
is left with ``CENTRES`` in a key, again until nothing goes.  What a key then holds are mostly texts that are alike but
less than ``similarity`` (a shared passage, a form): they take the keys of the next level, of more minima, that fewer
of them share.  Only what is still crowded at the last level is compared pair by pair.  A large group of near copies
goes in the first round, with one comparison a document, and no two documents that are kept are near copies and share
a key of the last level that both reach.

Defined results: texts without words stay; texts with fewer words than a shingle are one shingle; the row with the
smallest id is kept (null ids last), of equal ids the first as written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .textprep import slices
from .tokens import forget

CENTRES, CROWD = 4, 16
#: Keys and minima in a key, level by level.
LEVELS = ((24, 5), (64, 10), (200, 15))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, words: int) -> list[int]:
    """The distinct hashes of a text's word shingles."""
    from xxhash import xxh64_intdigest as h

    parts = text.encode().lower().split()
    if not parts:
        return []
    plain = b" ".join(parts)
    ends = list(accumulate(parts, lambda e, p: e + 1 + len(p), initial=-1))
    return list({h(plain[e + 1 : b], 42) for e, b in zip(ends, ends[min(words, len(parts)) :])})


def band_keys(sets: list[list[int]], bands: int, rows: int) -> np.ndarray:
    """A row of keys for each set that is not empty."""
    add, times = np.random.default_rng(bands).integers(0, 2**64, (2, bands * rows), np.uint64)
    times |= np.uint64(1)
    sizes = np.array([len(s) for s in sets])
    at, values = np.cumsum(sizes) - sizes, np.array([x for s in sets for x in s], np.uint64)
    out = np.empty((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            key = (key ^ np.minimum.reduceat((values ^ add[i]) * times[i], at)) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out.view(np.int64)


def _mapper(words: int, level: tuple[int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text", 1 << 20):  # a hash of each word takes a hundred bytes here
            found = [(rid, s) for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (s := shingles(text, words))]
            sets = [s for _, s in found]
            if not sets:
                continue
            lists = list(band_keys(sets, *level)) if level else [np.array(s, np.uint64).view(np.int64) for s in sets]
            columns = [pa.array([r for r, _ in found], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "n", "hashes"])

    return run


def _sets(texts: DataFrame, words: int, level: tuple[int, int] | None = None) -> DataFrame:
    """The hashed shingles of each text with words, or its keys at a level."""
    return texts.select("rid", common.text_of().alias("text")).mapInArrow(_mapper(words, level), "rid bigint, n int, hashes array<bigint>")


def _close(similarity: float):
    """What the sizes alone allow."""
    return F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")


def _candidates(members: DataFrame, crowd: int | None, similarity: float) -> DataFrame:
    """Distinct pairs (a < b) of ``members`` (key, rid, n, size) that share a key."""
    a, b = members.select("key", F.col("rid").alias("a"), F.col("n").alias("na")), members.select("key", F.col("rid").alias("b"), F.col("n").alias("nb"))
    if crowd is None:
        return a.join(b, "key").where((F.col("a") < F.col("b")) & _close(similarity)).select("a", "b").distinct()
    few, many = members.where(F.col("size") <= crowd), members.where(F.col("size") > crowd)
    calm = _candidates(few, None, similarity)
    centres = many.groupBy("key", F.pmod(F.xxhash64("key", "rid"), F.lit(CENTRES)).alias("slot")).agg(F.min(F.struct("rid", "n")).alias("c"))
    centres = centres.select("key", F.col("c.rid").alias("x"), F.col("c.n").alias("na"))
    stars = many.select("key", F.col("rid").alias("y"), F.col("n").alias("nb")).join(centres, "key").where((F.col("x") != F.col("y")) & _close(similarity))
    return calm.unionByName(stars.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _leaders(members: DataFrame, crowd: int, similarity: float) -> DataFrame:
    """One pair (a < b) for each row of a crowded key: with the document that is the first in the most of its keys, the
    likeliest near copy among them.  Rows of one group have the same few leaders whatever the key."""
    many = members.where(F.col("size") > crowd)
    first = many.groupBy("key").agg(F.min(F.struct("rid", "n")).alias("c")).select("key", F.col("c.rid").alias("x"), F.col("c.n").alias("na"))
    met = many.select("key", F.col("rid").alias("y"), F.col("n").alias("nb")).join(first, "key").where((F.col("x") != F.col("y")) & _close(similarity))
    met = met.groupBy("y", "x").agg(F.count("*").alias("shared"))
    best = met.groupBy("y").agg(F.max_by("x", F.struct("shared", -F.col("x"))).alias("x"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _checked(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose whole sets are as similar."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    sets = common.persist(_sets(texts.join(named, "rid", "left_semi"), words), "shingles")
    a = sets.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    b = sets.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("both") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _sized(members: DataFrame) -> DataFrame:
    """``members`` (key, rid, n) with the size of their key's group, without those alone."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return common.persist(members.join(sizes, "key"), "members")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, crowd: int = CROWD, rounds: int = 8) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    common.ship(docs.sparkSession)
    (rid,) = common.fresh(docs, "rid")
    kept = common.persist(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")  # the row numbers are now fixed
    texts = kept.select(F.col(rid).alias("rid"), "text")
    order = kept.select(F.col(rid).alias("rid"), "doc_id")
    gone: list[DataFrame] = []
    tried: list[DataFrame] = []

    def lose(pairs: DataFrame) -> bool:
        """Drop all but one of each group that the near ones among ``pairs`` make; whether there is one."""
        if tried:  # of a pair met before, one has gone or both are known to differ
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        tried.append(common.persist(pairs, "candidates"))
        edges = common.persist(_checked(tried[-1], texts, words, similarity), "near")
        if edges.isEmpty():
            return False
        roots = simhash.components(edges).select(F.col("node").alias("rid"), "root")
        named = roots.unionByName(roots.select(F.col("root").alias("rid"), "root")).distinct().join(order, "rid")
        first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
        gone.append(common.persist(named.join(first, "root").where("rid <> first.rid").select("rid"), "losers"))
        return True

    def left(rows: DataFrame, found: bool) -> DataFrame:
        """``rows`` without what went last."""
        return _sized(rows.select("key", "rid", "n").join(gone[-1], "rid", "left_anti")) if found else rows

    reach = texts
    for level in LEVELS:
        marked = common.persist(_sets(reach, words, level), "keys")
        members = _sized(marked.select(F.explode("hashes").alias("key"), "rid", "n"))
        if lose(_leaders(members, crowd, similarity)):
            members = left(members, True)
        for _ in range(rounds):
            found = lose(_candidates(members, crowd, similarity))
            members = left(members.where(F.col("size") > crowd), found)
            if not found:
                break
        if members.isEmpty():
            break
        if level == LEVELS[-1]:
            lose(_candidates(members, None, similarity))
        reach = texts.join(members.select("rid").distinct(), "rid", "left_semi")
    if not gone:
        return kept.select(*docs.columns)
    out = reduce(DataFrame.unionByName, gone)
    small = out.count() <= simhash.BROADCAST_ROWS
    out = out.select(F.col("rid").alias(rid))
    return kept.join(F.broadcast(out) if small else out, rid, "left_anti").select(*docs.columns)
