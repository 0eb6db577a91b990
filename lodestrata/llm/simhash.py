"""SimHash near-duplicates (operator 5) by multi-index hashing.

Texts are lower-cased (A-Z) and split at ASCII white space; a fingerprint bit is set if it is set in over half of the
XXH64 values (seed 42) of the word shingles, repeats included.  Fingerprints link at ``distance`` or fewer differing bits.

Two fingerprints within 3 bits have a half (32 of 64 bits) that differs in at most one bit.  So each distinct
fingerprint probes, for either half, the table of halves with the half itself and with every value that sets one of its
zero bits (of two halves one bit apart, one is such a value of the other); matches are verified over all 64 bits.

A half that more than ``crowd`` distinct fingerprints share is not joined pair by pair.  There, fingerprints meet at the
values around the other half instead: two within 3 bits have a value within one bit of one and two bits of the other,
and all that are within two bits of such a value link to the one within one bit.  Rows grow with the number of
fingerprints, not its square, and no link between components is lost.

Components come from alternating large-star and small-star rounds; each round's edges are a written table.

Defined results: null and empty texts have fingerprint zero and link like any other; texts with fewer words than a
shingle hash as one shingle; equal ids and repeated rows share components; an empty table gives no rows; the smallest id
of a component ignores null ids unless it has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .textprep import slices
from .tokens import forget

CROWD = 512
#: Row numbers that are broadcast to drop their rows; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_BITS = np.arange(64, dtype=np.uint64)


def fingerprints(texts: list[str], words: int = 3) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        parts = text.encode().lower().split()
        if parts:
            plain = b" ".join(parts)
            ends = list(accumulate(parts, lambda e, p: e + 1 + len(p), initial=-1))
            starts = [e + 1 for e in ends]
            size = min(words, len(parts))
            own = [h(plain[a:b], 42) for a, b in zip(starts, ends[size:])]
            counts[row] = len(own)
            hashes += own
    values = np.array(hashes, np.uint64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        at, n = (np.cumsum(counts) - counts)[full], counts[full]
        for bit in _BITS:
            ones = np.add.reduceat(((values >> bit) & np.uint64(1)).astype(np.int64), at)
            out[full] |= (2 * ones > n).astype(np.uint64) << bit
    return out.view(np.int64)


def _mapper(text: str, name: str, words: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, text, 1 << 20):  # a hash of each word takes a hundred bytes here
            columns = dict(zip(batch.schema.names, batch.columns))
            out = {k: columns[k] for k in keep}
            # the working text is the last column: one of the input may have the same name
            out[name] = pa.array(fingerprints(batch.column(batch.num_columns - 1).to_pylist(), words))
            yield pa.RecordBatch.from_pydict(out)

    return run


def with_fingerprint(docs: DataFrame, name: str = "fp", words: int = 3, drop_text: bool = False) -> DataFrame:
    """``docs`` with the fingerprint (its 64 bits as a long)."""
    common.ship(docs.sparkSession)
    (text,) = common.fresh(docs, "shingled")
    keep = [c for c in docs.columns if not (drop_text and c == "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    rows = docs.select(*([c for c in docs.columns if c in keep]), common.text_of().alias(text))
    return rows.mapInArrow(_mapper(text, name, words, keep), f"{schema}, `{name}` bigint")


def _half(side: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if side else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def _halves(nodes: DataFrame) -> DataFrame:
    """(key, fp): two rows for each fingerprint; a key is a half with its side above it."""
    return nodes.select(F.explode(F.array(*[_half(s).bitwiseOR(F.lit(s << 32)) for s in (0, 1)])).alias("key"), "fp")


def _of(key: Column, fp: Column) -> tuple[Column, Column]:
    """The half of a fingerprint on the key's side (as a key), and its other half."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    upper = key.bitwiseAND(F.lit(1 << 32)) != 0
    return F.when(upper, high.bitwiseOR(F.lit(1 << 32))).otherwise(low), F.when(upper, low).otherwise(high)


def _ball(value: Column, radius: int) -> Column:
    """All values within ``radius`` (0 to 2) bits of a 32-bit value."""
    flips = [0, *(1 << i for i in range(32) if radius), *((1 << i) | (1 << j) for i in range(32) for j in range(i) if radius > 1)]
    return F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: value.bitwiseXOR(x))


def _raised(value: Column) -> Column:
    """Values that set one of the zero bits."""
    bits = F.array(*[F.lit(1 << i).cast("bigint") for i in range(32)])
    return F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0), lambda b: value.bitwiseOR(b))


def links(nodes: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) within ``distance`` (0 to 3) bits: all of them outside
    crowded halves, enough of them for the same components inside."""
    halves = _halves(nodes)
    crowded = halves.groupBy("key").count().where(F.col("count") > crowd).select("key")
    probes = halves.unionByName(halves.select(F.explode(_raised(F.col("key"))).alias("key"), "fp"))
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    own = F.col("key") == _of(F.col("key"), F.col("a"))[0]
    calm = halves.join(crowded, "key", "left_anti").select("key", F.col("fp").alias("b"))
    pairs = probes.withColumnRenamed("fp", "a").join(calm, "key")
    edges = pairs.where((far <= distance) & (~own | (F.col("a") < F.col("b")))).select("a", "b")
    # crowded halves: meet around the other half
    there = probes.join(crowded, "key", "left_semi")
    mine, other = _of(F.col("key"), F.col("fp"))
    there = there.select("key", "fp", (F.col("key") == mine).alias("own"), other.alias("other"))

    def around(radius: int, centre: bool, kind: int) -> Column:
        return F.transform(_ball(F.col("other"), radius), lambda m: F.struct(m.alias("m"), F.lit(centre).alias("centre"), F.lit(kind).alias("kind")))

    same = there.where("own").select("key", "fp", F.explode(F.concat(around(1, True, 0), around(2, False, 0), around(1, True, 1))).alias("x"))
    lower = there.where("NOT own").select("key", "fp", F.explode(around(1, False, 1)).alias("x"))
    met = same.unionByName(lower).select("key", "x.m", "x.kind", "x.centre", "fp")
    centres = met.where("centre").groupBy("key", "m", "kind").agg(F.min("fp").alias("a"))
    stars = met.withColumnRenamed("fp", "b").join(centres, ["key", "m", "kind"])
    stars = stars.where((F.col("a") != F.col("b")) & (far <= distance)).select("a", "b").distinct()
    return edges.unionByName(stars)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with the smallest node of each component, for nodes that have an edge."""
    order = F.array_sort(F.array("a", "b"))
    edges = common.persist(edges.select(order[0].alias("v"), order[1].alias("u")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # large star: a node's larger neighbours go to the smallest of it and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, old = common.persist(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), edges
        common.drop(old)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def classes(marked: DataFrame, distance: int = 3, crowd: int = CROWD) -> DataFrame:
    """(fp, component_id, root) for each distinct fingerprint of ``marked`` (doc_id, fp)."""
    nodes = common.persist(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")
    roots = common.persist(components(links(nodes.select("fp"), distance, crowd)), "roots")
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, distance: int = 3, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each document."""
    slim = docs.select("doc_id", "text")
    marked = common.persist(with_fingerprint(slim, "fp", words, drop_text=True), "marked")
    out = marked.join(classes(marked, distance, crowd), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def keep_one(docs: DataFrame, distance: int = 3, words: int = 3, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, and of equal ids the first as written."""
    fp, rid = common.fresh(docs, "fp", "rid")
    marked = with_fingerprint(docs, fp, words).withColumn(rid, F.monotonically_increasing_id())
    marked = common.persist(marked, "marked")  # the row numbers are now fixed
    slim = marked.select(F.col(fp).alias("fp"), "doc_id", F.col(rid).alias("rid"))
    named = slim.join(classes(slim, distance, crowd).select("fp", "root"), "fp")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"))
    losers = named.join(first, "root").where("rid <> first.rid").select(F.col("rid").alias(rid))
    losers = common.persist(losers, "losers")
    small = losers.count() <= BROADCAST_ROWS
    return marked.join(F.broadcast(losers) if small else losers, rid, "left_anti").select(*docs.columns)
