"""Sequence packing (operator 7) by non-negative least squares.

Documents are cut into full windows; what remains of each is shorter than a window.  For each group of consecutive
documents, all combinations of up to three remainder lengths that fill a window exactly are enumerated (threes only of
lengths that pairs leave over), repeat counts are fitted to the histogram of remainder lengths by non-negative least
squares to a tolerance, rounded and kept feasible; the remainders left over are packed greedily, cut where a window ends.  The last, unfilled window of a group is split into sequences
whose lengths are powers of two, which need no padding.

A group is a bounded number of ids of one task, so memory is bounded, no text is shuffled, and a lost task is redone
alone.  A group's short end costs at most one sequence for each power of two below the window.

Defined results: null and empty texts hold the end id alone (or nothing, without one: no piece); rows with equal or null
ids are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textprep import slices
from .tokens import encoder

GROUP_IDS = 4 << 20
_PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, part int, seq bigint, offset bigint"


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """All combinations that can matter, as rows of three lengths (0: none): pairs that fill a window, threes of lengths
    that the pairs leave over (by how often they can be used), and single lengths that are powers of two."""
    have = np.flatnonzero(histogram)
    ones = have[have & (have - 1) == 0]
    low = have[(have <= window - have) & (histogram[window - have] > 0)]
    pairs = np.stack([low, window - low], 1)
    left = histogram.copy()
    for a, b in pairs.tolist():
        m = min(left[a], left[b]) if a != b else left[a] // 2 * 2
        left[a] -= m
        left[b] -= m if a != b else 0
    have, threes = np.flatnonzero(left), [np.zeros((0, 4), np.int64)]
    for a in have[have <= window // 3]:
        b = have[(have >= a) & (have <= (window - a) // 2)]
        b = b[left[window - a - b] > 0]
        c = window - a - b
        threes.append(np.stack([np.full(len(b), a), b, c, np.minimum(np.minimum(left[a], left[b]), left[c])], 1))
    found = np.concatenate(threes)
    found = found[np.argsort(-found[:, 3], kind="stable"), :3]
    return np.concatenate([np.pad(pairs, ((0, 0), (0, 1))), found, np.pad(ones[:, None], ((0, 0), (0, 2)))]).astype(np.int64)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, tolerance: float = 1e-3) -> np.ndarray:
    """Non-negative least squares of combination counts against the histogram, by coordinate descent over the
    coordinates that still want to move, until a round lowers the sum of squares by less than ``tolerance`` of it."""
    rest, x = histogram.astype(float), np.zeros(len(combos))
    rest[0] = 0.0
    a, b, c = combos.T
    twins = (a == b).astype(int) + (b == c) * (b > 0) + (a == c)  # a length that stands twice counts four
    norm = (combos > 0).sum(1) + 2.0 * twins
    before = float(rest @ rest)
    while before > 0:
        slope = rest[combos].sum(1)
        todo = np.flatnonzero((slope > 1e-9) | ((slope < -1e-9) & (x > 0)))
        now, found = rest.tolist(), []
        for (p, q, r), old, size in zip(combos[todo].tolist(), x[todo].tolist(), norm[todo].tolist()):
            new = old + (now[p] + now[q] + now[r]) / size
            if new < 0.0:
                new = 0.0
            if new != old:
                step = new - old
                now[p] -= step
                now[q] -= step
                now[r] -= step
                now[0] = 0.0
            found.append(new)
        x[todo], rest = found, np.array(now)
        after = float(rest @ rest)
        if before - after <= tolerance * before:
            break
        before = after
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations and how often each is used; together they never use a length more often than it occurs."""
    combos = combinations(histogram, window)
    x = repeat_counts(histogram, combos)
    left, out = histogram.tolist(), []
    used = np.flatnonzero(x >= 0.5)
    used = used[np.argsort(-x[used], kind="stable")]
    for times, row in zip(x[used].tolist(), combos[used].tolist()):
        combo = tuple(v for v in row if v)
        n = int(times + 0.5)
        for a in set(combo):
            n = min(n, left[a] // combo.count(a))
        if n > 0:
            out.append((combo, n))
            for a in combo:
                left[a] -= n
    return out


def pack(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths."""
    out, seq = [], 0
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - window + 1, window):
            out.append((d, start, window, seq, 0))
            seq += 1
    rest = lengths % window
    waiting = defaultdict(list)
    for d in np.flatnonzero(rest)[::-1].tolist():
        waiting[int(rest[d])].append(d)
    for combo, n in plan(np.bincount(rest, minlength=window + 1) * (np.arange(window + 1) > 0), window):
        for _ in range(n):
            at = 0
            for a in combo:
                d = waiting[a].pop()
                out.append((d, int(lengths[d]) - a, a, seq, at))
                at += a
            seq += 1
    left = [(d, int(lengths[d]) - a, a) for a in sorted(waiting, reverse=True) for d in reversed(waiting[a])]
    full = sum(a for _, _, a in left) // window
    tail = sum(a for _, _, a in left) % window
    sizes = iter([window] * full + [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1])
    size, at = next(sizes, 0), 0
    for d, start, a in left:
        while a:
            take = min(a, size - at)
            out.append((d, start, take, seq, at))
            start, a, at = start + take, a - take, at + take
            if at == size:
                size, at, seq = next(sizes, 0), 0, seq + 1
    return out


def _packer(path: str, end_id: int | None, window: int, group_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, enc = TaskContext.get().partitionId(), 0, encoder(path)
        held, names, sizes = [], [], []

        def flush(before: int):
            ids, lengths = np.concatenate(held).astype("<u4", copy=False), np.concatenate(sizes)
            held.clear()
            first, pieces = np.cumsum(lengths) - lengths, pack(lengths, window)
            d, start, length, seq, at = (np.array(x, np.int64) for x in zip(*pieces)) if pieces else [np.zeros(0, np.int64)] * 5
            lo = first[d] + start
            for k in range(0, len(d), 512):  # at most 4 MB of ids in a batch of whole windows
                cut = slice(k, k + 512)
                yield int(seq.max(initial=-1)) + 1, pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([names[i] for i in d[cut]], pa.int64()),
                    "start": start[cut],
                    "length": length[cut],
                    "ids": pa.array([ids[a:b].tobytes() for a, b in zip(lo[cut], (lo + length)[cut])], pa.binary()),
                    "doc_tokens": lengths[d[cut]],
                    "part": pa.array(np.full(len(d[cut]), part), pa.int32()),
                    "seq": seq[cut] + before,
                    "offset": at[cut],
                })

        def emit():
            nonlocal before, held, names, sizes
            n = 0
            for n, batch in flush(before):
                yield batch
            before, held, names, sizes = before + n, [], [], []

        for batch in slices(batches, "text"):
            ids, offs = enc.encode(batch.column(1))
            if end_id is not None:
                ids = np.insert(ids, offs[1:], end_id)
                offs = offs + np.arange(len(offs))
            held.append(ids)
            names.extend(batch.column(0).to_pylist())
            sizes.append(np.diff(offs))
            if sum(map(len, held)) >= group_ids:
                yield from emit()
        if names:
            yield from emit()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int | None = None, group_ids: int = GROUP_IDS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_of().alias("text"))
    pieces = common.persist(rows.mapInArrow(_packer(tokenizer, end_id, window, group_ids), _PIECES), "pieces")
    # one row for each task of the scan: what the driver keeps for a task is larger
    parts = pieces.groupBy("part").agg((F.max("seq") + 1).alias("n"))
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    out = pieces.join(F.broadcast(parts), "part")
    return out.select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("seq") + F.col("base")).alias("sequence_id"), "offset")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7(spark, sf_dir: str) -> DataFrame:
    from .tokens import vocabulary

    return digests(pack_documents(common.documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), 2048, end_id=1))
