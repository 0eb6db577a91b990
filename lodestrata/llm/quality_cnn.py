"""Quality classifier (operator 1): a byte-level convolutional network in NumPy.

Each byte is read with its position's repetition flag (the eight bytes from here equal those 2 to 32 bytes before) as a
one-hot input; learned filters of ``WIDTH`` bytes run at every ``STRIDE``-th place, and at the last one, of overlapping
chunks that cover the whole document.  A chunk's features are its filters' largest responses (rectified); a document's are the mean and the
largest over its chunks, combined into one logit.  Over one-hot inputs a convolution is a sum of table rows, so filters
are tables that are looked up; gradients reach only the places that won a pooling.

Training takes about ``TRAIN_ROWS`` labelled rows (a tenth and 100 more at most) of at most ``TRAIN_BYTES`` bytes each, a
documented bound (109 MB reach the driver at most): those with the smallest hash of their id, so every run learns the same.  Scoring reads every byte of every text.

Defined results: null and empty texts score like a text of one blank (the network's answer to no content); repeated rows
each get their row; without labelled rows of both kinds the score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textprep import raw, slices

WIDTH, STRIDE, CHUNK, STEP, FILTERS = 8, 2, 512, 256, 12
TRAIN_ROWS, TRAIN_BYTES = 3000, 32_000
_SYMBOLS = 512  # a byte, and the same byte inside a repetition


def symbols(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Input symbols of consecutive documents: the byte, plus 256 where it repeats what stands shortly before."""
    n = len(buf)
    out = buf.astype(np.int16)
    if n > 16:
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, 8)[:, :]).view(np.uint64).ravel()
        again = np.zeros(n, bool)
        for lag in range(2, 33):
            if lag < len(eight):
                again[lag : len(eight)] |= eight[lag:] == eight[:-lag]
        starts = offs[:-1]
        for k in range(32):  # what a document repeats lies inside it
            at = starts[starts + k < n] + k
            again[at] = False
        ends = offs[1:]
        for k in range(1, 8):  # nor do windows at its end reach into the next one
            at = ends[ends - k >= starts] - k
            again[at] = False
        out[again] += 256
    return out


class Network:
    def __init__(self, seed: int = 7, filters: int = FILTERS):
        r = np.random.default_rng(seed)
        self.tables = (r.standard_normal((WIDTH, _SYMBOLS, filters)) * 0.15).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.weight, self.offset = (r.standard_normal(2 * filters) * 0.3).astype(np.float32), np.float32(0)
        self.prior: float | None = None

    def _chunks(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and past-last response of each chunk, and each document's first chunk, by response numbers."""
        places = np.maximum(-(-(lengths - WIDTH) // STRIDE) + 1, 1)
        size, step = CHUNK // STRIDE, STEP // STRIDE
        n = np.maximum(-(-(places - size) // step), 0) + 1
        first = np.concatenate([[0], np.cumsum(n)])
        begin = (np.arange(first[-1]) - np.repeat(first[:-1], n)) * step
        end = np.minimum(begin + size, np.repeat(places, n))
        base = np.repeat(np.cumsum(places) - places, n)
        return base + begin, base + end, first

    def forward(self, buf: np.ndarray, offs: np.ndarray):
        """Logits of documents, and what training needs."""
        lengths = np.diff(offs)
        padded = np.maximum(lengths, WIDTH)
        to = np.concatenate([[0], np.cumsum(padded)])
        x = np.full(to[-1], 32, np.int16)
        x[np.arange(len(buf)) + np.repeat(to[:-1] - offs[:-1], lengths)] = symbols(buf, offs)
        places = -(-(padded - WIDTH) // STRIDE) + 1
        total = np.concatenate([[0], np.cumsum(places)])
        at = (np.arange(total[-1]) - np.repeat(total[:-1], places)) * STRIDE
        at = np.minimum(at, np.repeat(padded - WIDTH, places)) + np.repeat(to[:-1], places)  # the last place reads the last byte
        response = self.tables[0][x[at]]
        for k in range(1, WIDTH):
            response += self.tables[k][x[at + k]]
        begin, end, first = self._chunks(padded)
        # chunks overlap by half: pool blocks of a step, then neighbouring blocks
        pooled = np.maximum.reduceat(response, np.stack([begin, np.minimum(end, total[-1] - 1)], 1).ravel())[::2]
        tail = end == total[-1]
        if tail.any():
            pooled[tail] = np.maximum(pooled[tail], response[-1])
        hidden = np.maximum(pooled + self.bias, 0)
        n = np.diff(first)
        mean, most = np.add.reduceat(hidden, first[:-1]) / n[:, None], np.maximum.reduceat(hidden, first[:-1])
        pooled_doc = np.concatenate([mean, most], 1)
        logit = pooled_doc @ self.weight + self.offset
        return logit, (x, at, response, begin, end, first, pooled, hidden, mean, most, pooled_doc)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offs) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.forward(buf, offs)[0].astype(np.float64), -30, 30)))

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = 14, rate: float = 0.01, seed: int = 3) -> None:
        y = np.asarray(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.prior = float(y.mean()) if len(y) else 0.5
            return
        r = np.random.default_rng(seed)
        share = y.mean()
        each = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
        params = [self.tables, self.bias, self.weight]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(y)), max(1, len(y) // 48)):
                t += 1
                buf = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
                offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])])
                logit, (x, at, response, begin, end, first, pooled, hidden, mean, most, doc) = self.forward(buf, offs)
                error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * each[rows] / len(rows)
                grads = [np.zeros_like(self.tables), np.zeros_like(self.bias), doc.T @ error + 1e-3 * self.weight]
                f, n = len(self.bias), np.diff(first)
                owner = np.repeat(np.arange(len(rows)), n)
                back = (error / n)[owner, None] * self.weight[:f] + (hidden == most[owner]) * error[owner, None] * self.weight[f:]
                back *= hidden > 0
                grads[1] = back.sum(0)
                chunk, unit = np.nonzero(back)
                win = np.empty(len(chunk), np.int64)
                for j in np.unique(chunk):
                    own = chunk == j if len(chunk) < 64 else slice(*np.searchsorted(chunk, [j, j + 1]))
                    win[own] = begin[j] + response[begin[j] : max(end[j], begin[j] + 1)].argmax(0)[unit[own]]
                for k in range(WIDTH):
                    np.add.at(grads[0][k], (x[at[win] + k], unit), back[chunk, unit])
                for i, (p, g) in enumerate(zip(params, grads)):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    p -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
                self.offset -= np.float32(rate * error.sum() * 10)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Network:
    """Learn from a sample of the labelled rows that are not held out.  The sample is drawn from the labels' ids, so its
    size bounds what is broadcast, and no text is shuffled."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(f"NOT {common.HELD_OUT}")
    chosen = common.hash_sample(known.groupBy("doc_id").agg(F.max("quality").alias("quality")), rows, "doc_id").collect()
    network = Network()
    if not chosen:
        network.train([], np.zeros(0))
        return network
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, int(r.quality)) for r in chosen], "doc_id bigint, quality int")
    texts = docs.select("doc_id", common.text_of().alias("text")).where(F.octet_length("text") <= most_bytes)
    learned = texts.join(F.broadcast(chosen), "doc_id").limit(common.at_most(rows)).collect()
    learned.sort(key=lambda r: (r.doc_id, r.text))
    network.train([r.text.encode() for r in learned], np.array([r.quality for r in learned]))
    return network


def _scorer(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = shared.value
        for batch in slices(batches, text, 1 << 20):
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["score"] = pa.array(network.score(*raw(columns.pop(text))), pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` without its text, with ``score`` (0 to 1, higher: better)."""
    spark = docs.sparkSession
    common.ship(spark)
    rest = [c for c in docs.columns if c not in ("text", "score")]
    (text,) = common.fresh(docs, "scored_text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in rest)
    return docs.select(*rest, common.text_of().alias(text)).mapInArrow(_scorer(spark.sparkContext.broadcast(network), text), schema + "score double")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, network)
    return out.select("doc_id", F.coalesce(F.expr(common.HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
