"""Language identification (operator 9): script ranges, then Viterbi over words.

Each word's script (by code point ranges) narrows the languages it can be in to those that were seen in that script.
Words are scored under each of these by byte n-grams (1 to 4, with the word's bounds) learned from labelled texts, and
Viterbi with a penalty for switching labels each word, so that texts in several languages fall into spans.  A text's
language is the one with most letters in its spans; the score is its share of them.

About ``TRAIN_ROWS`` labelled rows (a tenth and 100 more at most) of at most ``TRAIN_BYTES`` bytes are learned from (a
documented bound: 109 MB reach the driver at most): those with the smallest hash of their id and text.  Every word of every text is scored.

Defined results: null texts and texts without a letter are ``und`` with score 0; repeated rows each get their row;
without labelled texts every text is ``und``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textprep import NON_SPACE, Words, raw, slices

TRAIN_ROWS, TRAIN_BYTES = 3000, 32_000
SWITCH, BUCKETS = 6.0, 1 << 18
UNKNOWN = "und"
#: Scripts by ranges of code points (first, last).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}


def script(word: str) -> str | None:
    """The script of most letters; None without a letter, ``other`` outside the ranges."""
    found = Counter()
    for c in word:
        if c.isalpha():
            found[next((s for s, ranges in SCRIPTS.items() if any(a <= ord(c) <= b for a, b in ranges)), "other")] += 1
    return found.most_common(1)[0][0] if found else None


def gram_sums(words: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each word, the sum of ``table``'s rows over its hashed byte n-grams (1 to 4, between bounds), over the root of
    their number."""
    bounded = pc.binary_join_element_wise("<", pc.utf8_lower(words), ">", "")
    buf, offs = raw(bounded)
    out = np.zeros((len(buf), table.shape[1]), np.float32)
    for h, ok in gram_hashes(buf, offs):
        out[ok] += table[h[ok]]
    size = np.diff(offs)
    return np.add.reduceat(out, offs[:-1]) / np.sqrt(4.0 * size - 6)[:, None].astype(np.float32)


def gram_hashes(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to 4: the bucket of the n bytes from each place, and whether they lie inside one word."""
    ends = np.repeat(offs[1:], np.diff(offs))
    h, at = np.zeros(len(buf), np.uint32), np.arange(len(buf))
    for n in range(4):
        h[: len(buf) - n] = (h[: len(buf) - n] + buf[n:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        yield (h % np.uint32(BUCKETS)).astype(np.int64), at + n < ends


def letters_and_scripts(words: pa.Array) -> tuple[np.ndarray, list[str | None]]:
    """Letters and script of each word.  Words of ASCII and Latin letters are counted by their bytes."""
    buf, offs = raw(words)
    lead = (buf >= 0xC3) & (buf <= 0xC9)
    if len(buf) > 1:
        sign = (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7))
        lead[:-1] &= ~sign
    letter = lead | ((buf | 32) >= 97) & ((buf | 32) <= 122) & (buf < 128)
    other = (buf == 0xC2) | (buf > 0xC9)
    count, strange = (np.add.reduceat(x.astype(np.int64), offs[:-1]) if len(buf) else np.zeros(len(words), np.int64) for x in (letter, other))
    scripts: list[str | None] = ["latin" if n else None for n in count.tolist()]
    for i in np.flatnonzero(strange):
        word = words[int(i)].as_py()
        count[i], scripts[i] = sum(map(str.isalpha, word)), script(word)
    return count, scripts


class Model:
    """Log scores of n-gram buckets for each language, less their mean: words add up to evidence."""

    def __init__(self, texts: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in texts})
        k = len(self.languages)
        counts = np.zeros((BUCKETS, max(k, 1)))
        seen: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(max(k, 1)))
        for place, lang in enumerate(self.languages):
            words = Counter(w for text, x in texts if x == lang for w in text.split())
            if not words:
                continue
            column, times = pa.array(list(words), pa.string()), np.fromiter(words.values(), float, len(words))
            letters, scripts = letters_and_scripts(column)
            for s, n in zip(scripts, times):
                if s:
                    seen[s][place] += n
            buf, offs = raw(pc.binary_join_element_wise("<", pc.utf8_lower(column), ">", ""))
            each = np.repeat(np.sqrt(times) * (letters > 0), np.diff(offs))  # a frequent word tells less each time
            for h, ok in gram_hashes(buf, offs):
                counts[:, place] += np.bincount(h[ok], each[ok], BUCKETS)
        share = sum(seen.values(), np.zeros(max(k, 1)))
        self.scripts = {s: (n >= 5) | (n >= 0.001 * np.maximum(share, 1)) for s, n in seen.items()}
        logs = np.log((counts + 0.5) / (counts.sum(0) + 1))
        self.scores = (logs - logs.mean(1, keepdims=True)).astype(np.float32)

    def rows(self, words: pa.Array) -> np.ndarray:
        """Scores of each word for each language (zero without a letter or a language in its script), then its letters."""
        k = len(self.languages)
        out = np.zeros((len(words), k + 1), np.float32)
        if not len(words):
            return out
        letters, scripts = letters_and_scripts(words)
        if k:
            evidence = gram_sums(words, self.scores)
            allowed = np.ones((len(words), k), bool)
            for s in set(scripts):
                if s != "latin" or not self.scripts.get(s, np.zeros(k, bool)).all():
                    allowed[np.array([x == s for x in scripts])] = self.scripts.get(s, np.zeros(k, bool))
            some = allowed.any(1) & (letters > 0)
            evidence = np.where(allowed, evidence, evidence.min(1, keepdims=True) - 20)
            out[some, :k] = (evidence - evidence.max(1, keepdims=True))[some]
        out[:, k] = letters
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, rows side by side (longest first).  A tie stays; else the first language wins."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    n, k = scores.shape
    came = np.full(n, -1, np.int8 if k < 128 else np.int32)  # the label before, where the path switched into the best one
    stay = np.zeros((n, k), bool)
    labels = np.zeros(n, np.int64)
    best = np.zeros((len(order), k), np.float32)
    most = int(counts.max(initial=0))
    live = np.searchsorted(-counts, -np.arange(most), "left")
    for t in range(most):
        at = begin[: live[t]] + t
        now = best[: live[t]]
        top = now.argmax(1)
        leap = now[np.arange(live[t]), top][:, None] - np.float32(switch)
        came[at] = top
        stay[at] = now >= leap
        np.maximum(now, leap, out=now)
        now += scores[at]
    state = best.argmax(1)
    for t in range(most - 1, -1, -1):
        at = begin[: live[t]] + t
        now = state[: live[t]]
        labels[at] = now
        kept = stay[at, now]
        state[: live[t]] = np.where(kept, now, came[at])
    return labels


def _labeller(shared, text: str, switch: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        k = len(model.languages)
        for batch in slices(batches, text, 2 << 20):
            columns = dict(zip(batch.schema.names, batch.columns))
            buf, offs = raw(columns.pop(text))
            words = Words(buf, offs, NON_SPACE)
            coded = words.column().dictionary_encode()
            rows = model.rows(coded.dictionary)
            each = rows[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros((0, k + 1), np.float32)
            letters = each[:, k].astype(np.float64)
            labels = viterbi(np.ascontiguousarray(each[:, :k]), words.first, switch) if k and len(words) else np.zeros(len(words), np.int64)
            totals = np.zeros((batch.num_rows, max(k, 1)))
            np.add.at(totals, (np.repeat(np.arange(batch.num_rows), words.counts()), labels), letters)
            all_letters, top = totals.sum(1), totals.argmax(1)
            known = (all_letters > 0) & (k > 0)
            columns["lang_pred"] = pa.array([model.languages[i] if ok else UNKNOWN for i, ok in zip(top, known)], pa.string())
            columns["score"] = pa.array(np.where(known, totals[np.arange(batch.num_rows), top] / np.maximum(all_letters, 1), 0.0))
            if spans:
                found = []
                for row in range(batch.num_rows):
                    lo, hi = words.first[row], words.first[row + 1]
                    cuts = np.flatnonzero(np.diff(labels[lo:hi])) + 1
                    edges = [0, *cuts.tolist(), int(hi - lo)] if hi > lo and k else [0]
                    found.append([{"lang": model.languages[labels[lo + a]], "first": a, "past": b} for a, b in zip(edges, edges[1:])])
                columns["spans"] = pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("past", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from texts with a language that are not held out."""
    pool = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(f"NOT coalesce({common.HELD_OUT}, false)")
    pool = pool.where(F.octet_length("text") <= most_bytes).select("doc_id", "text", "lang")
    learned = common.hash_sample(pool, rows, "doc_id", "text").collect()
    return Model(sorted((r.text, r.lang) for r in learned))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """``docs`` without its text, with lang_pred, score and the labelled spans (by word places)."""
    spark = docs.sparkSession
    common.ship(spark)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "spans")]
    (text,) = common.fresh(docs, "labelled_text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in rest) + "lang_pred string, score double"
    schema += ", spans array<struct<lang: string, first: bigint, past: bigint>>" * spans
    return docs.select(*rest, common.text_of().alias(text)).mapInArrow(_labeller(spark.sparkContext.broadcast(model), text, switch, spans), schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs), spans=False)
    return out.select("doc_id", F.coalesce(F.expr(common.HELD_OUT), F.lit(False)).alias("held_out"), "lang_pred", "score")
