"""License scans (operator 2): templates with markup, compiled to automata over words.

Markup: ``[[ ... ]]`` is an optional region, ``{{m..n}}`` stands for m to n words of any kind (a replaceable region),
``{{a|b}}`` for one of some wordings; all else is mandatory and must match word for word.  A template becomes an
automaton without empty moves; runs start at the places of words that can begin it, found for a whole batch at once.
A text is accepted only where all mandatory wording of a template stands (``license_texts``: whole licences, whole
standard headers, and short notices, each with a label of its own).

Defined results: a null text is empty; texts without words have no matches and score 0; repeated rows and equal ids each
get their row.  The score is the share of a text's words inside matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .license_texts import TEMPLATES
from .textprep import ALNUM, LOWER, Words, index_in, raw, slices

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
ANY = "*"


def split_words(text: str) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def _parse(template: str):
    """Nested lists: words, ('opt', parts), ('any', m, n), ('one', [parts, ...])."""
    tokens = re.findall(r"\[\[|\]\]|\{\{[^{}]*\}\}|[^\[\]{}]+", template)
    stack: list[list] = [[]]
    for t in tokens:
        if t == "[[":
            stack.append([])
        elif t == "]]":
            if len(stack) == 1:
                raise ValueError("an optional region ends before it begins")
            part = stack.pop()
            stack[-1].append(("opt", part))
        elif t.startswith("{{"):
            inner = t[2:-2]
            if m := re.fullmatch(r"(\d+)\.\.(\d+)", inner.strip()):
                stack[-1].append(("any", int(m[1]), int(m[2])))
            else:
                stack[-1].append(("one", [split_words(x) for x in inner.split("|")]))
        else:
            stack[-1] += split_words(t)
    if len(stack) != 1:
        raise ValueError("an optional region does not end")
    return stack[0]


class Automaton:
    """States are numbers; ``moves[s]`` has (word or ANY, next) pairs; ``ends`` are accepting."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[str | None, int]]] = [[]]
        end = self._build(_parse(template), 0)
        closures = [self._closure(s) for s in range(len(self.arcs))]
        self.moves = [[(w, t) for s in c for w, t in self.arcs[s] if w is not None] for c in closures]
        self.ends = {s for s, c in enumerate(closures) if end in c}
        if 0 in self.ends or any(w == ANY for w, _ in self.moves[0]):
            raise ValueError("a template must begin with mandatory wording")
        self.first = {w for w, _ in self.moves[0]}

    def _state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def _arc(self, at: int, word: str | None, to: int | None = None) -> int:
        to = self._state() if to is None else to
        self.arcs[at].append((word, to))
        return to

    def _build(self, parts, at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                at = self._arc(at, p)
            elif p[0] == "opt":
                end = self._build(p[1], self._arc(at, None))
                out = self._arc(at, None)
                self._arc(end, None, out)
                at = out
            elif p[0] == "one":
                out = self._state()
                for words in p[1]:
                    self._arc(self._build(words, self._arc(at, None)), None, out)
                at = out
            else:
                out = self._state()
                for k in range(p[2] + 1):
                    if k >= p[1]:
                        self._arc(at, None, out)
                    if k < p[2]:
                        at = self._arc(at, ANY)
                at = out
        return at

    def _closure(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for w, t in self.arcs[todo.pop()]:
                if w is None and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def words(self) -> set[str]:
        return {w for moves in self.moves for w, _ in moves if w != ANY}

    def match(self, text: list, at: int, end: int) -> int:
        """The place past the longest match that starts at ``at``, or -1."""
        states, best = {0}, -1
        while at < end and states:
            word = text[at]
            states = {t for s in states for w, t in self.moves[s] if w == word or w == ANY}
            at += 1
            if states & self.ends:
                best = at
        return best


class Scanner:
    """All templates over the same vocabulary."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str]):
        self.automata = [(label, Automaton(t), False) for label, ts in templates.items() for t in ts]
        self.automata += [(label, Automaton(phrase), True) for phrase, label in base.items()]
        self.vocabulary = sorted(set().union(*(a.words() for _, a, _ in self.automata)))
        number = {w: i for i, w in enumerate(self.vocabulary)}
        for _, a, _ in self.automata:
            a.moves = [[(w if w == ANY else number[w], t) for w, t in moves] for moves in a.moves]
            a.first = {number[w] for w in a.first}
        self.starts = np.zeros((len(self.automata), len(self.vocabulary) + 1), bool)
        for k, (_, a, _) in enumerate(self.automata):
            self.starts[k, sorted(a.first)] = True
        # the second word narrows the starts, unless it may be any
        self.seconds = [{w for s in {t for _, t in a.moves[0]} for w, _ in a.moves[s]} if not any(t in a.ends for _, t in a.moves[0]) else {ANY} for _, a, _ in self.automata]

    def scan(self, words: Words) -> Iterator[tuple[int, str, bool, int, int]]:
        """(row, label, whether base, first word, past the last word); words count from the row's first."""
        number = index_in(words.column(), self.vocabulary)
        following = np.append(number[1:], -1)
        for k, (label, automaton, base) in enumerate(self.automata):
            ok = self.starts[k][number]
            if ANY not in self.seconds[k]:
                second = np.zeros(len(self.vocabulary) + 1, bool)
                second[sorted(self.seconds[k])] = True
                ok &= second[following]
            for at in np.flatnonzero(ok).tolist():
                row = int(np.searchsorted(words.first, at, "right")) - 1
                end = automaton.match(number, at, int(words.first[row + 1]))
                if end >= 0:
                    yield row, label, base, at - int(words.first[row]), end - int(words.first[row])


_FOUND = "n_words bigint, matches array<struct<label: string, base: boolean, first: bigint, past: bigint>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("past", pa.int64())]))


def _runner(templates: dict[str, list[str]], base: dict[str, str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, base)
        for batch in slices(batches, text):
            columns = dict(zip(batch.schema.names, batch.columns))
            buf, offs = raw(columns.pop(text))
            words = Words(LOWER[buf] if len(buf) else buf, offs, ALNUM)
            found = [[] for _ in range(batch.num_rows)]
            for row, label, is_base, first, past in scanner.scan(words):
                found[row].append({"label": label, "base": is_base, "first": first, "past": past})
            columns |= {"n_words": pa.array(words.counts(), pa.int64()), "matches": pa.array(found, _MATCH)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """``docs`` without its text, with ``n_words`` and ``matches`` (all of them, by word places)."""
    common.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "n_words", "matches")]
    (text,) = common.fresh(docs, "scanned_text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in rest)
    return docs.select(*rest, common.text_of().alias(text)).mapInArrow(_runner(templates, base, text), schema + _FOUND)


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    first = F.array_sort(F.transform(base, lambda m: m["first"]))
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(m["first"].alias("a"), m["past"].alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    covered = F.aggregate(spans, start, lambda s, p: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), p["b"] - F.greatest(p["a"], s["to"]))).alias("n"), F.greatest(s["to"], p["b"]).alias("to")))["n"]
    score = F.when(F.col("n_words") > 0, covered / F.col("n_words")).otherwise(0.0)
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.get(first, F.lit(0)).alias("first_word"), F.get(first, F.size(first) - 1).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"), score.alias("score"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(common.documents(spark, sf_dir).select("doc_id", "text")))
