"""Quality rules under weak supervision (operator 3).

Each rule votes for or against a document, or abstains.  Expectation-maximisation on the counts of each pattern of votes
estimates how often each rule speaks on good and on bad documents; the posterior probability of a good document, given
all votes, decides.  Patterns are at most 2 to the number of rules, whatever the input.

Only DataFrame functions touch documents; the driver does arithmetic on the pattern counts.

Defined results: null texts have no words; they and texts of fewer than 10 words fail the base rules; repeated rows are
counted and returned each; an empty table gives no rows (the rules then keep their priors).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 5
KEEP = 0.5


def _repeated_words(words: Column) -> Column:
    """Words inside windows of five that stand in the text twice or more."""
    span = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
    # every array is bound to a lambda's variable, so that it is computed once and not for each element
    bind = lambda value, f: F.transform(F.array(value), f)[0]

    def spots(windows: Column) -> Column:
        other = lambda x, j: (x["h"] == F.get(windows, j - 1)["h"]) | (x["h"] == F.get(windows, j + 1)["h"])
        return F.array_sort(F.transform(F.filter(windows, other), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def windows(hashes: Column) -> Column:
        # not the places past the last window
        return F.array_sort(F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.struct(span(hashes, i).alias("h"), i.alias("i"))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    counted = bind(hashes, lambda h: bind(windows(h), lambda ws: bind(spots(ws), covered)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("bigint")).otherwise(counted)


def _repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^ \t\x0b\f\r]")))
    return F.transform(F.array(F.transform(lines, lambda x: F.xxhash64(x))), lambda h: F.size(h) - F.size(F.array_distinct(h)))[0].cast("bigint")


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that the rules look at; columns so named are replaced."""
    text = common.text_of()
    (words,) = common.fresh(docs, "rule_words")
    rows = docs.withColumn(words, F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != ""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")
    return rows.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.char_length(text).cast("bigint") - count(r"[ \t-\r]"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_dup_lines": _repeated_lines(text),
        "n_repeat_words": _repeated_words(F.col(words)),
        "n_upper": count(r"\p{Lu}"),
        "n_letters": count(r"\p{L}"),
        "n_distinct": F.size(F.array_distinct(words)).cast("bigint"),
        "n_lines": F.size(F.split(text, "\n", -1)).cast("bigint"),
    }).drop(words)


#: Where a rule starts: how often it votes on good and on bad documents.  Rules against a document speak seldom and are
#: seldom wrong; rules for one speak often and tell little.
START = {-1: (0.005, 0.25), 1: (0.8, 0.5)}


def rules() -> dict[str, tuple[int, Column]]:
    """By name: the vote that a rule gives (1 for, -1 against) and where it gives it; elsewhere it abstains."""
    c, n = F.col, F.col("n_words")
    share = lambda part, whole: F.coalesce(F.try_divide(c(part).cast("double"), c(whole).cast("double")), F.lit(0.0))
    root = F.sqrt(n.cast("double"))
    plain = (share("n_symbols", "n_words") <= 0.02) & (share("n_upper", "n_letters") < 0.15) & (share("n_letters", "word_chars") > 0.9)
    return {
        "symbols": (-1, (n >= 5) & (share("n_symbols", "n_words") > 0.12)),
        "upper_case": (-1, (c("n_letters") >= 20) & (share("n_upper", "n_letters") > 0.35)),
        "letters": (-1, (n >= 5) & (share("n_letters", "word_chars") < 0.7)),
        "repeats": (-1, (n >= 20) & (share("n_repeat_words", "n_words") > 0.15)),
        "variety": (-1, (n >= 20) & (share("n_distinct", "n_words") < F.least(F.lit(0.35), 7 / root))),
        "lines": (-1, (c("n_lines") >= 3) & (share("n_dup_lines", "n_lines") > 0.3)),
        "word_length": (-1, (n >= 10) & ((share("word_chars", "n_words") < 2.5) | (share("word_chars", "n_words") > 14))),
        "plain": (1, (n >= 10) & plain),
    }


def estimate(votes: list[int], patterns: list[tuple[tuple[bool, ...], int]], rounds: int = 1000, prior: float = 0.8) -> tuple[float, list[dict[bool, float]]]:
    """The log odds of a good document, and for each rule the log ratio of speaking and of abstaining.

    Plain expectation-maximisation from ``START``, with one pseudo-document on each side that votes as ``START`` says, so
    that no estimate is zero.  A rule keeps its side: where its estimates cross, both become their pooled value (the
    likeliest ones that do not cross), so good and bad cannot change places."""
    total = sum(n for _, n in patterns)
    p = [{True: START[v], False: (1 - START[v][0], 1 - START[v][1])} for v in votes]
    for _ in range(rounds):
        sums = [list(START[v]) for v in votes]
        good = 0.0
        for pattern, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(p[j][x][0] / p[j][x][1]) for j, x in enumerate(pattern))
            q = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            good += n * q
            for j, x in enumerate(pattern):
                if x:
                    sums[j][0] += n * q
                    sums[j][1] += n * (1 - q)
        before, prior = prior, (good + 1) / (total + 2) if patterns else prior
        p = []
        for v, (on_good, on_bad) in zip(votes, sums):
            spoken = on_good / (good + 1), on_bad / (total - good + 1)
            if (spoken[0] - spoken[1]) * v < 0:
                spoken = ((on_good + on_bad) / (total + 2),) * 2
            spoken = tuple(min(max(s, 1e-9), 1 - 1e-9) for s in spoken)
            p.append({True: spoken, False: (1 - spoken[0], 1 - spoken[1])})
        if abs(prior - before) < 1e-10:
            break
    return math.log(prior / (1 - prior)), [{x: math.log(r[x][0] / r[x][1]) for x in r} for r in p]


def judge(counted: DataFrame, named: Callable[[], dict[str, tuple[int, Column]]] = rules, keep: float = KEEP) -> DataFrame:
    """``counted`` (with its features) and ``base_failed``, ``posterior`` and ``kept``.

    ``counted`` is read twice, once for the votes and once for the result: give a written table."""
    votes = named()
    patterns = counted.select(*[v.alias(k) for k, (_, v) in votes.items()]).groupBy(*votes).count().collect()
    rows = sorted((tuple(r[k] for k in votes), r["count"]) for r in patterns)
    bias, ratios = estimate([v for v, _ in votes.values()], rows)
    odds = F.lit(bias)
    for (_, speaks), ratio in zip(votes.values(), ratios):
        odds = odds + F.when(speaks, F.lit(ratio[True])).otherwise(F.lit(ratio[False]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = counted.withColumns({"base_failed": failed, "posterior": 1 / (1 + F.exp(-odds))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))


def op3(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = judge(common.persist(features(docs).drop("text"), "rules"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its own columns whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("rule_row"), "text")
    good = judge(common.persist(features(packed), "rules")).where("kept")
    return good.select("rule_row.*", "text").select(*docs.columns)
