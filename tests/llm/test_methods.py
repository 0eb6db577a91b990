"""Methods of the corpus operators against independent plain versions, and what odd rows give."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import common, decontaminate, language, license_scan, line_dedup, near_copies, packing, quality_cnn, quality_rules, simhash, token_counts, token_files
from lodestrata.llm.license_texts import TEMPLATES, WHOLE
from lodestrata.llm.textprep import ALNUM as ALNUM_BYTES
from lodestrata.llm.textprep import LOWER, Words, raw
from lodestrata.llm.tokens import vocabulary

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.documents(spark, sf).toPandas()


# --- fingerprints by a loop of its own ------------------------------------------------------------------------------


def _fingerprint(text):
    from xxhash import xxh64

    words = [w for w in re.split("[\x20\x09-\x0d]+", _lower(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [int(xxh64(s.encode(), seed=42).hexdigest(), 16) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_of_all_documents(docs):
    texts = [*docs.text.tolist()[:120], None, "", " \n", "one", "Two Words", "a b c a b c a b c"]
    got = [int(x) & (2**64 - 1) for x in simhash.fingerprints([t or "" for t in texts])]
    assert got == [_fingerprint(t) for t in texts]


# --- rules: expectation-maximisation written out document by document --------------------------------------------------


def _plain_em(signs, table, rounds=1000):
    """``table`` has a row of votes for each document."""
    x, n = np.array(table, float), len(table)
    start = np.array([quality_rules.START[s] for s in signs])
    on_good, on_bad, prior = start[:, 0].copy(), start[:, 1].copy(), 0.8
    for _ in range(rounds):
        good = prior * np.prod(np.where(x == 1, on_good, 1 - on_good), 1)
        bad = (1 - prior) * np.prod(np.where(x == 1, on_bad, 1 - on_bad), 1)
        q = good / (good + bad)
        a, b = (q @ x + start[:, 0]) / (q.sum() + 1), ((1 - q) @ x + start[:, 1]) / ((1 - q).sum() + 1)
        pooled = (x.sum(0) + start.sum(1)) / (n + 2)
        crossed = (a - b) * np.array(signs) < 0
        on_good, on_bad = np.where(crossed, pooled, a), np.where(crossed, pooled, b)
        before, prior = prior, (q.sum() + 1) / (n + 2)
        if abs(prior - before) < 1e-12:
            break
    return prior, on_good, on_bad


@pytest.mark.parametrize("share", [0.85, 0.3])
def test_em_is_the_plain_one(share):
    r = np.random.default_rng(int(share * 100))
    signs = [-1, -1, -1, 1]
    good = r.random(3000) < share
    rates = np.where(good[:, None], [0.02, 0.03, 0.01, 0.9], [0.6, 0.5, 0.4, 0.1])
    table = r.random((3000, 4)) < rates
    counts = Counter(map(tuple, table.tolist()))
    bias, ratios = quality_rules.estimate(signs, sorted(counts.items()))
    prior, a, b = _plain_em(signs, table)
    assert 1 / (1 + math.exp(-bias)) == pytest.approx(prior, abs=1e-6)
    assert np.allclose([x[True] for x in ratios], np.log(a / b), atol=1e-5)
    # a corpus with few good documents is estimated like any other
    assert abs(prior - share) < 0.05
    odds = bias + sum(np.where(table[:, j], x[True], x[False]) for j, x in enumerate(ratios))
    assert ((odds > 0) == good).mean() > 0.9


# --- the byte network, place by place ---------------------------------------------------------------------------------


def _plain_score(net, text):
    x = [b for b in text] + [32] * max(0, quality_cnn.WIDTH - len(text))
    for i in range(len(text) - 7):
        if i >= 32 and any(text[i : i + 8] == text[i - lag : i - lag + 8] for lag in range(2, 33)):
            x[i] += 256
    last = len(x) - quality_cnn.WIDTH
    at = sorted({*range(0, last + 1, quality_cnn.STRIDE), last})
    response = np.array([sum(net.tables[k][x[p + k]] for k in range(quality_cnn.WIDTH)) for p in at])
    size, step = quality_cnn.CHUNK // quality_cnn.STRIDE, quality_cnn.STEP // quality_cnn.STRIDE
    chunks, begin = [], 0
    while True:
        chunks.append(np.maximum(response[begin : begin + size].max(0) + net.bias, 0))
        if begin + size >= len(at):
            break
        begin += step
    doc = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)])
    return 1 / (1 + math.exp(-float(doc @ net.weight + net.offset)))


def test_network_place_by_place():
    r = random.Random(4)
    net = quality_cnn.Network()
    net.bias[:] = np.linspace(-0.2, 0.2, len(net.bias))
    texts = [b"", b"a", b"seven b", b"ninebytes", bytes(r.randrange(97, 123) for _ in range(511)), b"abcd" * 300 + b"z", bytes(r.randrange(32, 127) for _ in range(1303))]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert np.allclose(net.score(buf, offs), [_plain_score(net, t) for t in texts], atol=1e-5)
    # the last byte of a text of odd length is read
    for n in (9, 11, 33, 101):
        own = [bytes([98] * (n - 1) + [k]) for k in (97, 120)]
        a, b = (net.score(np.frombuffer(t, np.uint8), np.array([0, n]))[0] for t in own)
        assert a != b


# --- languages ---------------------------------------------------------------------------------------------------------


def test_more_languages_than_a_byte_holds():
    k = 200
    scores = np.full((3, k), -5.0, np.float32)
    for row, label in enumerate((150, 199, 0)):
        scores[row, label] = 50.0
    assert language.viterbi(scores.copy(), np.array([0, 3]), 1.0).tolist() == [150, 199, 0]


def test_language_by_exhaustive_paths():
    model = language.Model([("the cat and the dog " * 9, "en"), ("le chat et la souris " * 9, "fr"), ("кот и собака " * 9, "ru")])
    import pyarrow as pa

    for text in ("the dog et la souris", "кот and le chat", "la cat 12 dog и"):
        words = pa.array(text.split())
        rows = model.rows(words)
        best = max(itertools.product(range(3), repeat=len(words)), key=lambda p: sum(float(rows[i, k]) for i, k in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(language.viterbi(np.ascontiguousarray(rows[:, :3]), np.array([0, len(words)]), 2.5)) == best


# --- licences: every template as a regular expression -----------------------------------------------------------------


def _pattern(template):
    def walk(parts):
        out = ""
        for p in parts:
            if isinstance(p, str):
                out += re.escape(p) + " "
            elif p[0] == "opt":
                out += f"(?:{walk(p[1])})?"
            elif p[0] == "one":
                out += "(?:" + "|".join(walk(x) for x in p[1]) + ")"
            else:
                out += f"(?:[^ ]+ ){{{p[1]},{p[2]}}}"
        return out

    return walk(license_scan._parse(template))


def _longest(pattern, words, at):
    """The longest match from a place, by trying every end."""
    return max((end for end in range(at + 1, len(words) + 1) if re.fullmatch(pattern, "".join(w + " " for w in words[at:end]))), default=-1)


def _filled(template, r):
    def walk(parts):
        out = []
        for p in parts:
            if isinstance(p, str):
                out.append(p)
            elif p[0] == "opt":
                out += walk(p[1]) if r.random() < 0.5 else []
            elif p[0] == "one":
                out += walk(r.choice(p[1]))
            else:
                out += [r.choice(["acme", "inc", "2024"]) for _ in range(r.randint(p[1], p[2]))]
        return out

    return walk(license_scan._parse(template))


def test_licences_against_patterns(spark):
    r = random.Random(6)
    texts, holds = [], []
    for label, templates in TEMPLATES.items():
        for t in templates:
            words = _filled(t, r)
            texts.append("Before, " + ", ".join(words).upper() + "; after")
            holds.append((label, True))
            if len(words) > 30:  # one mandatory word of a whole text is another: not that licence
                broken = list(words)
                broken[3] = "wombat"
                texts.append(" ".join(broken))
                holds.append((label, None))
    texts += [None, "", "all rights reserved", "cc by cc by"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    scanned = {x.doc_id: x for x in license_scan.scan_licenses(df).collect()}
    digest = {x.doc_id: x for x in license_scan.digest(license_scan.scan_licenses(df)).collect()}
    patterns = [(label, _pattern(t)) for label, ts in TEMPLATES.items() for t in ts] + [(label, _pattern(p)) for p, label in license_scan.BASE.items()]
    firsts = [(label, p, re.compile(p.split(" ")[0].split("(")[0]) if not p.startswith("(") else None) for label, p in patterns]
    for i, text in enumerate(texts):
        w = re.findall(WORD, _lower(text))
        labels = {m.label for m in scanned[i].matches}
        if i < len(holds) and holds[i][1]:
            assert holds[i][0] in labels, (holds[i][0], text[:80])
        if i % 4 == 0 or i >= len(holds):
            want = set()
            for label, p, first in firsts:
                for at in range(len(w)):
                    if (first is None or first.fullmatch(w[at])) and (end := _longest(p, w, at)) > 0:
                        want.add((label, at, end))
            assert {(m.label, m.first, m.past) for m in scanned[i].matches} == want
            covered = set().union(*[range(a, b) for _, a, b in want]) if want else set()
            assert digest[i].score == pytest.approx(len(covered) / len(w) if w else 0.0)
            assert digest[i].labels == ",".join(sorted({x[0] for x in want}))
    broken = [i for i, (label, ok) in enumerate(holds) if ok is None]
    assert broken and all(holds[i][0] not in {m.label for m in scanned[i].matches} for i in broken if holds[i][0] in WHOLE and len(TEMPLATES[holds[i][0]]) == 1)


# --- packing: the fit against many more rounds --------------------------------------------------------------------------


def _objective(histogram, combos, x):
    used = histogram.astype(float).copy()
    for v, combo in zip(x, combos.tolist()):
        for a in combo:
            if a:
                used[a] -= v
    return float((used[1:] ** 2).sum())


def _slow_nnls(histogram, combos, sweeps=300):
    """Projected gradient on the dense matrix."""
    a = np.zeros((len(histogram), len(combos)))
    for j, combo in enumerate(combos.tolist()):
        for v in combo:
            if v:
                a[v, j] += 1
    x, step = np.zeros(len(combos)), 1 / np.linalg.norm(a, 2) ** 2
    y, t = x.copy(), 1.0
    for _ in range(sweeps * 20):
        new = np.maximum(0, y - step * (a.T @ (a @ y - histogram)))
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def test_fit_reaches_the_least_squares():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 96, 500)
    histogram = np.bincount(lengths, minlength=97) * (np.arange(97) > 0)
    combos = packing.combinations(histogram, 96)
    assert all(sum(c) in (96, *(1 << k for k in range(8))) for c in combos.tolist())
    best = _objective(histogram, combos, _slow_nnls(histogram, combos))
    assert _objective(histogram, combos, packing.repeat_counts(histogram, combos)) <= best * 1.02 + 1
    left = np.maximum(histogram - histogram[::-1], 0)
    left[48] = histogram[48] % 2
    threes = {t for t in itertools.combinations_with_replacement(np.flatnonzero(left).tolist(), 3) if sum(t) == 96}
    assert {tuple(c) for c in combos.tolist() if c[2]} == threes  # none is left out


def test_packing_in_several_groups(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice(["alpha", "beta", "42", "x,"]) for _ in range(r.randrange(90))) for _ in range(80)] + [None, "", "tie", "tie"]
    df = spark.createDataFrame([(min(i, 80), t) for i, t in enumerate(texts)], "doc_id bigint, text string").coalesce(1)
    got = packing.pack_documents(df, vocabulary("byte_bpe_50k.json"), 64, end_id=1, group_ids=500).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    assert sorted(sizes.index) == list(range(len(sizes))) and all(n <= 64 and n & (n - 1) == 0 for n in sizes)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter(i for x in texts for i in [*t.encode(x or "", add_special_tokens=False).ids, 1])
    assert Counter(np.concatenate([np.frombuffer(x, "<u4") for x in got.ids]).tolist()) == want


# --- token files in several parts and segments ---------------------------------------------------------------------------


def test_files_of_many_segments(spark, tmp_path):
    from tokenizers import Tokenizer

    r = random.Random(9)
    rows = [(i // 2, " ".join(r.choice(["red", "green", "blue!", "9"]) for _ in range(r.randrange(60)))) for i in range(300)] + [(None, "no id"), (None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write(df, str(tmp_path / "f"), vocabulary("word_bpe_49k.json"), 2, segment_ids=300)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(str(tmp_path / "f"))
    assert files.select("part").distinct().count() > 1 and files.agg(F.max("seg")).first()[0] > 1
    got = token_files.read(spark, str(tmp_path / "f")).orderBy("start").toPandas()
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    named = got.doc_id.dropna().astype(int).tolist()
    assert got.doc_id.isna().head(2).all() and named == sorted(named)
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = lambda x: tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])
    key = lambda p: (-1 if p[0] is None or p[0] != p[0] else int(p[0]), p[1])
    assert sorted((key((d, tuple(np.frombuffer(x, "<u4").tolist()))) for d, x in zip(got.doc_id, got.ids))) == sorted(key((d, ids(x))) for d, x in rows)


# --- the cache outlives a call --------------------------------------------------------------------------------------------


def test_named_cache(spark, sf, tmp_path):
    spark.conf.set("spark.lodestrata.tokenCounts", str(tmp_path / "cache"))
    try:
        first = sorted(map(tuple, token_counts.op6(spark, sf).collect()))
        stored = token_counts.stored_counts(spark, str(tmp_path / "cache")).count()
        assert sorted(map(tuple, token_counts.op6(spark, sf).collect())) == first
        assert token_counts.stored_counts(spark, str(tmp_path / "cache")).count() == stored > 0
        again = token_counts.count_tokens(common.documents(spark, sf), vocabulary("word_bpe_49k.json"), str(tmp_path / "cache"), True)
        assert again.cache_use["misses"] == 0 and again.cache_use["contents"] == stored
    finally:
        spark.conf.unset("spark.lodestrata.tokenCounts")
    df = spark.createDataFrame([(1, "a b", 7, 8, "d")], "doc_id int, text string, n_tokens int, N_BYTES int, digest string")
    out = token_counts.count_tokens(df, vocabulary("word_bpe_49k.json"), str(tmp_path / "clash"))
    assert out.columns == ["doc_id", "text", "digest", "n_bytes", "n_tokens"] and out.cache_use == {"contents": 1, "misses": 1}
    assert tuple(out.first()) == (1, "a b", "d", 3, 2)


# --- decontamination in blocks ----------------------------------------------------------------------------------------------


def test_blocks_give_what_one_pass_gives(spark):
    r = random.Random(3)
    word = lambda: r.choice(["ab", "cd", "é", "7", "gh"])
    items = [(f"i{k % 9}", " ".join(word() for _ in range(r.choice([1, 9, 10, 13, 300])))) for k in range(12)] + [(None, "ab cd"), ("e", None), ("f", "")]
    texts = [" ".join(word() for _ in range(r.randrange(50))) + (" zz. " + items[i % 12][1].upper() if i % 4 == 0 else "") for i in range(70)] + [None, "", "AB  cd"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, hits string, rid string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda out: [(x.doc_id, x.n_words, x.n_hit, x.hits, x["items"], x.rid) for x in out.orderBy("doc_id").collect()]
    whole = rows(decontaminate.scan(df, bench))
    assert any(x[2] for x in whole)
    for size in (1, 60, 700):
        out = decontaminate.scan(df, bench, block_bytes=size)
        assert rows(out) == whole and out.columns == decontaminate.scan(df, bench).columns
    assert decontaminate.scan(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_windows_take_few_bytes():
    r = random.Random(5)
    items = [(str(k), " ".join(f"w{r.randrange(20000)}" for _ in range(400))) for k in range(300)]
    grams = decontaminate.Grams(items, 10)
    words = 300 * 400
    held = grams.numbers.nbytes + grams.vocabulary.nbytes + sum(h.nbytes + p.nbytes for h, p in grams.lengths.values())
    assert held < 25 * words
    buf, offs = raw(__import__("pyarrow").array([items[7][1], "nothing"]))
    hit, found = grams.scan(Words(LOWER[buf], offs, ALNUM_BYTES))
    assert hit[:400].all() and not hit[400:].any() and found == {0: {7}}


# --- lines: permuted words -----------------------------------------------------------------------------------------------------


def _apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_permuted_lines(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(8)]
    lines = [list(p) for p in itertools.islice(itertools.permutations(base), 0, 40000, 300)]
    for p in [r.sample(base, 8) for _ in range(120)] + lines[:40]:
        own = list(p)
        own.insert(r.randrange(9), f"x{r.randrange(50)}")
        lines.append(own)
    doubled = [[w for w in r.sample(base, 4) for _ in (0, 1)] for _ in range(40)]
    lines += doubled
    r.shuffle(lines)
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id bigint, text string")
    gone = {x.doc_id for x in line_dedup.dedup_lines(df).where("emptied").collect()}
    assert gone == {i for i, x in enumerate(lines) if any(_apart(x, y) for y in lines[:i])}


# --- values of odd rows ----------------------------------------------------------------------------------------------------------


def test_values_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "Same words stand here twice, as they do below and above"), (3, "Same words stand here twice, as they do below and above"), (None, "no id at all"), (4, " \n\t ")]
    df = spark.createDataFrame([(d, t, 1.5, "k") for d, t in rows], "doc_id bigint, text string, score double, base_labels string")
    by = lambda out: sorted(((r.doc_id is None, r.doc_id), r) for r in out.collect())
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    scanned = sorted(license_scan.digest(license_scan.scan_licenses(df)).collect(), key=key)
    assert [(r.n_words, r.n_base, r.labels, r.score) for r in scanned] == [(0, 0, "", 0.0)] * 2 + [(11, 0, "", 0.0)] * 2 + [(0, 0, "", 0.0), (4, 0, "", 0.0)]
    judged = sorted(quality_rules.judge(common.persist(quality_rules.features(df), "odd")).collect(), key=key)
    assert [(r.n_words, r.n_dup_lines, r.base_failed, r.kept and r.base_failed) for r in judged] == [(0, 0, True, False)] * 2 + [(11, 0, False, False)] * 2 + [(0, 0, True, False), (4, 0, True, False)]
    near = sorted(simhash.near_duplicates(df).collect(), key=key)
    assert [r.component_id for r in near] == [1, 1, 3, 3, 1, None] and near[0].fingerprint == "0" * 16
    one = simhash.keep_one(df)
    assert one.columns == df.columns and sorted((r.doc_id or 0, r.score) for r in one.collect()) == [(0, 1.5), (1, 1.5), (3, 1.5)]
    # the stage on shingles keeps texts without words
    assert sorted(r.doc_id or 0 for r in near_copies.keep_one(df).collect()) == [0, 1, 2, 3, 4]
    lines = sorted(line_dedup.dedup_lines(df).collect(), key=key)
    assert [(r.n_lines, r.n_dropped, r.emptied) for r in lines] == [(1, 0, False)] * 4 + [(2, 0, False), (1, 0, False)]
    assert lines[0].text == "" and lines[0].score == 1.5
    model = language.Model([("same words stand here", "en")])
    told = sorted(language.identify(df, model).collect(), key=key)
    assert [(r.lang_pred, r.score) for r in told] == [("und", 0.0)] * 2 + [("en", 1.0)] * 2 + [("und", 0.0), ("en", 1.0)]
    net = quality_cnn.Network()
    scores = [r.score for r in sorted(quality_cnn.score(df, net).collect(), key=key)]
    assert scores[0] == scores[1] and scores[2] == scores[3] and 0 <= min(scores)


def test_repeated_documents_keep_equal_lines(spark):
    df = spark.createDataFrame([(5, "a b\nc d\na b"), (5, "a b\nc d\na b"), (6, "A  B\ne f")], "doc_id int, text string")
    out = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(df).collect())
    assert out == [(5, "a b\nc d", 1), (5, "a b\nc d", 1), (6, "e f", 1)]


def test_digests_of_op10(spark, sf, docs):
    got = {r.doc_id: r.text_sha256 for r in line_dedup.op10(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(common.documents(spark, sf)).collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in texts.items()} and len(got) == len(docs)
    assert zlib.crc32(b"1") >= 0


def test_stages_send_small_batches_and_forget_encoders(spark, sf):
    import pyarrow as pa

    import corpus_pipeline
    from lodestrata.llm import tokens

    corpus_pipeline.benchmark(spark, common.documents(spark, sf), sf)
    sizes = spark.range(0, 9000, 1, 1).mapInPandas(lambda batches: (b.head(1).assign(id=len(b)) for b in batches), "id bigint")
    assert max(r.id for r in sizes.collect()) <= common.BATCH["maxRecordsPerBatch"]
    tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"))
    list(simhash._mapper("t", "fp", 3, [])(iter([pa.RecordBatch.from_pydict({"t": ["a b c"]})])))
    assert not tokens._ENCODERS
