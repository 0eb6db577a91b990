"""The corpus operators against brute force, round trips, held-out accuracy and odd inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import common, decontaminate, idcodec, language, license_scan, line_dedup, near_copies, packing, quality_cnn, quality_rules, simhash, token_counts, token_files
from lodestrata.llm.queries import QUERIES
from lodestrata.llm.tokens import PieceEncoder, vocabulary

ODD = [
    None, "", "   \n\n ", "one", "The quick brown fox jumps over the lazy dog again.", "The quick brown fox jumps over the lazy dog again.", "a\tb\r\nc  d", "it's <|endoftext|> x. É, ê! 日本",
    "All rights reserved. " * 3 + "Licensed under CC BY-NC 4.0.", "w " * 60000, "x" * 200000, "12 34", "Ünïcödé     text",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, hits string, fp string, line string, score string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of odd rows with clashing extra columns, and empty ones."""
    out = {}
    for name, texts in (("odd", ODD), ("empty", [])):
        path = str(tmp_path_factory.mktemp(name))
        rows = [(None if i == 3 else min(i, 9), t, "en" if i % 2 else None, "s", 0, "x", "y", "z", "l", "s") for i, t in enumerate(texts)]
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, None), (3, "")][: len(texts)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([(4, 1, 0), (9, 0, 0), (4, 1, 0)][: len(texts)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out[name] = path
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, folder, name):
    assert QUERIES[name](spark, folder["empty"]).count() == 0
    n = QUERIES[name](spark, folder["odd"]).count()
    assert n >= len(ODD) if name == "op7_packing" else n == len(ODD)


def test_pipeline_on_odd_and_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder["empty"]).count() == 0
    docs = common.documents(spark, folder["odd"])
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = common.persist(f(spark, docs, folder["odd"]), "t")
        assert out.columns == docs.columns
        docs = out
    corpus_pipeline.run(spark, folder["odd"]).collect()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.documents(spark, sf).toPandas()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_encoder_is_the_library(name, docs):
    e = PieceEncoder(vocabulary(name), max_pieces=2000)
    r = random.Random(5)
    noise = ["".join(r.choice("aAbé É.'’!\n\t  1<|s×ß日") for _ in range(r.randrange(60))) for _ in range(300)]
    texts = [t or "" for t in ODD] + noise + docs.text.tolist()
    ids, at = e.encode(pa.array(texts))
    want = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    for i, w in enumerate(want):
        assert ids[at[i] : at[i + 1]].tolist() == w.ids, texts[i][:50]


def test_codec_round_trip_and_checksum():
    r = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 5), (513, 50000), (6000, 2**32)):
        x = r.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        assert (idcodec.decode(idcodec.encode(x)) == x).all()
    x = (r.zipf(1.5, 5000) % 40000).astype(np.uint32)
    coded = bytearray(idcodec.encode(x))
    assert len(coded) < 2 * len(x)
    coded[-20] ^= 1
    with pytest.raises(ValueError):
        idcodec.decode(bytes(coded))


@pytest.mark.parametrize(("n", "block", "lanes"), [(1, 1, 1), (1025, 1025, 2), (9000, 3000, 2), (5000, 700, 3), (4097, 4096, 1024), (2100, 1, 1024)])
def test_codec_blocks(n, block, lanes):
    r = np.random.default_rng(n)
    for x in (r.zipf(1.2, n) % 49408, np.tile(r.integers(0, 300, 37), n // 37 + 1)[:n], np.full(n, 2**32 - 1), np.zeros(n)):
        x = x.astype(np.uint64).astype(np.uint32)
        coded = idcodec.encode(x, block, lanes)
        assert (idcodec.decode(coded, lanes) == x).all() and (idcodec.decode(coded, 7) == x).all()
    with pytest.raises(ValueError):
        idcodec.encode(x, 1 << 20)


def test_codec_damage():
    r = np.random.default_rng(5)
    x = (r.zipf(1.3, 4000) % 49408).astype(np.uint32)
    coded = idcodec.encode(x, 1000)
    for at in r.integers(len(coded) - 2000, len(coded), 30):
        broken = bytearray(coded)
        broken[at] ^= int(r.integers(1, 256))
        with pytest.raises(ValueError):
            idcodec.decode(bytes(broken))
    with pytest.raises(ValueError):
        idcodec.decode(coded[:-5])


@pytest.mark.parametrize("highest", [2**16 - 1, 2**16, 2**28 - 1, 2**28, 2**32 - 1])
def test_codec_of_any_id(highest):
    r = np.random.default_rng(highest)
    x = np.append(r.zipf(1.3, 30000) % (highest + 1), highest).astype(np.uint64).astype(np.uint32)
    coded = idcodec.encode(x, 1000, 8)
    assert (idcodec.decode(coded, 8) == x).all() and (idcodec.decode(coded) == x).all()
    # an id without a count is written plainly, so ids that are met once take little over their own bytes
    once = idcodec.encode(r.permutation(40000).astype(np.uint32), 4096)
    assert len(once) < 40000 * 2.2 and len(idcodec.decode(once)) == 40000


def test_pieces_met_again_stay():
    e, sent = PieceEncoder(vocabulary("word_bpe_49k.json"), max_pieces=300), []
    add = e._add
    e._add = lambda pieces: sent.extend(pieces.to_pylist()) or add(pieces)
    words = lambda k, n: " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}" for i in range(k, k + n))
    often = words(0, 50)
    for k in range(50, 1000, 190):
        text = f"{often} {words(k, 190)}"
        ids, at = e.encode(pa.array([text, None, often]))
        want = e.tokenizer.encode_batch([text, "", often], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [w.ids for w in want]
        assert len(e.known) <= 300
    assert max(Counter(sent).values()) == 1 and len(sent) >= 1000


def _ids(name, texts, end=None):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [e.ids + ([end] if end is not None else []) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, sf, docs):
    d = docs.sort_values("doc_id")
    want, start = [], 0
    for doc_id, ids in zip(d.doc_id, _ids("word_bpe_49k.json", d.text, 2)):
        want.append((doc_id, start, len(ids), _crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_files.op4(spark, sf).collect())) == want


def test_token_counts_and_cache(spark, sf, docs, tmp_path):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op6(spark, sf).collect()}
    for doc_id, text, ids in zip(docs.doc_id, docs.text, _ids("word_bpe_49k.json", docs.text)):
        assert got[doc_id] == (len(text.encode()), len(ids), len(ids) > 2048)
    cache, df = str(tmp_path / "cache"), spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, None)], "doc_id int, text string")
    vocab = vocabulary("word_bpe_49k.json")
    token_counts.count_tokens(df, vocab, cache, True).collect()
    assert token_counts.stored_counts(spark, cache).count() == 3
    token_counts.count_tokens(df, vocab, cache, True).collect()
    assert token_counts.stored_counts(spark, cache).count() == 3
    pieces = token_counts.count_tokens(df, vocabulary("piece_bpe_32k.model"), cache).collect()
    assert len(pieces) == 4 and token_counts.stored_counts(spark, cache).count() == 7


def test_packing(spark, sf, docs):
    got = packing.op7(spark, sf).toPandas()
    want = dict(zip(docs.doc_id, _ids("byte_bpe_50k.json", docs.text, 1)))
    for doc_id, own in got.groupby("doc_id"):
        own, at = own.sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == _crc(want[doc_id][at : at + r.length]) and r.doc_tokens == len(want[doc_id])
            at += r.length
        assert at == len(want[doc_id])
    sizes = {}
    for seq, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all()
        sizes[seq] = own.length.sum()
    assert sorted(sizes) == list(range(len(sizes))) and set(docs.doc_id) == set(got.doc_id)
    assert all(n <= 2048 and n & (n - 1) == 0 for n in sizes.values())


def test_plan_never_overuses():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 600, 400)
    pieces = packing.pack(lengths, 128)
    held = Counter()
    for d, start, n, _, _ in pieces:
        held[d] += n
    assert all(held[d] == n for d, n in enumerate(lengths.tolist()))


ALNUM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def _brute_scan(texts, items, n=10):
    grams = defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, _lower(t))
        size = min(n, len(w))
        for k in range(len(w) - size + 1) if size else ():
            grams[tuple(w[k : k + size])].add(i)
    out = []
    for t in texts:
        w, hit, found = re.findall(ALNUM, _lower(t)), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if own := grams.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= own
        out.append((len(w), len(hit), len(found)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, block):
    r = random.Random(1)
    word = lambda: r.choice(["alpha", "Beta", "gam", "é", "1"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 2, 9, 11, 14])))) for i in range(8)]
    texts = [" ".join(word() for _ in range(r.randrange(40))) + (f" zz {items[i % 8][1]}, end" if i % 3 == 0 else "") for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = decontaminate.scan(df, spark.createDataFrame(items, "item_id int, text string"), block_bytes=block)
    got = [(x.n_words, x.n_hit, len(x["items"])) for x in out.orderBy("doc_id").collect()]
    assert got == _brute_scan(texts, items)
    left = decontaminate.remove_spans(out).orderBy("doc_id").collect()
    assert all(len(re.findall(ALNUM, _lower(x.text))) <= x.n_words - x.n_hit for x in left)


def _find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def _brute_components(ids, fps, d=3):
    parent = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= d:
                a, b = _find(parent, i), _find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        k = _find(parent, i)
        least[k] = min(least.get(k, doc), doc)
    return {doc: least[_find(parent, i)] for i, doc in enumerate(ids)}


def test_fingerprint_by_hand():
    from xxhash import xxh64_intdigest as h

    hs = [h(x, 42) for x in (b"a b c", b"b c d", b"c d a", b"d a b", b"a b c")]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in hs) * 2 > len(hs))
    assert int(simhash.fingerprints(["A b\tC\nd a B c"])[0]) & (2**64 - 1) == want
    assert simhash.fingerprints(["", "x y"]).tolist()[0] == 0


@pytest.mark.parametrize("crowd", [0, 3, 512])
def test_links_and_components(spark, crowd):
    r = random.Random(7)
    fps = []
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(12):
            v = base
            for _ in range(r.randrange(5)):
                v ^= 1 << r.choice([r.randrange(64), r.randrange(6)])
            fps.append(v)
    fps = sorted(set(fps))
    ids = list(range(100, 100 + len(fps)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    marked = spark.createDataFrame(list(zip(ids, signed)), "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component_id for r in marked.join(simhash.classes(marked, 3, crowd), "fp").collect()}
    assert got == _brute_components(ids, fps)


def test_simhash_query(spark, sf, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5(spark, sf).collect()}
    fps = [int(x) & (2**64 - 1) for x in simhash.fingerprints(docs.text.tolist())]
    want = _brute_components(docs.doc_id.tolist(), fps)
    assert got == {d: (f"{f:016x}", want[d]) for d, f in zip(docs.doc_id, fps)}


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _brute_lines(rows, least=8):
    seen, out = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        kept, worded = [], False
        for line in (text or "").split("\n"):
            w = [x for x in re.split(r"[ \t\x0b\f\r]+", line.lower()) if x]
            if not w:
                kept.append(line)
                continue
            worded = True
            gone = any(w == s or (len(w) >= least and len(s) >= least and abs(len(w) - len(s)) < 2 and _edit(w, s) <= 1) for s in seen)
            seen.append(w)
            if not gone:
                kept.append(line)
        empty = worded and all(not re.search(r"[^ \t\x0b\f\r]", k) for k in kept)
        out[doc] = ("" if empty else "\n".join(kept), empty)
    return out


def test_line_dedup(spark):
    r = random.Random(11)
    base = [[r.choice("abcdefgh") + r.choice("xyz") for _ in range(r.choice([3, 7, 8, 9, 12]))] for _ in range(12)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1])] = [] if r.random() < 0.3 else [r.choice("pq")]
        return r.choice(["", " ", "\t"]) + r.choice([" ", "  "]).join(w).replace("ax", r.choice(["ax", "AX"]))

    rows = [(i, "\n".join(r.choice(["", line(), line()]) for _ in range(r.randrange(7)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {x.doc_id: (x.text, x.emptied) for x in line_dedup.dedup_lines(df).collect()}
    assert got == _brute_lines(rows)


def test_quality_features(spark, sf, docs):
    got = {r.doc_id: r for r in quality_rules.op3(spark, sf).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_rules.op3(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert out[out.quality == 1].kept.mean() > 0.93 and out[out.quality == 0].kept.mean() < 0.1


def test_license_base(spark, sf, docs):
    got = {r.doc_id: r for r in license_scan.op2(spark, sf).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text):
        w, at, labels = re.findall(ALNUM, _lower(text)), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            at += own
            labels |= {label} if own else set()
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_automaton():
    a = license_scan.Automaton("begin [[maybe this]] {{1..2}} {{red|dark blue}} end")
    ends = lambda t: a.match(t.split(), 0, len(t.split()))
    assert ends("begin x red end") == 4 and ends("begin maybe this x y dark blue end tail") == 8
    assert ends("begin red end") == -1 and ends("begin maybe x y z red end") == -1
    with pytest.raises(ValueError):
        license_scan.Automaton("[[a]]")


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_cnn.op1(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0.7) == (out.quality == 1)).mean() > 0.93 and out.score.between(0, 1).all()


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = language.op9(spark, sf).join(common.documents(spark, sf).select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang_pred == out.lang).mean() > 0.98


def test_language_spans(spark):
    model = language.Model([("the cat and the dog with them " * 9, "en"), ("le chat et la souris avec eux " * 9, "fr"), ("кот и собака " * 9, "ru")])
    df = spark.createDataFrame([(1, "the dog and the cat le chat avec la souris кот и собака"), (2, "123 ..."), (3, None)], "doc_id int, text string")
    out = {r.doc_id: r for r in language.identify(df, model, switch=3.0).collect()}
    assert [s.lang for s in out[1].spans] == ["en", "fr", "ru"]
    assert out[2].lang_pred == out[3].lang_pred == "und" and out[3].score == 0


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(4)
    scores = r.standard_normal((9, 3)).astype(np.float32)
    first = np.array([0, 4, 4, 9])
    got = language.viterbi(scores.copy(), first, 0.7)
    import itertools

    for a, b in zip(first, first[1:]):
        best = max(itertools.product(range(3), repeat=b - a), key=lambda p: sum(scores[a + i, k] for i, k in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:])), default=())
        assert tuple(got[a:b]) == best


def test_pipeline_against_brute_force(spark, sf):
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.rules(spark, common.documents(spark, sf), sf).collect()]
    lines = {d: t for d, (t, empty) in _brute_lines(kept).items() if not empty}
    ids = sorted(lines)
    classes = _brute_components(ids, [int(x) & (2**64 - 1) for x in simhash.fingerprints([lines[i] for i in ids])])
    ids = [i for i in ids if classes[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ids = [i for i, (_, hit, _) in zip(ids, _brute_scan([lines[i] for i in ids], items)) if not hit]
    want = dict(zip(ids, map(len, _ids("byte_bpe_50k.json", [lines[i] for i in ids], 1))))
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want



def _brute_near(rows, words=5, similarity=0.8):
    """Pairs of ids whose sets of word shingles are as similar."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))}
    return [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]


@pytest.mark.parametrize("crowd", [2, 16])
def test_near_copies_by_similarity(spark, crowd):
    r = random.Random(3)
    rows = []
    for base in range(4):
        text = [f"w{r.randrange(5000)}" for _ in range(160)]
        for k in range(12 if base == 0 else 4):
            copy = list(text)
            for at in r.sample(range(160), 1 if base == 0 else k):
                copy[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, "one two"), (len(rows) + 2, "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    near = [(a, b) for a, b in _brute_near(rows) if rows[a][1]]
    kept = {x.doc_id for x in near_copies.keep_one(docs, crowd=crowd).collect()}
    assert not [p for p in near if set(p) <= kept]
    parent = {i: i for i, _ in rows}
    for a, b in near:
        parent[_find(parent, b)] = _find(parent, a)
    assert {_find(parent, i) for i in kept} == {_find(parent, i) for i, _ in rows}
    # the stage of the pipeline removes what the fingerprints at 3 bits leave
    left = {x.doc_id for x in simhash.keep_one(docs).collect()}
    assert [p for p in near if set(p) <= left]
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "near").collect()}
    assert not [p for p in near if set(p) <= kept]


def test_texts_of_one_form_are_not_all_paired(spark, monkeypatch):
    r = random.Random(5)
    form = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(form + [f"y{r.randrange(10**6)}" for _ in range(30)])) for k in range(80)]
    rows += [(k + 80, rows[k][1] + " z") for k in (3, 40)]  # near copies among texts that are alike but less than 0.8
    pairs, persist = [], common.persist

    def counted(df, name):
        out = persist(df, name)
        pairs.extend((x.a, x.b) for x in (out.collect() if name == "candidates" else []))
        return out

    monkeypatch.setattr(common, "persist", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _brute_near(rows) == [(3, 83), (40, 120)]
    assert sorted(x.doc_id for x in near_copies.keep_one(docs, crowd=4).collect()) == list(range(80))
    assert len(pairs) == len(set(pairs))
