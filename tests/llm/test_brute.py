"""Operators against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quire.llm import class_lm, components, language_id, media, mixing, packing, pii, quality_rules, simhash, substring_dedup, toxicity
from quire.llm.common import id_remainder
from quire.llm.entry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_language_held_out(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = rows(spark, "op1_language_id")
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (d in held) and 0 <= got[d].score <= 1 for d in got)
    assert np.mean([got[d].lang_pred == lang[d] for d in held]) > 0.9


def test_grams_of_blocks_equal_grams_of_whole(monkeypatch):
    text = "Ça va bien, merci — und du? " * 40
    whole, letter = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 17)
    assert letter and (language_id.gram_counts(text)[0] == whole).all()
    assert not language_id.gram_counts("12 34")[1]


def test_machine_learns_a_pair():
    """One of two words alone makes a text toxic, both or none don't: no sum of weights says that."""
    rng = np.random.default_rng(3)

    def sample(n):
        docs, y = [], []
        for _ in range(n):
            a, b = map(bool, rng.random(2) < 0.5)
            words = list(rng.choice([f"w{i}" for i in range(8)], 3)) + ["ab"] * a + ["cd"] * b
            docs.append(toxicity.term_hashes(" ".join(words)))
            y.append(a != b)
        return docs, np.array(y, float)

    docs, y = sample(3000)
    m = toxicity.fit_machine(docs, y, epochs=40)
    fresh, truth = sample(400)
    assert np.mean([(m.logit(d) > 0) == t for d, t in zip(fresh, truth, strict=True)]) > 0.95


def slow_terms(text):
    words = set(re.findall(r"\w+", text.lower()))
    terms = {zlib.crc32(w.encode()) for w in words}
    for n in (4, 6):
        for p in {w[:n] for w in words if len(w) > n}:
            times = sum(w[:n] == p and len(w) > n for w in words)
            stem = zlib.crc32(p.encode(), 7)
            terms |= {stem} | ({stem ^ 0x5BD1E995} if times == 2 else {stem ^ 0x1B873593} if times > 2 else set())
    return terms


def test_toxicity_query(spark, texts, monkeypatch):
    """Every score, from the machine's definition: intercept, weights and all pairs of known terms."""
    model, fit = {}, toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: model.setdefault("m", fit(*a)))
    got = rows(spark, "op2_toxicity")
    m = model["m"]
    place = {int(k): i for i, k in enumerate(m.keys)}
    assert len(got) == len(texts) and len(place) == len(m.keys) > 100
    for d, t in texts.items():
        at = sorted(place[x] for x in slow_terms(t) if x in place)
        z = m.w0 + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for i, j in itertools.combinations(at, 2))
        assert math.isclose(got[d].score, 1 / (1 + math.exp(-min(30, max(-30, z)))), abs_tol=1e-9)
        assert got[d].predicted == (got[d].score >= 0.5) and got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_best_terms_equal_those_of_texts_in_memory(spark, texts):
    docs = [toxicity.term_hashes(t) for t in texts.values()]
    y = np.array([i % 3 == 0 for i in range(len(docs))], float)
    df = spark.createDataFrame([(int(a), d.astype("<u4").tobytes()) for a, d in zip(y, docs, strict=True)], "y int, terms binary")
    assert (toxicity.best_terms(df, 300) == toxicity._chi_square(docs, y, 300)).all()


def slow_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    seq = [ord(c) for c in f" {' '.join(letters.split(' '))} "]
    seq = [c for i, c in enumerate(seq) if not i or c != 32 or seq[i - 1] != 32]
    m = 0xFFFFFFFF
    counts = collections.Counter()
    for i in range(len(seq)):
        h = 0
        for n, j in enumerate(range(i, min(i + 3, len(seq)))):
            one = seq[j] * 0x9E3779B1 & m
            h = one if not n else ((h ^ h >> (15 if n == 1 else 13)) * (0x85EBCA77 if n == 1 else 0xC2B2AE3D) + one) & m
            counts[((h ^ h >> 16) * 0x27D4EB2F & m) >> (32 - language_id.BUCKETS_LOG2)] += i + n > 0  # the first blank is no gram
    return counts


def test_language_query_against_all_centroids(spark, texts, monkeypatch):
    model, fit = {}, language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda *a: model.setdefault("m", fit(*a)))
    got = rows(spark, "op1_language_id")
    m = model["m"]
    for d, t in texts.items():
        v = {k: math.log1p(c) * float(m.idf[k]) for k, c in slow_grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cos = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in m.centroids]
        best = max(range(len(cos)), key=cos.__getitem__)
        assert any(c.isalpha() for c in t) and math.isclose(got[d].score, min(1.0, max(0.0, cos[best])), abs_tol=1e-4)
        near = {m.langs[i] for i, x in enumerate(cos) if x > cos[best] - 1e-5}
        assert got[d].lang_pred in near
        if len(near) == 1 and abs(1 - cos[best] - m.radius[best]) > 1e-4:
            assert got[d].rejected == (1 - cos[best] > m.radius[best])


def test_unlearned_language_is_rejected(spark):
    """Four learned languages of made words, and a fifth of other letters."""
    rng = np.random.default_rng(4)
    made = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    alphabets = {"a": "abcdef", "b": "ghijkl", "c": "mnopqr", "d": "stuvwx"}
    train = spark.createDataFrame([(i, made(x), k) for k, x in alphabets.items() for i in range(120)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    fresh = [(i, made(alphabets[k]), k) for i, k in enumerate("abcd" * 20)] + [(1000 + i, made("yzåäö"), "e") for i in range(40)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[d].lang_pred == k for d, _, k in fresh if d < 1000)
    assert sum(got[d].rejected for d, *_ in fresh if d < 1000) <= 8 and all(got[d].rejected for d, *_ in fresh if d >= 1000)


def test_language_model(spark, texts):
    got = rows(spark, "op3_class_lm")
    token = lambda t: t.encode().lower().split() + [b"\n"]
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    c = collections.Counter(w for d, t in texts.items() if not held[d] for w in token(t))
    n, v = sum(c.values()), len(c)
    for d, t in texts.items():
        w, r = token(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_model_sums_to_one(spark):
    docs = frame(spark, ["a b a c.", "b a 7 é", "c. a b b"])
    model = {}
    kept = class_lm._fit
    class_lm._fit = lambda *a: model.setdefault("m", kept(*a))
    try:
        class_lm.class_lm_scores(docs, F.lit(False), head=2, classes=2)
    finally:
        class_lm._fit = kept
    m = model["m"]
    assert np.allclose((10**m.log_step).sum(axis=1), 1)
    assert m.class_tokens.sum() == m.train_tokens == 15 and m.class_words.sum() == m.distinct == 6


def test_exchange_separates_two_languages():
    # words 0-3 follow each other, and so do 4-7
    pairs = [(a, b, 10) for g in (range(4), range(4, 8)) for a in g for b in g]
    a, b, n = (np.array(x) for x in zip(*pairs, strict=True))
    of = class_lm.exchange(a, b, n, 8, 2)
    assert len(set(of[:4])) == len(set(of[4:])) == 1 and of[0] != of[4]


def test_rare_words_get_learned_classes(spark, monkeypatch):
    """Words outside the head, all of one shape, part by the words they stand between."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{o} {g}{rng.integers(20) * rng.integers(2)}x {c}" for _ in range(6)) for o, c, g in (("a", "b", "p"), ("d", "e", "q")) for _ in range(60)]
    seen, got = {}, {}

    def grow(m, learned, blocks):
        out = seen["grow"](m, learned, blocks)
        got["old"], got["new"], got["column"] = m, out[0], out[1]
        words = [w for r in seen["encoded"].collect() for p in r.parts for w in class_lm._split_words(bytes(p.words))]
        codes = [c for r in blocks.collect() for c in class_lm._open(bytes(r.classes), "<u2")]
        got["of"] = dict(zip(words, codes, strict=True)) if blocks.count() == 1 else {}
        return out

    write = class_lm.written
    monkeypatch.setattr(class_lm, "written", lambda df, label, *rows: seen.setdefault(label, write(df, label, *rows)))
    seen["grow"] = class_lm._grow
    monkeypatch.setattr(class_lm, "_grow", grow)
    class_lm.class_lm_scores(frame(spark, texts).coalesce(1), F.lit(False), head=7, classes=7)
    of, new, old = got["of"], got["new"], got["old"]
    sides = [{of[w] for w in of if w[:1] == g and w.endswith(b"x")} for g in (b"p", b"q")]
    assert got["column"] == "classes" and sides[0] and sides[1] and not sides[0] & sides[1]
    assert class_lm.likelihood(new.steps) > class_lm.likelihood(old.steps)
    assert new.class_tokens.sum() == new.train_tokens and new.class_words.sum() == new.distinct
    assert np.allclose((10**new.log_step).sum(axis=1), 1)


def brute_repeats(texts, window=50):
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("batch_words", "levels"), [(600_000, 1), (400, 2), (1, 4)])
def test_substring_dedup(spark, monkeypatch, batch_words, levels):
    """Prefixes of any length remove the same words; only where a group is too large are they lengthened."""
    seen, write = [], substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, label: seen.append(label) or write(df, label))
    rng = np.random.default_rng(5)
    passages = [" ".join(rng.choice(list("abcdefgh"), 70)) for _ in range(3)]
    docs = []
    for _ in range(40):
        parts = [" ".join(rng.choice(list("abcdefghij"), rng.integers(0, 60)))]
        for p in rng.choice(3, rng.integers(0, 3)):
            parts += [passages[p] if rng.random() < 0.7 else " ".join(passages[p].split()[5:58]), " ".join(rng.choice(list("klm"), rng.integers(0, 30)))]
        docs.append(" \n".join(parts))
    docs += [docs[3], "a " * 120, "a " * 200, "a " * 700 + "b c " * 900, "x " + "a " * 650, "b c " * 700]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, docs), batch_words).collect()}
    assert got == brute_repeats(dict(enumerate(docs)))
    assert any(x[1] for x in got.values()) and seen.count("stretches") >= levels and (levels > 1 or seen.count("stretches") == 1)


def test_blocks_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 64)
    words = [b"w%d" % i for i in range(700)]
    blocks = list(substring_dedup.window_blocks(b" \n".join(words)))
    assert len(blocks) > 10 and all(w == words[first : first + len(w)] for first, w in blocks)
    starts = [first + i for first, w in blocks for i in range(max(0, len(w) - 49))]
    assert starts == list(range(len(words) - 49))
    whole = substring_dedup.window_anchors(words)
    parts = np.concatenate([substring_dedup.window_anchors(w) for _, w in blocks])
    assert (whole == parts).all()


def test_batches_of_trees_are_bounded():
    groups = [(a, b" ".join(b"%d" % (a * 7 + i) for i in range(60)), d, d + 1) for a in range(40) for d in range(2)]
    cols = {k: [g[i] for g in groups] for i, k in enumerate(("anchor", "ctx", "least", "most"))}
    sizes, rows = [], substring_dedup._repeat_rows
    substring_dedup._repeat_rows = lambda r: sizes.append(sum(len(x[1].split()) for x in r)) or rows(r)
    try:
        out = list(substring_dedup._tree_rows(iter([media.pa.RecordBatch.from_pydict(cols)]), 300))
    finally:
        substring_dedup._repeat_rows = rows
    assert max(sizes) <= 300 and sum(sizes) == 40 * 120 and sum(b.num_rows for b in out) == 80


def test_substring_query(spark, texts):
    got = {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in rows(spark, "op4_substring_dedup").items()}
    assert got == brute_repeats(texts)


def test_quality_counts_and_score(spark, texts):
    extra = ["", "a a a a", "x y", "one two three one two three four", "\n\n a\na\n a\n", "# $ % <b>|&*"]
    all_ = dict(enumerate([*texts.values(), *extra]))
    docs = frame(spark, list(all_.values()))
    ratios = quality_rules.fit(docs, docs.where("doc_id % 2 = 0"))
    for r in quality_rules.judge(docs, ratios).collect():
        t = all_[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and r.kept == (not r.base_failed and r.llr >= -1.0)
    # the counts behind the ratios
    grams = {d: [b for b in bs] for d, bs in docs.select("doc_id", quality_rules.ngram_buckets(F.col("text")).alias("b")).collect()}
    raw = collections.Counter(b for bs in grams.values() for b in bs)
    good = collections.Counter(b for d, bs in grams.items() if d % 2 == 0 for b in bs)
    b = quality_rules.BUCKETS
    floor = quality_rules.FLOOR
    want = lambda i: math.log(good[i] / sum(good.values()) + floor) - math.log(raw[i] / sum(raw.values()) + floor)
    assert all(math.isclose(ratios[i], want(i), abs_tol=1e-9) for i in range(b))


def slow_ratio_buckets(text):
    """Buckets of the n-grams of word shapes; the hash is XXH64, one word seeding the next."""
    t = text
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"[\p{L}--[Aa]]+", "o"), (r"[0-9]+", "9")):
        t = regex.sub(pattern, sign, t, flags=regex.V1)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = []
    for i in range(max(1, len(w) - 2) if w else 0):
        h = 42
        for x in w[i : i + 3]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        out.append((h - (h >> 63 << 64)) % quality_rules.BUCKETS)
    return out


def slow_quality(texts, trusted):
    """Of each text (by id): whether it is kept."""
    grams = {d: slow_ratio_buckets(t) for d, t in texts.items()}
    raw, good = collections.Counter(itertools.chain(*grams.values())), collections.Counter(itertools.chain(*(g for d, g in grams.items() if d in trusted)))
    ratio = {b: math.log(good[b] / sum(good.values()) + 1e-6) - math.log(n / sum(raw.values()) + 1e-6) if good else 0.0 for b, n in raw.items()}
    out = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        llr = sum(ratio[b] for b in grams[d]) / len(grams[d]) if grams[d] else 0.0
        out[d] = len(w) >= 50 and 100 * len(inside) <= 50 * len(w) and llr >= -1.0
    return out


def test_quality_query(spark, texts):
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert {d: r.kept for d, r in rows(spark, "op5_quality_rules").items()} == slow_quality(texts, trusted)


def test_quality_keeps_good_and_rejects_junk(spark):
    got = rows(spark, "op5_quality_rules")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(got[d].kept for d, q in labels.items() if q == 1 and not got[d].base_failed)
    assert not any(got[d].kept for d, q in labels.items() if q == 0)


def slow_fingerprint(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def slow_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, texts):
    ids = sorted(texts)
    prints = [slow_fingerprint(texts[d]) for d in ids]
    want = slow_components(prints)
    got = rows(spark, "op6_simhash")
    assert all(got[d].fingerprint == f"{f:016x}" and got[d].component_id == ids[c] for d, f, c in zip(ids, prints, want, strict=True))


@pytest.mark.parametrize("tile", [4096, 8])
def test_links_keep_every_near_pair(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(tile)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = base + [b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)) for b in base for _ in range(6)] + [0, 7]
    prints = sorted(set(prints))
    signed = [int(np.array([p], np.uint64).view(np.int64)[0]) for p in prints]
    found = components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "f long"))).collect()
    root = {r.node: r.root for r in found}
    groups = lambda labels: {frozenset(i for i in range(len(labels)) if labels[i] == x) for x in set(labels)}
    assert groups([root.get(s, s) for s in signed]) == groups(slow_components(prints))


def test_large_tiles_are_compared_by_parts(monkeypatch):
    monkeypatch.setattr(simhash, "SIDE", 16)
    rng = np.random.default_rng(1)
    f = np.unique(rng.integers(0, 2**12, 300).astype(np.uint64))
    f = f[np.lexsort((f, np.bitwise_count(f)))]
    a, b = simhash.tile_groups(np.zeros(len(f), np.int64), f)
    at = {int(x): i for i, x in enumerate(f)}
    root = list(range(len(f)))
    for x, y in zip(a, b, strict=True):
        root[at[int(x)]] = at[int(y)]
    assert root == slow_components(f)


def test_tiles_too_large_are_dealt_again(monkeypatch):
    """Fingerprints that vary in 14 bits only, more of them than a task compares at once."""
    monkeypatch.setattr(simhash, "SPLIT", 200)
    rng = np.random.default_rng(2)
    at = rng.choice(64, 14, replace=False)
    f = np.array(sorted({sum(1 << int(k) for k, x in zip(at, row, strict=True) if x) for row in rng.random((400, 14)) < 0.3}), np.uint64)
    f = f[np.lexsort((f, np.bitwise_count(f)))]
    a, b = simhash.tile_groups(np.zeros(len(f), np.int64), f)
    place = {int(x): i for i, x in enumerate(f)}
    root = list(range(len(f)))
    for x, y in zip(a, b, strict=True):
        root[place[int(x)]] = place[int(y)]
    assert len(f) > 200 and root == slow_components(f)


def test_hot_fingerprints_meet_their_class(spark, monkeypatch):
    """A third of all rows have one text, and thousands of texts are alone."""
    texts = ["one and the same text again"] * 700 + [f"text number {i} of its own kind {i * 7}" for i in range(1400)] + [None, ""] * 5
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    want = slow_components([slow_fingerprint(t or "") for t in texts[:1] + texts[700:]])
    assert len(got) == len(texts) and all(got[i].component_id == 0 for i in range(700))
    assert [got[700 + i].component_id for i in range(len(texts) - 700)] == [0 if c == 0 else c + 699 for c in want[1:]]


PII = "Write to a.b@c.de, x@y.z_w@q.r, 10.0.0.1, 300.1.1.1, 1.2.3.4.5.6.7.8, 4111 1111 1111 1111, 4111-1111-1111-1112, +1 (555) 555-1234, +12 3, é😀 me@host.org"


def slow_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def ok(kind, m):
        d = [int(x) for x in re.sub("[^0-9]", "", m)]
        luhn = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds) for m in re.finditer(p, t) if ok(k, m.group()))


def test_base_spans(spark, texts):
    all_ = [PII, PII * 200, "+1 " * 50, "1" * 5000, "a" * 20_000 + "@b.c", *texts.values()]
    for r in pii.digest(pii.find(frame(spark, all_))).collect():
        want = slow_spans(all_[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_bootstrap_finds_new_identifiers(spark):
    rng = np.random.default_rng(2)
    hexa = lambda: "".join(rng.choice(list("0123456789abcdef"), 38)) + "a1"
    seeds = [f'my words here token = "{hexa()}" end of it' for _ in range(12)]
    mixed = [f'other words go to key: "{(k := hexa())}" and token = "{k}" here' for _ in range(6)]
    unseen = [f'other words go to key: "{hexa()}" now' for _ in range(3)]
    clean = ["the year 1999 was fine", "room 12 on floor 3"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(frame(spark, seeds + mixed + unseen + clean))).collect()}
    assert all("id:" in got[i] for i in range(21)) and not got[21] and not got[22]


def slow_discovered(texts, rounds=3, least_pattern=0.6, least_token=0.75, doubt=2.0):
    """The bootstrap in plain Python: of each text, the spans beyond the base."""
    space = "\x20\x09-\x0D"
    ident = "A-Za-z0-9._%+@/-"
    mention = regex.compile(rf"(?<![{ident}:])[A-Za-z._%+@:/-]*+[0-9][{ident}:]*+|(?<=[:=]\x20?['\"]?)(?<![{ident}])[A-Za-z][{ident}]*+")
    found = []
    for d, t in enumerate(texts):
        base, hits = slow_spans(t), list(mention.finditer(t))
        for i, m in enumerate(hits):
            token = m.group().rstrip(".:-/%")
            s, e = m.start(), m.start() + len(token)
            before = t[hits[i - 1].end() if i else 0 : s].rstrip(" \t\n\x0b\f\r\"'`")
            after = t[m.end() : hits[i + 1].start() if i + 1 < len(hits) else len(t)]
            words = lambda x: re.findall(f"[^{space}]+", x)
            left, right = " ".join(words(before)[-2:]).lower(), (words(after) or [""])[0].lower()
            token = token.lower()
            hexa = re.fullmatch("[0-9a-f]*[a-f][0-9a-f]*", token) and len(token) >= 16
            shape = f"x{len(token)}" if hexa else re.sub("[a-z]+", "a", re.sub("[0-9]", "9", token))
            in_base = any(b < e and s < f for b, _, f, _ in base)
            secret = re.search(r"(?i)(?:^|[^a-z])(?:token|secret|password|passwd|api[_-]?key)['\"]? ?[=:]$", left) and len(token) >= 16
            found.append((d, s, e, token, {p for p in (f"L {left}", f"R {right}", f"S {shape}") if len(p) > 2}, in_base, bool(in_base or secret)))
    graph, seeds = collections.defaultdict(set), collections.defaultdict(set)
    for *_, token, patterns, _, seed in found:
        for p in patterns:
            graph[p].add(token)
            seeds[p, token] = seeds[p, token] or seed
    score = {}
    for _ in range(rounds):
        rated = {p: sum(1.0 if seeds[p, t] else score.get(t, 0.0) for t in ts) / (len(ts) + doubt) for p, ts in graph.items()}
        rated = {p: x for p, x in rated.items() if x >= least_pattern}
        of = collections.defaultdict(list)
        for p in rated:
            for t in graph[p]:
                of[t].append(p)
        shaped = lambda ps: sum(p[0] == "S" for p in ps)
        score = {t: 1 - math.prod(1 - min(rated[p], 0.999) for p in ps) for t, ps in of.items() if len(ps) - shaped(ps) > 1 or shaped(ps) and len(ps) > shaped(ps)}
    out = collections.defaultdict(set)
    for d, s, e, token, _, in_base, seed in found:
        if not in_base and (seed or score.get(token, 0) >= least_token):
            out[d].add(f"id:{s}:{e}")
    return out


def test_discovery_equals_brute_force(spark, texts):
    rng = np.random.default_rng(9)
    hexa = lambda: "".join(rng.choice(list("0123456789abcdef"), 38)) + "a1"
    more = [f'my words here token = "{hexa()}" end of it' for _ in range(12)] + [f'some  key: "{hexa()}" end of it, user: Bob, x=1' for _ in range(9)]
    more += [f"write to u{i}@h.org about it, badge QX-{i:03d} about it" for i in range(9)] + ["x" * 3000 + f" 12.5.{i}.7 is here" for i in range(4)]
    all_ = [*texts.values(), *more]
    want = slow_discovered(all_)
    for r in pii.digest(pii.find(frame(spark, all_))).collect():
        assert {x for x in r.spans.split(",") if x.startswith("id:")} == want[r.doc_id], all_[r.doc_id][:300]
    assert sum(map(len, want.values())) >= 12


def test_contexts_alone_find_an_unseen_shape(spark):
    """Staff names and badges stand where addresses do; shapes and words that no seed has."""
    seeds = [f"please write to user{i}@example.org before noon today" for i in range(12)] + [f"the owner is: user{i}@example.org as agreed" for i in range(12)]
    unseen = ["please write to QX-77-b before noon today", "the owner is: hunter as agreed"]
    clean = ["the year 1999 was fine", "note: this is fine", "room 12 before 3 today"]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(frame(spark, seeds + unseen + clean))).collect()}
    assert "id:16:23" in got[24] and "id:14:20" in got[25]
    assert not any("id:" in got[i] for i in (26, 27, 28))


def test_redaction(spark):
    row = pii.redacted(frame(spark, [PII])).first()
    assert "[EMAIL]" in row.text and "[IP]" in row.text and "10.0.0.1" not in row.text and "300.1.1.1" in row.text


def test_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(40, n, replace=False)) + 1, rng.integers(1, 20, n)
        cost = lambda bs: sum(c * (min(b for b in bs if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost((*bs, lengths[-1])) for j in range(k) for bs in itertools.combinations(lengths, j))
        got = packing.boundaries(lengths, counts, k)
        assert len(got) <= k and cost(got) == best


def test_packing(spark, texts):
    got = packing.pack(frame(spark, list(texts.values())), token_budget=2000, max_len=900).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.bucket, r.batch].append(r.slot)
        assert r.n_words <= r.bucket <= 900 and r.padding == r.bucket - r.n_words
    assert all(sorted(s) == list(range(len(s))) and len(s) <= max(1, 2000 // b) for (b, _), s in by.items())
    full = collections.Counter(b for (b, _), s in by.items() if len(s) < max(1, 2000 // b))
    assert all(n == 1 for n in full.values())  # one open batch a bucket at most


def test_packing_carries_every_word(spark, texts):
    given = [(d, t) for d, t in texts.items()] + [(0, texts[0]), (0, "another text with one id")]
    by = collections.defaultdict(list)
    for r in packing.pack(spark.createDataFrame(given, "doc_id long, text string"), token_budget=2000, max_len=900).collect():
        w = r.words.split(" ") if r.words else []
        assert len(w) == r.n_words and r.first_word == 900 * r.piece
        by[r.doc_id, r.copy].append((r.piece, w))
    got = sorted((d, [w for _, p in sorted(ps) for w in p]) for (d, _), ps in by.items())
    assert got == sorted((d, [w.decode() for w in t.encode().split()]) for d, t in given)


def filled(n, w):
    """Shares by weight, with what is above twice the size shared out again until nothing is."""
    budget, capped = 1.5 * n.sum(), np.zeros(len(n), bool)
    while True:
        t = np.where(capped, 2 * n, w / w[~capped].sum() * (budget - 2 * n[capped].sum()) if (~capped).any() else 0)
        over = ~capped & (t > 2 * n)
        if not over.any():
            return t
        capped |= over


def test_targets(spark):
    rng = np.random.default_rng(6)
    for _ in range(6):
        n = rng.integers(1, 400, rng.integers(1, 9)).astype(float)
        t = filled(n, np.array([(5.0, 2.0, 1.0)[i % 3] for i in range(len(n))]))
        df = spark.createDataFrame([(f"s{i:02d}", int(x)) for i, x in enumerate(n)], "source string, n long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert all(math.isclose(got[f"s{i:02d}"], x, rel_tol=1e-9) for i, x in enumerate(t))


def slow_mix(docs):
    """docs: (doc_id, text, source). (doc_id, size, source_size, target, taken), sorted."""
    names = sorted({s for *_, s in docs if s is not None}) + [None] * any(s is None for *_, s in docs)
    size = [len((t or "").encode().split()) for _, t, _ in docs]
    n = np.array([sum(z for z, (*_, s) in zip(size, docs, strict=True) if s == x) for x in names], float)
    targets = filled(n, np.array([(5.0, 2.0, 1.0)[i % 3] for i in range(len(n))]))
    out = []
    for x, total, target in zip(names, n, targets, strict=True):
        epochs = math.floor(target / total + 1e-12) if total else 0
        rest, order = target - epochs * total, []
        for (d, t, s), z in zip(docs, size, strict=True):
            if s == x:
                t = t or ""
                u = (int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                odd = sum(c in "#*$%&|<>!0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t)
                order.append((-math.log(u) / max(0.05, 1 - odd / max(len(t), 1)), -1 if d is None else d, z))
        upto = 0
        for key, d, z in sorted(order):
            take = rest > 1e-9 and upto + z / 2 <= rest
            upto += z
            out.append((d, z, int(total), round(target, 4), int((epochs + take) * z)))
    return sorted(out)


@pytest.mark.parametrize(("pieces", "at_once"), [(1024, 256), (3, 1)])
def test_mixing_against_brute_force(spark, monkeypatch, pieces, at_once):
    """A whole source of least weight, another of equal texts, null ids, null sources and texts."""
    monkeypatch.setattr(mixing, "PIECES", pieces)
    monkeypatch.setattr(mixing, "SORTED", at_once)
    rng = np.random.default_rng(11)
    docs = [(i, "WORD " * int(rng.integers(1, 40)), "a") for i in range(150)] + [(1000 + i, "same text here", "b") for i in range(80)]
    docs += [(None, f"no id {i}", "c") for i in range(30)] + [(2000 + i, None if i % 5 == 0 else "x y " * i, None) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    got = [(-1 if r.doc_id is None else r.doc_id, r["size"], r.source_size, round(r.target, 4), r.taken) for r in mixing.mix(df).collect()]
    want = slow_mix(docs)
    assert [x for x in sorted(got) if x[0] >= 0] == [x for x in want if x[0] >= 0]
    # null ids draw one number: which of them are taken is a tie, how many words is not
    null = lambda rows: sum(x[4] for x in rows if x[0] < 0)
    assert abs(null(got) - null(want)) <= 3


def test_one_key_for_all_rows_is_cut_again(spark):
    """5000 equal rows: one key, one tie; the rows themselves are cut."""
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 4000, "a").otherwise("b").alias("source"))
    for s, rows in itertools.groupby(sorted(mixing.mix(df.withColumn("source", F.col("source"))).collect(), key=lambda r: r.source_size), lambda r: r.source_size):
        rows = list(rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1, s


def test_mixing(spark, monkeypatch):
    whole = {r.doc_id: r.taken for r in QUERIES["op9_mixing"](spark, SF).collect()}
    monkeypatch.setattr(mixing, "SORTED", 1)  # many rounds: the same documents
    monkeypatch.setattr(mixing, "PIECES", 4)
    got = QUERIES["op9_mixing"](spark, SF).collect()
    assert {r.doc_id: r.taken for r in got} == whole
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for s in set(source.values()):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
        assert all(r.taken <= 2 * r.size for r in own)


def paeth_png(image):
    """An image with each row filter in turn, by the definition of the format."""
    out = bytearray()
    for y, row in enumerate(image.tolist()):
        up = image[y - 1].tolist() if y else [0] * len(row)
        kind = y % 5
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            near = min((a, b, c), key=lambda q: (abs(p - q), (a, b, c).index(q)))
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
    head = media.struct.pack(">IIBBBBB", image.shape[1], len(image), 8, 0, 0, 0, 0)
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", zlib.compress(bytes(out))) + media._chunk(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(8)
    image = rng.integers(0, 256, (23, 64), dtype=np.uint8)
    assert (media.decode_png(paeth_png(image)) == image).all()
    for size in (0, 1, 63, 64, 65, 5000, 70_000):
        text = bytes(rng.integers(0, 256, size, dtype=np.uint8))
        stored = media.encode_png(media.payload_of(text))
        assert media.decode_png(stored).tobytes() == media.payload_of(text)
    for at in (3, 20, 45, len(stored) - 20):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))


def slow_png(data):
    """Samples of an 8-bit greyscale PNG, filter by filter as the format defines them."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big")
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, out = zlib.decompress(packed), []
    assert len(raw) == height * (width + 1)
    for y in range(height):
        kind, line, up, row = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], out[-1] if out else [0] * width, []
        assert kind in (0, 1, 2)
        for x, v in enumerate(line):
            row.append((v + (0, row[x - 1] if x else 0, up[x])[kind]) % 256)
        out.append(row)
    return out


def test_media_feature(spark, texts):
    """The stored image and its hash, from the definitions of the format and of the cosine transform."""
    some = dict(list(texts.items())[:12]) | {-1: "", -2: "short", -3: max(texts.values(), key=len)}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    held = {r.doc_id: r for r in media.stored(docs).collect()}
    for r in media.media_columns(docs).collect():
        data, payload = bytes(held[r.doc_id].media), media.payload_of(some[r.doc_id].encode())
        image = slow_png(data)
        assert bytes(itertools.chain(*image)) == payload and r.media_bytes == len(data) and r.media_sha256 == hashlib.sha256(data).hexdigest()
        n = len(image)
        bands = [image[i * n // 32 : (i + 1) * n // 32] if n >= 32 else [image[i * n // 32]] for i in range(32)]
        small = [[sum(line[2 * x] + line[2 * x + 1] for line in b) / (2 * len(b)) for x in range(32)] for b in bands]
        wave = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
        half = [[sum(wave[k][y] * small[y][x] for y in range(32)) for x in range(32)] for k in range(8)]
        low = [sum(half[k][x] * wave[j][x] for x in range(32)) for k in range(8) for j in range(8)]
        middle = sorted(low[1:])[31]
        bits = f"{int(r.feature, 16):064b}"
        assert all((b == "1") == (v > middle) for b, v in zip(bits, low, strict=True) if abs(v - middle) > 1e-5)


def test_media_query(spark, texts):
    for d, r in rows(spark, "op10_media_columns").items():
        p = media.payload_of(texts[d].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[d].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_held_out_flag(spark):
    got = spark.range(50).select("id", id_remainder(5, "id").alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)
