"""Every operator and stage on nulls, empty and long texts, repeats, ties, empty tables, clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import class_lm, language_id, media, mixing, packing, pii, quality_rules, simhash, substring_dedup, toxicity

LONG = "word " * 30_000 + "x" * 50_000 + " 1" * 5_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "a"),
    (1, "Another text with the same id, call +1 (555) 555-1234.", "en", "a"),
    (2, None, "en", None),
    (None, "No id but a text of a few words 10.0.0.1", None, "b"),
    (None, None, None, None),
    (3, "", "de", "b"),
    (4, " \t\n\x0b\x0c\r ", "de", "b"),
    (5, LONG, "de", "b"),
    (6, "12 34 !!", "fr", "c"),
    (7, "\x00 nul ퟿ 😀 é İ ß", "fr", "c"),
    (8, "The quick brown fox jumps over the lazy dog. " * 12, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that operators use inside.
CLASH = ["th", "ord", "f", "size", "key", "kept", "bucket", "n", "_h", "n_words", "base", "spans", "bin", "label", "score"]


def docs(spark, empty=False):
    df = spark.createDataFrame([] if empty else ROWS, SCHEMA)
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in CLASH})


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (2, 0, 1), (5, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (8, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "language": lambda s, d, e: language_id.identify(d, language_id.fit(d)),
    "toxicity": lambda s, d, e: toxicity.score(d, toxicity.fit(d, labels(s, e))),
    "lm": lambda s, d, e: class_lm.class_lm_scores(d, F.coalesce(F.col("doc_id") == 3, F.lit(False)), head=8, classes=3),
    "substring": lambda s, d, e: substring_dedup.remove_repeats(d),
    "quality": lambda s, d, e: quality_rules.judge(d, quality_rules.fit(d, labels(s, e).where("quality = 1"))),
    "simhash": lambda s, d, e: simhash.near_duplicates(d),
    "pii": lambda s, d, e: pii.digest(pii.find(d)),
    "mixing": lambda s, d, e: mixing.mix(d),
    "media": lambda s, d, e: media.media_columns(d),
}


NOTHING = hashlib.sha256(b"").hexdigest()
#: What each operator gives for a text of no words: null, empty, white space only.
WORDLESS = {
    "language": {"lang_pred": "und", "score": 0.0},
    "lm": {"n_tokens": 1, "n_known": 1},
    "substring": {"n_words": 0, "n_removed": 0, "kept_sha256": NOTHING},
    "quality": {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": True, "kept": False},
    "simhash": {"fingerprint": "0" * 16, "component_id": 2},
    "pii": {"n_email": 0, "n_ip": 0, "n_card": 0, "n_phone": 0, "base_sha256": NOTHING, "spans": ""},
    "mixing": {"size": 0, "taken": 0},
    "media": {"payload_bytes": 64},
}


def test_values_of_single_rows(spark):
    """Wordless texts, and what the table was made to hold: equal texts, an address, a phone number."""
    span = lambda kind, i, x: f"{kind}:{ROWS[i][1].index(x)}:{ROWS[i][1].index(x) + len(x)}"
    got = {name: OPERATORS[name](spark, docs(spark), False).collect() for name in WORDLESS}
    for name, wanted in WORDLESS.items():
        rows = [r for r in got[name] if r.doc_id in (2, 3, 4)]
        assert len(rows) == 3
        for r in rows:
            assert {c: r[c] for c in wanted} == wanted, (name, r.doc_id)
    assert [r.component_id for r in got["simhash"] if r.doc_id in (1, 8)].count(1) >= 3
    assert sorted((r.n_ip, r.spans) for r in got["pii"] if r.doc_id is None) == [(0, ""), (1, span("ip", 4, "10.0.0.1"))]
    assert sorted((r.n_phone, r.spans) for r in got["pii"] if r.doc_id == 1) == [(0, ""), (0, ""), (1, span("phone", 2, "+1 (555) 555-1234"))]
    assert [(r.n_words, r.kept) for r in got["quality"] if r.doc_id == 6] == [(3, False)]
    same = [r for r in got["media"] if r.doc_id == 8 or r.doc_id == 1 and r.n_bytes == 540]
    assert len(same) == 3 and len({tuple(r)[1:] for r in same}) == 1


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, name, empty):
    got = OPERATORS[name](spark, docs(spark, empty), empty).collect()
    assert len(got) == (0 if empty else len(ROWS))
    if not empty:
        ids = [r.doc_id for r in got]
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)
        same = [r for r in got if r.doc_id == 1]
        assert same.count(same[0]) == 2 or same.count(same[1]) == 2


@pytest.mark.parametrize("empty", [False, True])
def test_packing(spark, empty):
    got = packing.pack(docs(spark, empty), max_len=1000).collect()
    if empty:
        assert not got
        return
    assert sum(r.n_words for r in got) == sum(len((r[1] or "").encode().split()) for r in ROWS)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == len(got) and all(r.padding >= 0 for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, tmp_path, empty):
    labels(spark, empty).write.parquet(f"{tmp_path}/labels.parquet")
    d = docs(spark, empty)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != "packing":
            assert out.columns == d.columns
        assert out.count() <= 2 * len(ROWS) + 200
    assert corpus_pipeline.STAGES[1][1](spark, d, str(tmp_path)).where("doc_id IN (1, 8) AND length(text) > 500").count() <= 1


def test_long_text_is_read_whole(spark):
    row = substring_dedup.remove_repeats(docs(spark)).where("doc_id = 5").first()
    assert row.n_words == len(LONG.split()) and row.n_removed == 0
