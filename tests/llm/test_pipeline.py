"""The five stages against a plain-Python run of the same operators, row by row."""

import collections
import hashlib

import numpy as np
import pytest
from test_brute import slow_components, slow_discovered, slow_fingerprint, slow_mix, slow_quality, slow_spans

import corpus_pipeline
from quire.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = np.random.default_rng(21)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    text = lambda n: ". ".join(" ".join(rng.choice(words, 9)) for _ in range(n))
    rows = []
    for i in range(60):
        t = text(int(rng.integers(4, 30)))
        if i % 6 == 0:
            t += f" write to user{i}@example.org or call +1 (555) 555-{1000 + i} from 10.0.{i}.7"
        rows.append([i, t, "en", "abc"[i % 3]])
    rows += [[100 + i, rows[i][1], "en", "b"] for i in range(8)]  # exact copies
    rows += [[200 + i, rows[10 + i][1].replace("bal", "BAL", 1), "en", "a"] for i in range(8)]  # equal but for case
    rows += [[300 + i, "#### 12 $$ ## %% 99 || " * 30 + text(2), "en", "c"] for i in range(6)]  # junk
    rows += [[400, None, "en", None], [401, "", "en", "a"], [402, "too short", "en", "b"], [403, "many " * 400, "en", "c"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before the first and after each stage."""
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(300, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(at)), name)
        out[name] = docs.collect()
    out["run"] = corpus_pipeline.run(spark, str(at)).collect()
    return out


def rows(found):
    return sorted(map(tuple, found), key=str)


def test_quality(stages):
    given = stages["documents"]
    kept = slow_quality({r.doc_id: r.text or "" for r in given}, set(range(0, 60, 2)))
    assert rows(stages["quality_rules"]) == rows(r for r in given if kept[r.doc_id])
    assert not {300, 400, 401, 402, 403} & {r.doc_id for r in stages["quality_rules"]} and len(stages["quality_rules"]) > 60


def test_near_duplicates(stages):
    given = sorted(stages["quality_rules"], key=lambda r: r.doc_id)
    root = slow_components([slow_fingerprint(r.text) for r in given])
    assert rows(stages["simhash_near_dedup"]) == rows(r for i, r in enumerate(given) if root[i] == i)
    assert len(stages["simhash_near_dedup"]) < len(given) - 10


def test_personal_data(stages):
    given = stages["simhash_near_dedup"]
    more = slow_discovered([r.text for r in given])
    want = []
    for i, r in enumerate(given):
        kinds = ("email", "ip", "card", "phone", "id")
        spans = {(s, k, e) for s, k, e, _ in slow_spans(r.text)} | {(int(x.split(":")[1]), 4, int(x.split(":")[2])) for x in more[i]}
        out, at = "", 0
        for s, k, e in sorted(spans):
            if s >= at:
                out += r.text[at:s] + f"[{kinds[k].upper()}]"
            at = max(at, e)
        text = out + r.text[at:]
        want.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows(stages["pii"]) == rows(want)
    assert sum("[EMAIL]" in r.text for r in stages["pii"]) >= 8


def test_mix(stages):
    given = stages["pii"]
    size = {r.doc_id: len(r.text.split()) for r in given}
    times = {d: taken // size[d] for d, *_, taken in slow_mix([(r.doc_id, r.text, r.source) for r in given])}
    assert rows(stages["mixing"]) == rows(r for r in given for _ in range(times[r.doc_id]))


def test_packing(stages):
    given = stages["mixing"]
    pieces = [(r.doc_id, p, w[4096 * p : 4096 * (p + 1)]) for r in given for w in [r.text.split()] for p in range(-(-len(w) // 4096))]
    count = collections.Counter(len(w) for *_, w in pieces)
    bounds = packing.boundaries(np.array(sorted(count)), np.array([count[n] for n in sorted(count)]), 16)
    want = sorted((d, p, " ".join(w), min(b for b in bounds if b >= len(w))) for d, p, w in pieces)
    assert sorted((r.doc_id, r.piece, r.words, r.bucket) for r in stages["packing"]) == want
    assert len({(r.bucket, r.batch, r.slot) for r in stages["packing"]}) == len(want)


def test_run_is_the_stages(stages):
    digest = lambda found: hashlib.sha256(repr(rows(found)).encode()).hexdigest()
    assert digest(stages["run"]) == digest(stages["packing"])
