"""Operators that fold over order, against brute force, and the expectations of the document model."""

import json
import math
import random
import re
import time
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.functions import unicode
from quire.functions.register import register, register_tables
from quire.operators import build, chunking, components, enrich, retrieval, similarity, store, structure, summaries, temporal, tree, usage, validate, vectors
from quire.plans import index as sections_plan
from quire.plans import index as index_queries
from quire.plans import structure as handbook
from quire.sources import buckets, files
from quire.streaming import ingest
from quire.streaming import jobs as jobs_stream

E = "event_id string, job_id string, document_id string, page_number int, operation string, model string, input_tokens int, output_tokens int, credits_used double, latency_ms int, cache_hit boolean, accuracy string, status string, timestamp timestamp"


def event(spark, *rows):
    base = lambda i, credits, op: (f"e{i}", "j", "d", i, op, "m", 5, 5, credits, 10, False, "EXACT", "success", None)
    return spark.createDataFrame([base(i, *x) for i, x in enumerate(rows)], E).withColumn("timestamp", F.timestamp_seconds(F.substring("event_id", 2, 9).cast("int")))


def test_usage_expectations(spark):
    e = event(spark, (0.21, "compression_generation"), (0.12, "ocr_extraction"))
    assert sum(x.credits_used for x in usage.reverse_trace(e, 0.33).collect()) >= 0.32
    two = event(spark, (1.0, "a"), (2.0, "b"))
    assert math.isclose(sum(x.credits for x in usage.credits_breakdown(two).collect()), 3.0)
    assert [x.credits_cumulative for x in usage.timeline(two).orderBy("timestamp").collect()] == [1.0, 3.0]


def test_spans_and_titles(spark):
    lines = spark.createDataFrame([("d", 1, 1, 0, "Hello"), ("d", 1, 2, 1, "World")], "doc_id string, page int, line_no int, global_idx int, text string")
    x = structure.char_spans(lines, spark.createDataFrame([("d", 0, 2)], "doc_id string, start int, end int")).first()
    assert (x.char_start, x.char_end) == (0, 11)
    register(spark)
    row = spark.sql("SELECT is_paragraph_title('which is furnished under section 39') a, is_structural_line('6.2 FORM GST REG-06') b, is_garbage_line('42') c, jaccard(token_set('one two six'), token_set('two six ten')) d, is_contents_page('', 'Contents\n1 A .... 1\n2 B .... 2\n3 C .... 3') e").first()
    assert row.a and row.b and row.c and row.d == 0.5 and row.e


def brute_greedy(texts, threshold=0.85):
    norm = lambda t: re.sub(r"[^\w\s]", "", " ".join(t.lower().split()))
    words = lambda t: set(re.findall("[a-z0-9]{3,}", t))
    accepted, hashes, out = [], set(), []
    for t in texts:
        n = norm(t)
        if len(n) < 20:
            out.append("too_short")
        elif n in hashes:
            out.append("exact")
        elif any(a and words(n) and len(a & words(n)) / len(a | words(n)) >= threshold for a in accepted):
            out.append("overlap")
        else:
            out.append("accepted")
            hashes.add(n)
            accepted.append(words(n[:5000]))
    return out


def test_greedy_dedup(spark):
    word = lambda i: f"word{i:02d}"
    texts = [" ".join(word(j) for j in range(i, i + 30)) for i in (0, 1, 2, 3, 4, 0, 60, 62, 61)] + ["short", "", " ".join(map(word, range(30))).upper()]
    got = similarity.greedy_dedup(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("id").collect()
    assert [x.outcome for x in got] == brute_greedy(texts)
    assert {"accepted", "overlap", "exact", "too_short"} == {x.outcome for x in got}


def test_windows_cover_the_text():
    text = " ".join(f"Sentence {i} is here." for i in range(40)) + "\n\n" + "".join(map(str, range(300))) + "\n\n\n\n" + " ".join(f"Tail {i}? Yes!" for i in range(30))
    got = chunking.windows(text, 300, 50)
    assert all(0 < len(c) <= 300 for c in got)
    clean = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text).strip())
    at = 0
    for c in got:
        found = clean.index(c, max(0, at - 310))
        assert found <= at + 2
        at = found + len(c)
    assert at == len(clean) and chunking.windows("", 300) == [] and chunking.windows("a  b", 100) == ["a b"]


def test_compression_band():
    raw = " ".join(f"Sentence number {i} says that the form is filed on the portal by the due date of the month." for i in range(30))
    out = enrich.compressed_text(raw)
    assert 0.5 <= len(out) / len(raw) <= 0.92 and out[-1] in ".?!"
    assert enrich.compress("") == "" and enrich.corrected("Ends with dash -", "raw") .endswith(".")


def test_repeated_sentences_stay_where_they_came_first():
    a, b, c = (f"The {x} is filed on the portal by the due date 11 of each month." for x in ("first form", "second form", "third form"))
    raw = f"{a} {b} {a} {c} {b}"
    assert enrich.compress(raw, 1.0, 0.9).split("\n") == [a, b, c]


def test_links_inside_a_document_are_not_lost(spark):
    """A/x equals B/x, and B/y is like B/x: B has an overlap of its own, A has none."""
    x = " ".join(f"word{i}" for i in range(60))
    rows = [("A", "a1", x), ("B", "b1", x), ("B", "b2", x + " more"), ("C", "c1", "quite another text of enough length to count here")]
    docs = spark.createDataFrame(rows, "doc string, id string, text string")
    assert [(r.a, r.b) for r in similarity.near_duplicate_pairs(docs, scope="doc").collect()] == [("b1", "b2")]
    assert [(r.a, r.b) for r in similarity.near_duplicate_pairs(docs).collect()] == [("a1", "b2")]


def test_renamed_ids(spark):
    assert tree.renamed(["x", "x", "x_a", "x", "content_0001", "content_0001", "content_0001"]) == ["x", "x_a", "x_b", "x_c", "content_0001", "content_a", "content_b"]
    assert tree.renamed(["k"] * 29)[-3:] == ["k_z", "k_za", "k_zaa"]
    n = spark.createDataFrame([("d", 1, "s", None), ("d", 2, "c", "s"), ("d", 3, "s", None), ("d", 4, "c", "s"), ("e", 1, "s", None)], "doc_id string, ordinal int, node_id string, parent_id string")
    got = [(x.doc_id, x.node_id, x.parent_id) for x in tree.relinked(n).orderBy("doc_id", "ordinal").collect()]
    assert got == [("d", "s", None), ("d", "c", "s"), ("d", "s_a", None), ("d", "c_a", "s_a"), ("e", "s", None)]


def test_repair_stage(spark):
    rows = [("root", None, 1, "ROOT", "ROOT"), ("document", "root", 2, "DOCUMENT", "Document"), ("c1", "document", 3, "CHAPTER", "One"), ("t", "c1", 4, "TOPIC", "T"), ("s", "t", 5, "SECTION", "misplaced"), ("l", "s", 6, "CONTENT", "leaf"), ("l", "s", 7, "CONTENT", "leaf again"), ("c2", "document", 8, "CHAPTER", "Two"), ("m", "c2", 9, "CONTENT", "last")]
    n = spark.createDataFrame([("d", *x) for x in rows], "doc_id string, node_id string, parent_id string, ordinal int, type string, title string")
    got = {x.node_id: (x.parent_id, x.title) for x in build.repaired(n, 2).collect()}
    assert got["s"][0] == "c1" and got["l"][0] == got["l_a"][0] == "s"
    assert got["c1"][0] == "ch_g1_1" and got["c2"][0] == "ch_g2_2" and got["ch_g1_1"] == ("document", "Main Guidance") and got["ch_g2_2"] == ("document", "Appendices")


def test_page_of_a_leaf(spark):
    n = spark.createDataFrame([("a", "CONTENT", "x <physical_index_7> y", 0, 0), ("b", "CONTENT", "no tag", 0, 0), ("c", "CONTENT", "paged", 3, 4)], "node_id string, type string, raw_content string, page_start int, page_end int")
    got = {x.node_id: (x.type, x.page_start, x.page_end) for x in build.with_pages(n).collect()}
    assert got == {"a": ("CONTENT", 7, 7), "b": ("FRONT_MATTER", 0, 0), "c": ("CONTENT", 3, 4)}


def test_page_summary_counts_all_events(spark):
    e = spark.range(6000).selectExpr("concat('e', id) event_id", "'j' job_id", "'d' document_id", "1 page_number", "'op' operation", "'m' model", "1 input_tokens", "1 output_tokens", "1.0D credits_used", "1 latency_ms", "false cache_hit", "'EXACT' accuracy", "'success' status", "timestamp_seconds(id) timestamp")
    assert usage.page_summary(e, document_id="d", page_number=1).first().credits == 6000.0 and usage.events_of(e, job_id="j").count() == 6000


def test_long_lines_keep_their_tail(spark):
    text = "word " * 40
    lines = spark.createDataFrame([("d", 1, 1, 0, "6.1 Scope", 10.0, False), ("d", 1, 2, 1, text, 10.0, False)], "doc_id string, page int, line_no int, global_idx int, text string, font_size double, is_bold boolean")
    spans = spark.createDataFrame([("d", 0, "6.1 Scope", 0, 2)], "doc_id string, line_idx int, title string, start int, end int")
    words = lambda **k: sum(len(x.raw_content.split()) for x in structure.semantic_chunks(lines, spans, 60, 2.0, **k).collect())
    assert words() >= 40 > words(whole=False)


def test_stored_columns_and_children(spark):
    n = validate_nodes(spark).withColumn("text", F.lit("old")).withColumn("children", F.array(F.lit("zzz")))
    errors = {x.error for x in validate.errors(n).select("error").distinct().collect()}
    assert {"Forbidden field 'text' must not be stored on nodes", "Legacy field 'text' present", "children mismatch"} <= errors
    listed = validate.blocking_errors(validate.errors(n), n).collect()
    assert all(0 < len(x.blocking_errors) <= 20 for x in listed)


def validate_nodes(spark):
    return sections_plan.sections(spark, "/root/testdata/sf0.001").where("ordinal < 40")


def test_metadata(spark):
    df = spark.createDataFrame([("6.2 FORM GST REG-06", "Download the certificate from the portal.")], "title string, raw string")
    a, k, s = df.select(enrich.aliases(F.col("title"), F.col("raw")), enrich.keywords(F.col("title"), F.col("raw")), enrich.synonyms(enrich.aliases(F.col("title"), F.col("raw")), F.col("title"))).first()
    assert a[0] == "6.2 FORM GST REG-06" and "GST REG-06" in a and "6.2" in a and "download GST registration certificate" in k and len(s) <= 18 and len({x.lower() for x in s}) == len(s)


def section(i, title, raw="", parent="p", **more):
    base = {"node_id": i, "parent_id": parent, "ordinal": int(i[1:]), "type": "CONTENT", "title": title, "path": f"ROOT > {title}", "raw_content": raw, "compressed_content": raw, "micro_summary": title, "aliases": [], "synonyms": [], "keywords": [], "is_front_matter": False, "retrieval_ready": True}
    return {**base, **more}


def test_search_with_entities(spark):
    nodes = [
        section("n0", "Returns chapter", parent=None, type="SECTION", retrieval_ready=False) | {"node_id": "p"},
        section("n1", "6.2 FORM GST REG-06", "The registration certificate can be downloaded.", aliases=["GST REG-06", "REG 06"], keywords=["gst reg 06"]),
        section("n2", "6.3 GSTR-1", "The return of supplies, see reg06.", keywords=["returns"]),
        section("n3", "10.9 Test your knowledge", "What is a return?"),
        section("n4", "Preface", "About gst.", is_front_matter=True),
    ]
    schema = "node_id string, parent_id string, ordinal int, type string, title string, path string, raw_content string, compressed_content string, micro_summary string, aliases array<string>, synonyms array<string>, keywords array<string>, is_front_matter boolean, retrieval_ready boolean"
    df = spark.createDataFrame([tuple(n[c.split()[0]] for c in schema.split(", ")) for n in nodes], schema)
    hits = retrieval.search(df, "what is GST REG 06").collect()
    assert hits[0].node_id == "n1" and hits[0].matched_title and hits[0].breakdown["entity_title_reg06"] == 200 and hits[0].breakdown["alias_entity"] == 190
    assert "n4" not in {h.node_id for h in hits} and "n3" not in {h.node_id for h in hits}
    assert hits[0].parent_title == "Returns chapter" and "6.3 GSTR-1" in hits[0].sibling_titles
    few = retrieval.search(df, "zzz test knowledge your").collect()
    assert few[0].node_id == "n3" and retrieval.pass_rate(df, [("GST REG 06", ["6.2"]), ("nothing", ["none"])]) == 0.5


def test_bm25_rises_with_the_term(spark):
    docs = spark.createDataFrame([(0, "tax " * 1 + "x " * 9), (1, "tax " * 3 + "x " * 7), (2, "x " * 10)], "doc_id long, text string")
    got = retrieval.rank_documents(docs, "tax", 5).collect()
    assert [h.doc_id for h in got] == [1, 0] and got[0].score > got[1].score > 0


def test_index_of_a_handbook(spark):
    nodes = build.build_index(handbook.handbook(spark)).cache()
    n = {x.node_id: x for x in nodes.collect()}
    kinds = {x.type for x in n.values()}
    assert {"ROOT", "DOCUMENT", "FRONT_MATTER", "SECTION", "UNIT", "TOPIC", "SUBTOPIC", "CONTENT", "CHAPTER"} <= kinds
    assert all(x.parent_id in n for x in n.values() if x.parent_id) and len({x.path for x in n.values()}) > 10
    root = next(x for x in n.values() if x.type == "ROOT")
    assert root.token_count_raw == sum(x.token_count_raw for x in n.values() if x.type == "CONTENT")
    unit = next(x for x in n.values() if x.type == "UNIT")
    assert any(x.parent_id == unit.node_id and x.title.startswith("6.1") for x in n.values())
    broken = nodes.withColumn("compressed_content", F.when(F.col("type") == "CONTENT", "").otherwise(F.col("compressed_content")))
    errors = {x.error for x in validate.node_errors(broken).select("error").distinct().collect()}
    assert "Missing compressed_content" in errors
    assert not validate.gates(validate.node_errors(broken), broken).first().compressed_content_valid


def test_index_of_all_documents(spark):
    """Every document has one tree; the handbook's is the one that it gets alone."""
    d = "/root/testdata/sf0.001"
    rows = index_queries.QUERIES["index_build"](spark, d).collect()
    ids = {str(r.doc_id) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()} | {"h"}
    nodes = {(r.doc_id, r.node_id) for r in rows}
    assert {r.doc_id for r in rows if r.type == "ROOT"} == ids and len(nodes) == len(rows)
    assert all((r.doc_id, r.parent_id) in nodes for r in rows if r.parent_id)
    alone = build.build_index(handbook.handbook(spark)).select(*rows[0].__fields__).collect()
    assert sorted(map(str, alone)) == sorted(str(r) for r in rows if r.doc_id == "h")


def test_saved_trees_and_texts(spark, tmp_path):
    tree = {"nodes": [{"title": "A", "nodes": [{"title": "B", "start_index": 3}]}, {"title": "C"}]}
    flat = files.trees(spark.createDataFrame([("d", json.dumps(tree)), ("e", None)], "doc_id string, json string")).orderBy("ordinal").collect()
    assert [(x.node_id, x.parent_id, x.title) for x in flat] == [("0001", None, "A"), ("0002", "0001", "B"), ("0003", None, "C")]
    (tmp_path / "cleaned/s/d1").mkdir(parents=True)
    (tmp_path / "cleaned/s/d1/x.pdf").write_bytes(b"%PDF")
    (tmp_path / "note.txt").write_text("whole\ntext")
    assert files.object_of(files.objects(spark, str(tmp_path), "s"), "d1").first().doc_id == "d1"
    assert files.texts(spark, f"{tmp_path}/note.txt").first().text == "whole\ntext"
    files.write_index(spark.createDataFrame([("é", None)], "title string, path string"), f"{tmp_path}/index")
    assert spark.read.json(f"{tmp_path}/index").first().title == "é"
    with pytest.raises(ValueError):
        files.Settings.from_options({"nope": 1})


def test_stream_upserts(spark, tmp_path):
    landing, table = tmp_path / "in", f"{tmp_path}/table"
    landing.mkdir()
    put = lambda name, rows: (landing / name).write_text("\n".join(json.dumps(x) for x in rows))
    put("1.json", [{"doc_id": "a", "text": "first", "landed": "2024-01-01T00:00:00"}, {"doc_id": "b", "text": "second", "landed": "2024-01-01T00:01:00"}, {"doc_id": "c", "text": "FIRST!", "landed": "2024-01-01T00:02:00"}])
    ingest.ingest(ingest.landing_documents(spark, str(landing)), table, f"{tmp_path}/cp").awaitTermination()
    put("2.json", [{"doc_id": "a", "text": "changed", "landed": "2024-01-01T00:30:00"}])
    ingest.ingest(ingest.landing_documents(spark, str(landing)), table, f"{tmp_path}/cp").awaitTermination()
    got = {x.doc_id: x.text for x in buckets.BucketTable(spark, table).read().collect()}
    assert got == {"a": "changed", "b": "second"}


def test_embeddings(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = {x.id: x.embedding for x in store.embedded(rows, "text").collect()}
    assert got[2] is None and math.isclose(sum(v * v for v in got[1]), 1, rel_tol=1e-5)


def test_dialects_agree_on_row_ids():
    assert "format_string" in r.row_id(r.SPARK, "a", "b") and "printf" in r.row_id(r.DUCK, "a", "b")


def test_similarity_reads_whole_texts(spark):
    """One opening of 6000 characters and other ends, and other openings of 2000 before one end."""
    words = lambda a, n: " ".join(f"{a}{i:05d}" for i in range(n))
    texts = [words("same", 700) + " " + words(e, 700) for e in "xy"] + [words(e, 230) + " " + words("tail", 3000) for e in "vw"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert [(r.a, r.b) for r in similarity.near_duplicate_pairs(docs).collect()] == [(2, 3)]
    assert [r.outcome for r in similarity.greedy_dedup(docs).orderBy("id").collect()] == ["accepted", "accepted", "accepted", "overlap"]


def test_placed_covers_documents(spark):
    d = "/root/testdata/sf0.001"
    ids = {str(r.doc_id) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id").collect()} | {"h"}
    assert {r.doc_id for r in handbook.QUERIES["structure_placed"](spark, d).select("doc_id").distinct().collect()} == ids


def test_compatibility_form(spark):
    import unicodedata

    texts = ["plain", None, "", "ﬁne ½ Ⅳ", "e\u0301", "ＧＳＴＲ－１", "日本 ㍿"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", unicode.nfkc("t").alias("t")).orderBy("i").collect()
    assert [x.t for x in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_leaves_of_one_number_are_merged(spark):
    body = "the levy covers every supply made in the state by a registered person"
    rows = [
        ("d", 1, 0, "6 Rates", body, 1, 3, "content", "chapter:1"),
        ("d", 4, 0, "7 Other", "nothing in common with any of them at all", 4, 5, "content", "chapter:1"),
        ("d", 6, 0, "6 rates ", body + " today", 6, 8, "content", "chapter:1"),
        ("d", 9, 0, "6 Rates", body, 9, 10, "content", "chapter:2"),
        ("d", 11, 0, "6.1 Rates", body, 11, 12, "content", "unit:1"),
        ("d", 13, 0, "6.1 Rates", body, 13, 14, "content", "unit:1"),
        ("d", 15, 0, "Plain", body, 15, 16, "content", "chapter:1"),
        ("d", 17, 0, "6 Rates", "wholly different words stand here instead", 17, 18, "content", "chapter:1"),
    ]
    got = build.merged_siblings(spark.createDataFrame(rows, build._SIBLING)).orderBy("line_idx").collect()
    assert [(x.line_idx, x.start, x.end) for x in got] == [(1, 1, 8), (4, 4, 5), (9, 9, 10), (11, 11, 12), (13, 13, 14), (15, 15, 16), (17, 17, 18)]
    assert got[0].raw_content == body + "\n" + body + " today"


def test_cosine_in_blocks_is_the_same(spark):
    v = spark.range(200).select("id", F.array(*(F.sin(F.col("id") * i + i) for i in range(1, 7))).alias("embedding"))
    v = v.unionByName(spark.createDataFrame([(900, [0.0] * 6), (901, None)], "id long, embedding array<double>"))
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    rows = lambda **k: sorted(map(tuple, store.cosine_top_k(v, q, 3, **k).collect()))
    one = rows()
    assert len(one) == 63 and one == rows(most=4, parts=3) == rows(most=1, parts=1)


def test_pairs_and_routing(spark):
    pairs = [("x", 0, "What?", "A form."), ("x", 1, "When?", "A form."), ("y", 0, "What?", "Soon."), ("z", 0, "Old?", None)]
    c = store.pair_rows(spark.createDataFrame(pairs, "doc_id string, pair int, question string, answer string"), "faq", ("question", "answer"))
    old = spark.createDataFrame([("o2", "Old?", 2), ("o1", "Old?", 1)], "id string, t string, created_at int").select("id", F.sha2("t", 256).alias("content_hash"), "created_at")
    rows, links = store.ingested_pairs(old, c)
    assert sorted((x.chunk_text, x.status, x.embedding is not None) for x in rows.collect()) == [("A form.", "not_embedded", False), ("Soon.", "not_embedded", False), ("What?", "embedded", True), ("When?", "embedded", True)]
    at = {(x.doc_id, x.pair, x.role): x for x in links.collect()}
    assert at["x", 0, "answer"].row_id == at["x", 1, "answer"].row_id and at["x", 0, "question"].row_id == at["y", 0, "question"].row_id
    assert at["z", 0, "question"].row_id == "o1" and len(at) == 7 and sum(x.is_new for x in at.values()) == 4
    pages = spark.createDataFrame([("n", 1, "GST / NOTICE\nTax is short"), ("n", 2, "GST / REPLY\nIt is not"), ("m", 1, "GST / REPLY only"), ("f", 1, "Q: Why?\nA: So."), ("g", 1, "no marks"), ("b", 1, "A book. " * 40), ("u", 1, "x")], "doc_id string, page int, text string")
    kinds = spark.createDataFrame([("n", "Notice_Reply "), ("m", "notice_reply"), ("f", "faq"), ("g", "faq"), ("b", None), ("u", "memo")], "doc_id string, doc_type string")
    new, failed = chunking.routed(pages, kinds, old)
    assert sorted((x.doc_id, x.role or "", x.status) for x in new.collect()) == [("b", "", "completed"), ("f", "answer", "not_embedded"), ("f", "question", "embedded"), ("n", "notice", "embedded"), ("n", "reply", "not_embedded")]
    assert sorted(map(tuple, failed.collect())) == [("g", "no pairs"), ("m", "missing: notice"), ("u", "Unknown doc_type: memo")]


def test_dedup_stats(spark):
    body = "this text is long enough to be kept by the rule"
    docs = spark.createDataFrame([(0, body), (1, body.upper()), (2, "short"), (3, body + " x")], "id long, text string")
    assert similarity.dedup_stats(similarity.greedy_dedup(docs)).first().asDict() == {"rejected_exact": 1, "rejected_overlap": 1, "too_short": 1, "accepted": 1}
    assert similarity.dedup_stats(docs.limit(0).withColumn("outcome", F.lit("exact"))).first().accepted == 0


def test_nodes_without_bodies(spark):
    n = index_queries.sections(spark, "/root/testdata/sf0.001").withColumn("token_count_raw", F.lit(1))
    whole, slim = build.exported(n), build.exported(n, body=False)
    assert set(whole.columns) - set(slim.columns) == {"raw_content", "compressed_content"}
    assert whole.drop("raw_content", "compressed_content").exceptAll(slim).isEmpty() and whole.count() == slim.count()


def nested_chapters(spark, depth):
    """ROOT > DOCUMENT > depth chapters > CONTENT, one below the other."""
    kinds = ["ROOT", "DOCUMENT", *["CHAPTER"] * depth, "CONTENT"]
    rows = [("d", f"n{i:04d}", f"n{i - 1:04d}" if i else None, i, k, f"Title {i}", 5 if k == "CONTENT" else 0) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ordinal int, type string, title string, n long")


@pytest.mark.parametrize("depth", [1, 12, 1000])
def test_trees_of_any_depth(spark, depth):
    nodes = nested_chapters(spark, depth)
    total = depth + 3
    placed = {r.node_id: r for r in tree.paths(nodes).collect()}
    assert {k: r.depth for k, r in placed.items()} == {f"n{i:04d}": i for i in range(total)}
    assert placed[f"n{total - 1:04d}"].path.count(" > ") == total - 1
    assert {r.n for r in tree.rollup(nodes, "n").collect()} == {5}
    assert tree.misplaced(nodes).isEmpty() and tree.cyclic(nodes).isEmpty() and tree.orphans(nodes).isEmpty()
    assert [r.seq for r in tree.preorder(nodes).orderBy("ordinal").collect()] == list(range(1, total + 1))
    text = tree.nested(nodes, ("node_id",)).first().tree
    assert text == "[" + "".join(f'{{"node_id":"n{i:04d}","nodes":[' for i in range(total)) + "]}" * total + "]"


def test_a_cycle_beside_clean_nodes(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("x", "z"), ("y", "x"), ("z", "y"), ("below", "y"), ("self", "self"), ("orphan", "gone"), ("kid", "orphan")]
    rows = [("d", i, p, k, "CONTENT", i, 1) for k, (i, p) in enumerate(links)] + [("e", "x", None, 0, "ROOT", "x", 1)]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ordinal int, type string, title string, n long")
    assert {tuple(r) for r in tree.cyclic(nodes).collect()} == {("d", i) for i in ("x", "y", "z", "below", "self")}
    assert {(r.doc_id, r.node_id) for r in tree.paths(nodes).collect()} == {("d", "a"), ("d", "b"), ("d", "c"), ("e", "x")}
    sums = {r.node_id: r.n for r in tree.rollup(nodes, "n").where("doc_id = 'd'").collect()}
    assert sums == {"a": 3, "b": 2, "c": 1, "orphan": 2, "kid": 1, "x": 1, "y": 1, "z": 1, "below": 1, "self": 1}
    assert {r.node_id for r in tree.preorder(nodes).where("doc_id = 'd'").collect()} == {"a", "b", "c", "orphan", "kid"}
    found = {(r.node_id, r.ancestor_id, r.distance) for r in tree.ancestors(nodes).where("doc_id = 'd'").collect()}
    assert ("c", "a", 2) in found and ("kid", "orphan", 1) in found and not any(n == "below" for n, *_ in found)
    empty = nodes.limit(0)
    assert tree.paths(empty).isEmpty() and tree.cyclic(empty).isEmpty() and tree.nested(empty).isEmpty()


@pytest.mark.parametrize("task_links", [200_000, 5])
def test_settling_by_component_equals_one_by_one(spark, task_links):
    rnd = random.Random(3)
    links = sorted({tuple(sorted(rnd.sample(range(300), 2))) for _ in range(350)})
    out = set()
    for b in sorted({b for _, b in links}):
        if {a for a, x in links if x == b} - out:
            out.add(b)
    got = similarity.rejected(spark.createDataFrame(links * 2, "a long, b long"), task_links)
    assert sorted(r.id for r in got.collect()) == sorted(out)


def test_a_chain_of_a_thousand_is_settled_in_a_few_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")
    assert {r.id for r in similarity.rejected(links).collect()} == set(range(1, 1001, 2))
    roots = components.components(links.union(spark.createDataFrame([(2000, 2000), (3000, 3001)], "a long, b long"))).collect()
    assert {r.node: r.root for r in roots} == {**{i: 0 for i in range(1001)}, 2000: 2000, 3000: 3000, 3001: 3000}
    assert components.components(links.limit(0)).isEmpty() and similarity.rejected(links.limit(0)).isEmpty()


@pytest.mark.parametrize("tile_bits", [8, 3, 0])
def test_section_overlaps_equal_all_pairs(spark, tile_bits):
    rnd = random.Random(9)
    words = [f"w{i}w" for i in range(60)]
    rows = [(f"d{i % 2}", i, f"{i % 3}.{i % 2} T{i % 7}", " ".join(rnd.sample(words, rnd.choice([1, 4, 9, 14])))) for i in range(120)]
    rows += [("d0", 200, "1.1 Same", rows[3][3]), ("d1", 201, "no number", rows[3][3]), ("d0", 202, "1.1 Empty", "")]
    sets = {(d, o): (t, t.split()[0] if t[0].isdigit() else "", set(x.split()), x) for d, o, t, x in rows}
    want = set()
    for (d, o), (t, sec, w, x) in sets.items():
        hits = [o2 for (d2, o2), (t2, sec2, w2, x2) in sets.items() if d2 == d and o2 < o and sec and sec2 == sec and t2 != t and x2 != x and w & w2 and len(w & w2) / len(w | w2) >= 0.15]
        want |= {(d, o, min(hits))} if hits else set()
    got = similarity.section_overlaps(spark.createDataFrame(rows, "doc_id string, ordinal int, title string, text string"), tile_bits=tile_bits)
    assert {tuple(r) for r in got.collect()} == want


def directions(spark, n, dim=8, seed=2):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.normal(size=dim) + 3 * np.eye(dim)[i % 4]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


@pytest.mark.parametrize("lists", [1, 7, None])
def test_inverted_lists_are_exact(spark, monkeypatch, lists):
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    rows = directions(spark, 500).unionByName(spark.createDataFrame([(900 + i, [1.0] * 8) for i in range(150)] + [(2000, [0.0] * 8), (2001, None), (2002, [float("nan")] * 8)], "id long, embedding array<float>"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = vectors.build(rows, lists)
    assert index.vectors.count() == 650 and index.lists.agg(F.max("parts")).first()[0] > 1
    got = vectors.search(index, asked, 4)
    want = store.cosine_top_k(vectors.usable(rows), vectors.usable(asked), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    tie = [r.id for r in got.where("query_id = 950").orderBy("rank").collect()]
    assert tie == [900, 901, 902, 903]


def test_probing_reaches_the_recall_that_was_asked_for(spark):
    rows = directions(spark, 3000, 16)
    index = vectors.build(rows, 40)
    asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding")
    probes = vectors.tuned_probes(index, asked)
    assert 1 <= probes < 40
    sums = vectors.recall(vectors.search(index, asked, 5, probes), vectors.search(index, asked, 5)).agg(F.sum("found"), F.sum("wanted")).first()
    assert sums[1] == 1500 and sums[0] / sums[1] >= 0.9


def test_vectors_of_an_empty_table(spark):
    index = vectors.build(directions(spark, 3).limit(0))
    assert vectors.search(index, directions(spark, 3).withColumnRenamed("id", "query_id")).isEmpty()


def test_range_and_interval_joins_equal_all_pairs(spark):
    rnd = random.Random(4)
    points = [(i, rnd.choice([None, *range(-50, 50)]), rnd.choice([1, 2, None])) for i in range(150)]
    spans = [(i, lo := rnd.choice([None, *range(-60, 60)]), None if rnd.random() < 0.1 or lo is None else lo + rnd.choice([-2, 0, 1, 2, 3, 8, 40, 100]), rnd.choice([1, 2, None])) for i in range(60)]
    p = spark.createDataFrame(points, "p int, x long, k int")
    s = spark.createDataFrame(spans, "s int, lo long, hi long, k int")
    inside = lambda x, lo, hi: None not in (x, lo, hi) and lo <= x < hi
    got = temporal.range_join(p.drop("k"), s.drop("k"), "x", "lo", "hi")
    assert sorted((r.p, r.s) for r in got.collect()) == sorted((a[0], b[0]) for a in points for b in spans if inside(a[1], b[1], b[2]))
    keyed = temporal.range_join(p, s, "x", "lo", "hi", ("k",))
    assert sorted((r.p, r.s) for r in keyed.collect()) == sorted((a[0], b[0]) for a in points for b in spans if a[2] == b[3] and a[2] and inside(a[1], b[1], b[2]))
    t = s.select(F.col("s").alias("t"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), "k")
    both = temporal.overlaps(s.drop("k"), t.drop("k"), ("lo", "hi"), ("lo2", "hi2"))
    real = [x for x in spans if None not in x[1:3] and x[1] < x[2]]
    assert sorted((r.s, r.t) for r in both.collect()) == sorted((a[0], b[0]) for a in real for b in real if a[1] < b[2] and b[1] < a[2])
    assert temporal.range_join(p.drop("k"), s.drop("k").limit(0), "x", "lo", "hi").isEmpty()


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof_and_trailing_equal_brute_force(spark, width):
    rnd = random.Random(5)
    rows = lambda n: [(i, rnd.choice([None, *range(60)]), rnd.choice(["a", "a", "a", "b", None])) for i in range(n)]
    left, right = rows(120), [*rows(50), (50, 3, "a"), (51, 3, "a")]
    found = temporal.asof_join(spark.createDataFrame(left, "i int, x long, k string"), spark.createDataFrame(right, "j int, y long, k string"), "x", "y", ("k",), width, "j")
    want = {}
    for i, x, k in left:
        known = [(y, j) for j, y, k2 in right if x is not None and y is not None and k2 == k and y <= x]
        want[i] = max(known)[1] if known else None
    assert {r.i: r.j for r in found.collect()} == want and found.count() == len(left)
    sums = temporal.trailing(spark.createDataFrame(left, "i int, x long, k string"), "x", ("k",), width, n=F.count("*"), total=F.sum("i"))
    slow = {i: (sum(k2 == k and x2 is not None and x - width <= x2 <= x for _, x2, k2 in left), sum(j for j, x2, k2 in left if k2 == k and x2 is not None and x - width <= x2 <= x)) if x is not None else (None, None) for i, x, k in left}
    assert {r.i: (r.n, r.total) for r in sums.collect()} == slow


def test_sketches_are_merged(spark):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("day"), (F.col("id") % 1000).cast("double").alias("v"))
    got = summaries.estimates(summaries.merged(summaries.sketched(rows, ["day"], "id", "v"), []), (0.5,)).first()
    assert got.n == 20_000 and abs(got.distinct - 20_000) < 1000 and abs(got.q[0] - 500) < 40


def test_bucket_table_rewrites_what_it_must(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string, t int")
    t = buckets.BucketTable(spark, f"{tmp_path}/t").create(rows().schema, ["k"], 8)
    with pytest.raises(ValueError):
        buckets.BucketTable(spark, f"{tmp_path}/none").read()
    merge = buckets.newest("t", "k")
    t.write(rows(*[(i, "a", 1) for i in range(40)], (None, "a", 1)), merge, ("w", 0))
    before = t.manifest()["folders"]
    t.write(rows((3, "b", 2), (3, "old", 0), (4, "older", 0), (100, "new", 1)), merge, ("w", 1))
    after = t.manifest()["folders"]
    assert sum(before.get(b) == f for b, f in after.items()) >= 5  # untouched buckets keep their files
    got = {r.k: (r.v, r.t) for r in t.read().collect()}
    assert got == {**{i: ("a", 1) for i in (None, *range(40))}, 3: ("b", 2), 100: ("new", 1)}
    assert {r.k: r.v for r in t.read(1).collect()}[3] == "a"  # a version stays as it was
    version = t.versions()[-1]
    assert t.write(rows((5, "again", 9)), merge, ("w", 1)) == version and t.read().where("v = 'again'").isEmpty()
    t.write(rows((7, "x", 1), (7, "y", 1)), buckets.replacing("k"))
    assert sorted(r.v for r in t.read().where("k = 7").collect()) == ["x", "y"] and t.read().count() == 43
    assert t.vacuum(1) > 0 and t.read().count() == 43 and len(t.versions()) == 1
    t.write(rows(), merge)
    assert t.read().count() == 43
    with pytest.raises(buckets.Conflict):
        t._publish(t.versions()[-1], t.manifest())


def test_job_totals_with_late_and_repeated_rows(spark, tmp_path):
    land, out, cp = (tmp_path / x for x in ("in", "out", "cp"))
    land.mkdir()
    before = {k: spark.conf.get(k, None) for k in jobs_stream.STORE}
    for k, v in jobs_stream.STORE.items():
        spark.conf.set(k, v)

    def run(name, rows):
        (land / name).write_text("\n".join(json.dumps(dict(zip(["event_id", "job_id", "timestamp", "credits_used", "status"], r, strict=True))) for r in rows))
        events = spark.readStream.schema("event_id string, job_id string, timestamp timestamp, credits_used double, status string").json(str(land))
        q = jobs_stream.job_totals(events, limit=2).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(cp)).trigger(availableNow=True).start(str(out))
        q.awaitTermination()
        rows = spark.read.schema(jobs_stream.TOTALS).parquet(str(out)).orderBy("events", "alert").collect()
        return {r.job_id: tuple(r)[1:] for r in rows}  # the last row of each job

    try:
        t = lambda m: f"2024-01-01T00:{m:02d}:00Z"
        first = run("1.json", [("e1", "a", t(30), 0.1, "failed"), ("e1", "a", t(30), 0.1, "failed"), ("e2", "a", t(31), 0.2, "success"), ("e3", "b", t(32), None, None)])
        assert first == {"a": (2, 300_000_000, 1, None), "b": (1, 0, 0, None)}
        # a restart goes on with the state; e2 is repeated, e0 is later than the watermark (22), e4 is not
        last = run("2.json", [("e2", "a", t(31), 0.2, "success"), ("e0", "a", t(1), 5.0, "failed"), ("e4", "a", t(25), 0.5, "failed")])
        assert last["a"] == (3, 800_000_000, 2, "retry_explosion")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_page_chunks_take_a_partition_in_order(spark):
    register_tables(spark)
    pages = [("a", 2, "second " * 40), ("a", 1, "first"), ("a", 3, None), ("b", 1, " "), ("c", 1, "word " * 300)]
    spark.createDataFrame(pages, "doc_id string, page int, text string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT * FROM page_chunks(TABLE(some_pages) PARTITION BY (doc_id) ORDER BY (page), 200, 20)").collect()
    want = {d: chunking.windows("\n\n".join((t or "").strip() for k, p, t in sorted(pages) if k == d and (t or "").strip()), 200, 20) for d in "abc"}
    assert sorted(map(tuple, got)) == sorted((d, i, c) for d, parts in want.items() for i, c in enumerate(parts))


def test_provider_titles(spark):
    """A usable title stays; else a heading of the body; else the chapter or part that the title or the first line names."""
    long = "where the person who is liable to pay the tax has not paid it, and the officer has reason to believe that it is due"
    rows = [("6.2 Rates", ["x"]), ("section_3", ["1.2 Rates of tax", "more"]), ("section_3", ["Glossary of all the words that this book uses often", "more"]), (f"Part IV: {long}.", ["plain words"]), ("", ["plain words"]), ("", [])]
    got = spark.createDataFrame(rows, "t string, lines array<string>").selectExpr("t", f"{build.provider_title()} AS title").collect()
    assert [r.title for r in got] == ["6.2 Rates", "1.2 Rates of tax", "Glossary of all the words that this book uses often", f"Chapter IV {long}.", "", ""]


def test_last_of_each_breaks_ties_by_place(spark):
    rows = spark.createDataFrame([(k, n, float(p), p) for p in reversed(range(300)) for k, n in [(p % 3, p % 7 // 6)]], "k int, n int, v double, place int").repartition(7)
    got = {x.k: x.v for x in store.last_of_each(rows, "k", order="n", ties=("place",)).collect()}
    assert got == {k: float(next(p for p in range(300) if p % 3 == k and p % 7 == 6)) for k in range(3)}
    assert store.last_of_each(rows, "k", order="n", ties=("place",)).columns == ["k", "n", "v"]


def test_a_provider_answer_of_zero_credits(spark):
    bodies = ['{"usage": {"credits_used": 0, "credits": 0.0, "prompt_tokens": 9}}', '{"credits": 0.0, "completion_tokens": 4}', '{"billing": {"total_credits": 0}}', '{"usage": {"credits_used": 0, "credits": 2.5}}', '{"usage": {"input_tokens": 3}}']
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string").select("i", usage.provider_usage(F.col("body")).alias("u")).orderBy("i").collect()
    assert [tuple(x.u) if x.u else None for x in got] == [(0.0, 9, 0), (0.0, 0, 4), (0.0, 0, 0), (2.5, 0, 0), None]


def test_summary_of_a_long_text_takes_one_pass(spark):
    """Sentences are split once a text, not once a sentence."""
    text = " ".join(f"Plain sentence number {i} stands here." for i in range(8000)) + " The tax form is due on the portal."
    began = time.monotonic()
    row = spark.createDataFrame([("6.1 Part", text)], "title string, raw_content string").select(enrich.micro_summary(F.col("title"), "raw_content").alias("s")).first()
    assert row.s == "Covers 6.1 Part. The tax form is due on the portal. Plain sentence number 0 stands here."
    assert time.monotonic() - began < 30


def test_many_repeated_ids_take_one_pass():
    """The place of a suffix is found without trying all before it, and names are not made on the way."""
    began = time.monotonic()
    got = tree.suffixes(["k"] * 200_000)
    assert got[0] is None and got[1] == ("k", 0) and got[-1] == ("k", 199_998)
    assert time.monotonic() - began < 20
    rng = random.Random(5)
    for _ in range(200):
        ids = [rng.choice(["x", "x_a", "x_b", "x_c", "x_z", "x_za", "x_zaa", "x_7", "_a", "y_y", "x_a_b"]) for _ in range(60)]
        taken: set = set()
        out = []
        for i in ids:
            if i in taken:
                cut = re.fullmatch(r"(.*)_([a-z0-9]+)", i, re.S)
                base, tail = cut.groups() if cut else (i, "")
                later = lambda t: chr(ord(t) + 1) if len(t) == 1 and "a" <= t <= "y" else t + "a"
                tail = later(tail) if len(tail) == 1 and "a" <= tail <= "y" else "a"
                while f"{base}_{tail}" in taken:
                    tail = later(tail)
                i = f"{base}_{tail}"
            taken.add(i)
            out.append(i)
        assert tree.renamed(ids) == out


def test_numbers_and_trees_over_several_ranges(spark, monkeypatch):
    rows = spark.createDataFrame([("a" if i % 3 else None, i, (i * 37) % 101) for i in range(101)], "g string, i int, at int").repartition(5)
    got = tree.numbered(rows, ["g"], ["at"], "n").collect()
    for g in ("a", None):
        assert [x.n for x in sorted((x for x in got if x.g == g), key=lambda x: x.at)] == list(range(1, sum(x.g == g for x in got) + 1))
    monkeypatch.setattr(tree, "NESTED", 3)
    n = spark.createDataFrame([("d", f"n{i}", f"n{(i - 1) // 2}" if i else None, i) for i in range(20)], "doc_id string, node_id string, parent_id string, ordinal int")
    kids = lambda i: {"node_id": f"n{i}", "nodes": [kids(k) for k in (2 * i + 1, 2 * i + 2) if k < 20]}
    assert json.loads(tree.nested(n, ("node_id",)).first().tree) == [kids(0)]


def test_similarity_join_equals_all_pairs_with_few_candidates(spark, monkeypatch):
    """Sets over few words, which share nearly all tokens singly: rows of pairs stay near those that are returned."""
    import random

    rnd = random.Random(5)
    sets = [set(rnd.sample(range(300), rnd.choice([1, 2, 5, 6, 7, 40, 120, 200]))) for _ in range(150)]
    for s in list(sets):
        sets.append({*sorted(s)[len(s) // 14 :], *rnd.sample(range(300, 320), len(s) // 14)})
    rows = [(i, [(x + 1) * 0x9E3779B97F4A7C15 % 2**63 for x in s]) for i, s in enumerate(sets)]
    d = similarity.materialized(spark.createDataFrame(rows, "id long, tokens array<long>"), "sets")
    sizes = {}

    def seen(df, label, f=similarity.materialized):
        out = f(df, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(similarity, "materialized", seen)
    for t in (0.5, 0.85, 1.0):
        want = sorted((a, b) for b in range(300) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t)
        got = similarity.jaccard_join(d, d, t)
        assert sorted((x.a, x.b) for x in got.collect()) == want and sorted((x.a, x.b) for x in similarity.jaccard_join(d, d.select("*"), t).collect()) == want
        assert t < 0.85 or sizes["pairs"] <= 2 * len(want) + 100
    assert sorted((x.a, x.b) for x in similarity.jaccard_join(d, d, 0.85, d.where("id % 2 = 0").select("id")).collect()) == sorted((a, b) for b in range(0, 300, 2) for a in range(0, b, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85)


def test_range_totals_equal_all_pairs(spark, monkeypatch):
    """Nulls, infinite values, repeated keys and empty intervals; no table holds pairs."""
    rnd = random.Random(6)
    values = [None, 0.1, 2.25, -7.5, 1e9, 0.0]
    points = [(rnd.choice([None, *range(-50, 50)]), rnd.choice(values)) for _ in range(400)] + [(500, float("nan")), (600, float("inf")), (700, float("-inf")), (800, None)]
    spans = [(i // 2, lo := rnd.choice([None, *range(-60, 60)]), None if rnd.random() < 0.1 or lo is None else lo + rnd.choice([-2, 0, 1, 2, 40, 100])) for i in range(60)]
    spans += [(100, 490, 510), (101, 590, 601), (102, 590, 701), (103, 700, 701), (104, 790, 900), (105, 600, 600)]
    want = {}
    for key, lo, hi in spans:
        for x, v in points:
            if None not in (lo, hi, x) and lo <= x < hi:
                want.setdefault(key, []).append(v)
    rows = []
    monkeypatch.setattr(temporal, "materialized", lambda df, label, f=temporal.materialized: [out := f(df, label), rows.append(out.count())][0])
    got = temporal.range_totals(spark.createDataFrame(points, "x long, v double"), spark.createDataFrame(spans, "s int, lo long, hi long"), "x", "lo", "hi", "s", "v")
    total = lambda vs: sum(known) if (known := [v for v in vs if v is not None]) else None
    assert {r.s: (r.n, repr(r.total and round(r.total, 4))) for r in got.collect()} == {k: (len(v), repr((t := total(v)) and round(t, 4))) for k, v in want.items()}
    assert rows and max(rows) <= len(points) + 2 * len(spans)


def test_cosine_of_copies_nulls_and_other_lengths(spark):
    """Of equal vectors the smaller ids come first; what has no cosine comes last, and what is no number first."""
    v = [(i, [1.0, 2.0]) for i in range(40)] + [(50, [2.0, 1.0]), (51, [1.0, None]), (52, [1.0, 2.0, 3.0]), (53, []), (54, [-1.0, -2.0])]
    df = spark.createDataFrame(v, "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 4.0]), (2, [0.0, 0.0]), (3, [2.0, 1.0]), (4, None), (5, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    for parts in (1, 4):
        got = {}
        for r in store.cosine_top_k(df, q, 3, parts=parts).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.cosine))
        none = [(0, None), (1, None), (2, None)]
        assert got == {1: [(0, 1.0), (1, 1.0), (2, 1.0)], 2: none, 3: [(50, 1.0), (0, 0.8), (1, 0.8)], 4: none, 5: [(52, 0.267261), (0, None), (1, None)]}
    assert "CartesianProduct" not in (plan := store.cosine_top_k(df, q, 3)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


def test_many_queries_equal_brute_force_without_rows_of_pairs(spark, monkeypatch):
    """Copies, repeated ids, empty and null texts, in one part and several; no table grows with documents times queries."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.choice([1, 5, 30]))) for i in range(120)]
    docs += [(200, docs[0][1]), (201, None), (202, ""), (7, docs[7][1]), (9, docs[9][1] + " w1 w2"), (300, docs[5][1])]
    queries = [(f"q{i}", text(12)) for i in range(30)] + [("none", "zzz"), ("empty", "")]
    index, n = {}, len(docs)
    for i, t in docs:
        tokens = (t or "").split()
        for w in tokens:
            index.setdefault(w, Counter())[i, len(tokens)] += 1
    avgdl = sum(len((t or "").split()) for _, t in docs) / n
    want = []
    for q, t in queries:
        score = Counter()
        for w, times in Counter(t.split()).items():
            for (i, dl), tf in index.get(w, {}).items():
                score[i] += times * math.log((n - len(index[w]) + 0.5) / (len(index[w]) + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
        want += [(q, i, rank + 1) for rank, (i, _) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5])]
    sizes = []
    monkeypatch.setattr(retrieval, "materialized", lambda df, label, f=retrieval.materialized: [out := f(df, label), sizes.append(out.count())][0])
    x, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id string, query string")
    for split in ({}, {"part_docs": 20, "block_queries": 4}):
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in retrieval.rank_queries(x, y, **split).collect()) == sorted(want)
    assert max(sizes) <= sum(len(set(t.split())) for _, t in queries)


def test_nodes_left_over_meet_many_tiles_in_one_group(spark, monkeypatch):
    """Nodes that overlap with none but their neighbour: groups grow with nodes, not with pairs of tiles."""
    pairs = 48
    rows = [("d", i, f"1.1 T{i}", f"only{i // 2} word{i // 2} text{i // 2} own{i}") for i in range(2 * pairs)]
    kept = similarity._wide_hits
    acc = spark.sparkContext.accumulator(0)

    def counted(threshold, size):
        one = kept(threshold, size)

        def run(nodes, earlier):
            acc.add(1)
            return one(nodes, earlier)

        return run

    monkeypatch.setattr(similarity, "_wide_hits", counted)
    got = similarity.section_overlaps(spark.createDataFrame(rows, "doc_id string, ordinal int, title string, text string"), tile_bits=1)
    assert sorted(tuple(r) for r in got.collect()) == [("d", 2 * i + 1, 2 * i) for i in range(pairs)]
    assert 0 < acc.value <= 12 * 7 * 2


def test_node_rules_read_a_text_once(spark):
    random.seed(3)
    signs = ["a", "Z", "9", "-", " ", "\t", "\n", "\x0b", ".", "É", "İ", "K", "ß"]
    texts = ["".join(random.choices(signs, k=random.randrange(14))) for _ in range(600)] + [None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.selectExpr("t", f"slice({r.query_tokens(r.SPARK, 't')}, 1, 3) AS all", f"{r.first_query_tokens('t', 3)} AS first", f"{r.SPARK.strip('t')} AS stripped", f"{r.SPARK.spaced('t')} AS spaced").collect()
    blank = " \t\n\x0b\x0c\r"
    for x in got:
        assert x.all == x["first"]
        assert (x.stripped, x.spaced) == ((None, None) if x.t is None else (x.t.strip(blank), re.sub(f"[{blank}]+", " ", x.t)))
    plan = validate.node_errors(validate_nodes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\((?:raw|trim\(coalesce\(text)", plan)) <= 2  # one for the rules, one for the hash


def test_readiness_finds_errors_once_and_joins_no_texts(spark):
    nodes = validate_nodes(spark)
    ready = validate.readiness(nodes, validate.node_errors(nodes))
    plan = ready._jdf.queryExecution().optimizedPlan().toString()
    assert "Garbage artifact" not in plan  # the rules are not part of it: their rows are a table
    for join in re.findall(r"Join LeftOuter.*\n(?:.*\n){2}", plan):
        assert "raw#" not in join


def test_near_pairs_of_long_ids_write_no_keys(spark, monkeypatch):
    nodes = validate_nodes(spark)
    tables = []
    kept = similarity.materialized
    monkeypatch.setattr(similarity, "materialized", lambda df, label: (tables.append((label, df.columns)), kept(df, label))[1])
    ids = F.concat(F.lit("a very long id of a text "), "node_id")
    found = similarity.near_duplicate_pairs(nodes.select(ids.alias("id"), F.col("raw_content").alias("text")))
    want = similarity.near_duplicate_pairs(nodes.select(F.col("node_id").alias("id"), F.col("raw_content").alias("text")))
    strip = lambda x: {tuple(sorted(i.split(" ")[-1] for i in (p.a, p.b))) for p in x.collect()}
    assert strip(found) == strip(want)
    assert all("keys" != label for label, _ in tables)  # one side: keys go straight to the count of their sets


def test_job_totals_call_the_state_a_few_times_a_job():
    """3000 events of a job, each twice, in batches of 1000: ids are told apart over batches, and calls don't grow with them."""

    class State:
        def __init__(self):
            self.calls, self.rows = 0, []

        def get(self):
            self.calls += 1
            return list(self.rows) if self.listed else (self.rows[0] if self.rows else None)

        def appendValue(self, row):
            self.calls, self.rows = self.calls + 1, [*self.rows, row]

        def put(self, rows):
            self.calls, self.rows = self.calls + 1, list(rows)

        def update(self, row):
            self.calls, self.rows = self.calls + 1, [row]

    class Handle:
        def state(self, *_):
            return State()

        def getValueState(self, *_):
            s = State()
            s.listed = False
            return s

        def getListState(self, *_):
            s = State()
            s.listed = True
            return s

    class Timer:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    job, timer = jobs_stream.JobTotals(5), Timer()
    job.init(Handle())
    ids = [f"e{i}" for i in range(3000)] * 2
    frame = lambda some, ms: pd.DataFrame({"event_id": some, "ms": [ms] * len(some), "credits_nano": [2] * len(some), "retry": [0] * len(some)})
    out = [*job.handleInputRows(("j",), iter([frame(ids[i : i + 1000], 10) for i in range(0, 6000, 1000)]), timer)][0]
    assert (out.events[0], out.credits_nano[0]) == (3000, 6000) and job.seen.calls + job.totals.calls < 20
    timer.now = 10  # at the watermark they are still known
    assert [*job.handleInputRows(("j",), iter([frame(["e1"], 12)]), timer)][0].events[0] == 3000
    timer.now = 11  # seen in this batch, and forgotten after it, but for what is new
    assert [*job.handleInputRows(("j",), iter([frame(["e1", "f1"], 12)]), timer)][0].events[0] == 3001
    assert [*job.handleInputRows(("j",), iter([frame(["e1", "f1"], 12)]), timer)][0].events[0] == 3002
    assert job.seen.rows == [(["f1"], [12]), (["e1"], [12])]


def test_contained_makes_token_sets_once(spark):
    words = [f"word{i}" for i in range(60)]
    text = lambda w: " ".join(w)
    cases = [(text(words), text(words[5:40]), True), (text(words), text(words[::-1]), True), (text(words), text(words[:55][::-1]), True), (text(words), text(words[:52][::-1]), False), (text(words), "word1 word2", False), ("", text(words), False), (None, text(words), False), (text(words), None, False), ("." * 50, "-" * 50, False), (text(words), "-" * 50, False)]
    df = spark.createDataFrame([(i, p, c) for i, (p, c, _) in enumerate(cases)], "i int, parent_text string, text string")
    found = similarity.contained(df)
    assert found.columns == ["i", "parent_text", "text", "duplicates_parent"]
    assert [x.duplicates_parent for x in found.orderBy("i").collect()] == [x for _, _, x in cases]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(regexp_extract_all(") == 2  # one of each text


def test_preorder_and_nesting_read_their_nodes_once(spark, tmp_path):
    """Costly nodes (a join, a grouping) are made once, not once a step: each time they are made leaves a file."""
    def made(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    rows = [("d", "a", None, 0), ("d", "b", "a", 1), ("d", "c", "b", 2), ("d", "e", "a", 3), ("d", "lost", "gone", 4), ("d", "x", "y", 5), ("d", "y", "x", 6)]
    given = spark.createDataFrame(rows, "doc_id string, node_id string, parent_id string, ordinal long").coalesce(1)
    text = tree.nested(given.mapInArrow(made, given.schema), ("node_id",)).first().tree
    leaf = lambda name, *below: {"node_id": name, "nodes": list(below)}
    assert json.loads(text) == [leaf("a", leaf("b", leaf("c")), leaf("e")), leaf("lost")]
    assert len(list(tmp_path.iterdir())) == 1


def ready_section(i, **more):
    """A sound leaf of the section p, and what differs."""
    raw = " ".join(f"levy{i}x{k}" for k in range(12)) + "."
    own = {"doc_id": "d", "node_id": f"n{i}", "parent_id": "p", "ordinal": i, "type": "CONTENT", "title": f"1.{i} Levy", "path": "d > 1", "raw_content": raw, "compressed_content": raw, "micro_summary": raw, "aliases": ["a"], "keywords": ["b"], "synonyms": ["c"], "page_start": 1, "page_end": 2, "char_start": 0, "char_end": 9, "content_hash": None, "retrieval_ready": False, "is_front_matter": False}
    return {**own, **more}


def ready_nodes(spark, *rows):
    head = ready_section(0, node_id="p", parent_id=None, type="SECTION", title="SECTION A", raw_content="", compressed_content="", micro_summary="", content_hash="")
    schema = "doc_id string, node_id string, parent_id string, ordinal long, type string, title string, path string, raw_content string, compressed_content string, micro_summary string, aliases array<string>, keywords array<string>, synonyms array<string>, page_start int, page_end int, char_start long, char_end long, content_hash string, retrieval_ready boolean, is_front_matter boolean"
    df = spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in (head, *rows)], schema)
    return df.withColumn("content_hash", F.coalesce("content_hash", F.expr(r.content_hash(r.SPARK, "raw_content"))))


def test_a_summary_is_grounded_in_the_whole_text(spark):
    words = " ".join(f"filler{i}" for i in range(800))
    nodes = ready_nodes(spark, ready_section(1, raw_content=f"{words} levy", micro_summary="Levy closes."), ready_section(2, raw_content=words, micro_summary="Levy closes."))
    of = lambda **k: {x.node_id for x in validate.node_errors(nodes, **k).where("error LIKE '%grounded%'").collect()}
    assert of() == {"n2"} and of(start=4000) == {"n1", "n2"}


def test_gates_and_readiness_read_rules_of_two_nodes(spark, monkeypatch):
    same = ready_section(1)["raw_content"]
    nodes = ready_nodes(spark, ready_section(1), ready_section(2, parent_id="gone"), ready_section(3, raw_content=same, compressed_content=same, micro_summary=same))
    monkeypatch.setattr(index_queries, "sections", lambda s, d: nodes)
    gates = index_queries.QUERIES["validate_gates"](spark, "").first()
    assert not (gates.no_orphans or gates.hierarchy_valid or gates.no_duplicate_chunks) and gates.no_cycles and gates.no_parser_artifacts
    assert [tuple(x) for x in index_queries.QUERIES["validate_readiness"](spark, "").collect()] == [("d", 3, 0, False)]


def test_readiness_asks_the_rules_of_a_candidate(spark):
    """Wrong pages close no gate and are no rule of a candidate; a numbered paragraph as title is no error, but such a rule."""
    ready = lambda *x: tuple(validate.readiness(ready_nodes(spark, *x), validate.node_errors(ready_nodes(spark, *x))).first())
    long = "1.2 The person shall pay the levy, and the officer may extend the time for the payment of it, where the person has applied for that in writing."
    assert ready(ready_section(1), ready_section(2, page_start=9)) == ("d", 2, 2, True)
    assert spark.range(1).selectExpr(r.paragraph_title(r.SPARK, f"'{long}'")).first()[0]
    assert ready(ready_section(1), ready_section(2, title=long)) == ("d", 2, 1, False)


def test_chunks_are_folded_in_one_stream_of_headings_made_once(spark):
    x = handbook.everything(spark, "/root/testdata/sf0.001")
    made = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode")
    found = structure.headings(x)
    kept = structure.without_clusters(found)
    spans = structure.ranges(kept, x)
    assert made(kept) == made(found) and made(spans) == made(found) + 1  # and once for the number of lines
    assert "CoGroup" not in structure.semantic_chunks(x, spans)._jdf.queryExecution().optimizedPlan().toString()


def test_a_sentence_is_weighed_once(monkeypatch):
    text = " ".join(f"The levy number {i} covers every supply of goods." for i in range(40))
    asked, worth = [], enrich.worth
    monkeypatch.setattr(enrich, "worth", lambda s: (asked.append(s), worth(s))[1])
    assert enrich.compressed_text(text) and len(asked) == len(set(asked)) == 40
    assert all(enrich._numbered(s) == any(c.isdigit() for c in s) for s in ("", "a1", "x²", "٣", "plain", "é", "½"))
