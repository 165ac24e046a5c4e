"""Enrichment and validation queries over documents as sections, and the same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.operators import build, enrich, tree, validate
from quire.operators import structure as st
from quire.plans import structure as sp
from quire.plans.text import TITLES
from quire.sources import files

#: Small bodies that mention forms, for metadata that no generated document reaches.
BODIES = ["", "Download the GST REG 06 certificate from the portal. The due date is the 11th.", "ITC is matched with GSTR-2A and GSTR2B every month; see GSTR 3B.", "Pay by GST PMT-06 or DRC-03. File GST CMP-08 when filing late. GSTR-1 follows.", "Nothing of note."]


PROVIDER_TREES = [
    ("b", {"nodes": [{"title": "Preface", "text": "Words before the book itself begins.", "page_index": 1}, {"title": "Chapter 1: Scope", "page_index": 2, "nodes": [{"title": "1.1 Levy", "text": "The levy covers every supply in the state."}, {"title": "section_3", "text": "1.2 Rates\nThe rates are set by notice each year."}]}, {"title": "Appendix A", "nodes": [{"title": "", "text": "Forms that are named in the text of the book."}]}, {"title": "Loose", "text": "short"}]}),
    ("s", {"title": "Single", "text": "One node that is the whole tree of its document."}),
]


def _titled(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(i, t, BODIES[i % len(BODIES)]) for i, t in enumerate(TITLES)], "i int, title string, raw_content string")


def sections(s: SparkSession, d: str) -> DataFrame:
    """A SECTION for each source, a CONTENT for each document; some of them wrong on purpose."""
    k = F.col("doc_id")
    line = F.substring_index("text", "\n", 1)
    none = F.expr("CAST(array() AS array<string>)")
    words = F.expr(r.first_query_tokens("text", 3))
    docs = s.read.parquet(f"{d}/documents.parquet")
    leaves = docs.withColumn("stripped", F.expr(r.SPARK.strip("text"))).select(
        F.col("source").alias("doc_id"), k.cast("string").alias("node_id"), F.col("source").alias("parent_id"), k.alias("ordinal"), F.when(k % 29 == 5, "TOPIC").when(k % 31 == 5, "ODD").otherwise("CONTENT").alias("type"),
        F.when(k % 3 == 0, F.concat(F.lit("6."), (k % 9).cast("string"), F.lit(" Part "), k.cast("string"))).otherwise(F.substring(line, 1, 90)).alias("title"), F.when(k % 23 == 4, "").otherwise(F.concat_ws(" > ", "source", "lang")).alias("path"),
        F.col("text").alias("raw_content"), F.when(k % 19 == 2, "").otherwise(F.substring("text", 1, F.floor(F.length("text") * F.when(k % 5 == 0, 0.95).otherwise(0.7)).cast("int"))).alias("compressed_content"), F.when(k % 37 == 1, "Zzzzz qqqqq.").otherwise(F.substring(line, 1, 60)).alias("micro_summary"),
        F.when(k % 41 == 0, none).otherwise(words).alias("aliases"), words.alias("keywords"), words.alias("synonyms"), (k % 50).cast("int").alias("page_start"), (k % 50 + k % 3 - 1).cast("int").alias("page_end"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"),
        F.when(k % 17 == 0, "x").otherwise(F.expr(r.content_hash(r.SPARK, "stripped"))).alias("content_hash"), (k % 2 == 0).alias("retrieval_ready"), (k % 43 == 0).alias("is_front_matter"), F.lit(120).alias("token_count_compressed"),
    )
    empty = lambda c: F.lit("").alias(c)
    heads = docs.select("source").distinct().select(
        F.col("source").alias("doc_id"), F.col("source").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(-1).cast("long").alias("ordinal"), F.lit("SECTION").alias("type"), F.concat(F.lit("SECTION "), "source").alias("title"), F.col("source").alias("path"),
        empty("raw_content"), empty("compressed_content"), empty("micro_summary"), none.alias("aliases"), none.alias("keywords"), none.alias("synonyms"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(0).cast("long").alias("char_start"), F.lit(0).cast("long").alias("char_end"),
        empty("content_hash"), F.lit(False).alias("retrieval_ready"), F.lit(False).alias("is_front_matter"), F.lit(0).alias("token_count_compressed"),
    )
    return leaves.unionByName(heads)


_W = f"({r.query_tokens(r.DUCK, 'text')})[1:3]"
_NODES = f"""nodes AS (SELECT source AS doc_id, CAST(doc_id AS VARCHAR) AS node_id, source AS parent_id, doc_id AS ordinal, CASE WHEN doc_id % 29 = 5 THEN 'TOPIC' WHEN doc_id % 31 = 5 THEN 'ODD' ELSE 'CONTENT' END AS type,
    CASE WHEN doc_id % 3 = 0 THEN '6.' || (doc_id % 9) || ' Part ' || doc_id ELSE substring(string_split(text, chr(10))[1], 1, 90) END AS title, CASE WHEN doc_id % 23 = 4 THEN '' ELSE source || ' > ' || lang END AS path, text AS raw_content,
    CASE WHEN doc_id % 19 = 2 THEN '' ELSE substring(text, 1, CAST(floor(length(text) * CASE WHEN doc_id % 5 = 0 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END) AS INT)) END AS compressed_content, CASE WHEN doc_id % 37 = 1 THEN 'Zzzzz qqqqq.' ELSE substring(string_split(text, chr(10))[1], 1, 60) END AS micro_summary,
    CASE WHEN doc_id % 41 = 0 THEN [] ELSE {_W} END AS aliases, {_W} AS keywords, {_W} AS synonyms, doc_id % 50 AS page_start, doc_id % 50 + doc_id % 3 - 1 AS page_end, 0 AS char_start, length(text) AS char_end,
    CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE {r.content_hash(r.DUCK, r.DUCK.strip('text'))} END AS content_hash, doc_id % 2 = 0 AS retrieval_ready, doc_id % 43 = 0 AS is_front_matter FROM documents
    UNION ALL SELECT DISTINCT source, source, NULL, -1, 'SECTION', 'SECTION ' || source, source, '', '', '', [], [], [], 1, 1, 0, 0, '', false, false FROM documents),
    n AS (SELECT * REPLACE ({r.DUCK.strip('title')} AS title), {', '.join(f'{v} AS {k}' for k, v in validate.prepared(r.DUCK).items())} FROM nodes)"""
_row_errors = lambda start=None: " UNION ALL ".join(f"SELECT doc_id, node_id, '{text}' AS error FROM n WHERE {c}" for c, text in validate._row_rules(r.DUCK, start))
#: The counts of all errors ground a summary in the first characters, as their SQL does.
GROUNDED = 4000


def _built(s: SparkSession, d: str) -> DataFrame:
    """The chunks of all documents and of the handbook as enriched nodes."""
    x = sp.everything(s, d)
    chunks = st.usable_chunks(st.semantic_chunks(x, st.ranges(st.without_clusters(st.headings(x)), x)))
    return enrich.enriched(chunks)


def _merged_results(s: SparkSession, d: str) -> DataFrame:
    """A stored result for every event, and a run's for some, with or without a structure."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("k"))
    n = F.col("k").cast("string")
    stored = F.when(F.col("k") % 5 > 0, F.concat(F.lit('{"status": "done", "page_count": '), n, F.lit(', "validation": {"error_count": 4}, "structure_vrag": [1]}')))
    jobs = e.select(F.col("k").alias("doc_id"), F.lit("running").alias("status"), stored.alias("results"))
    run = F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"status": "ready", "page_count": 7, "structure_vrag": ['), n, F.lit("]}")))
    runs = e.where("k % 2 = 0").select(F.col("k").alias("doc_id"), run.alias("result"), F.when(F.col("k") % 6 == 0, "[0]").alias("structure"))
    return build.merged_results(jobs, runs)


QUERIES = {
    "enrich_metadata": lambda s, d: _titled(s).select("i", F.array_join(enrich.aliases(F.col("title"), F.col("raw_content")), "|").alias("aliases"), F.array_join(enrich.keywords(F.col("title"), F.col("raw_content")), "|").alias("keywords"), F.array_join(enrich.synonyms(enrich.aliases(F.col("title"), F.col("raw_content")), F.col("title")), "|").alias("synonyms")),
    "enrich_summaries": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", enrich.micro_summary(F.lit("6.1 Part"), "text").alias("summary")).select("doc_id", "summary", enrich.capped_summary("summary").alias("capped")),
    "enrich_compressed": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", enrich.compressed(F.col("text")).alias("compressed")),
    "enrich_chunks": lambda s, d: _built(s, d).select("doc_id", "start", "title", "compressed_content", "micro_summary"),
    "index_build": lambda s, d: build.build_index(sp.everything(s, d)).select("doc_id", "node_id", "parent_id", "type", "title", "path", "page_start", "token_count_raw", "retrieval_ready"),
    "index_build_library": lambda s, d: build.build_index(sp.library(s, d)).select("doc_id", "node_id", "parent_id", "type", "title", "path", "page_start", "token_count_raw", "retrieval_ready"),
    "index_provider_trees": lambda s, d: build.with_pages(build.normalized_trees(files.trees(s.createDataFrame([(k, json.dumps(v)) for k, v in PROVIDER_TREES], "doc_id string, json string")))),
    "index_declared_types": lambda s, d: _titled(s).selectExpr("i", f"{build.declared_type(r.SPARK.strip('title'), 'i % 2 = 0')} AS declared", f"{build.container_type(r.SPARK.strip('title'))} AS container"),
    "index_slim_results": lambda s, d: build.slim_results(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("doc_id"), F.concat(F.lit('{"pipeline": "p", "page_count": '), F.col("event_id"), F.lit(', "validation": {"error_count": 2, "errors": ["a", "b"]}, "structure": '), "props", F.lit("}")).alias("results")), 9).select("doc_id", "page_count", "error_count", F.array_join("errors", ",").alias("errors"), "structure"),
    "index_merged_results": lambda s, d: _merged_results(s, d),
    "validate_node_errors": lambda s, d: validate.node_errors(sections(s, d)),
    "validate_gates": lambda s, d: validate.gates(validate.errors(sections(s, d)), sections(s, d)),
    "validate_all_errors": lambda s, d: validate.errors(sections(s, d), GROUNDED).groupBy("doc_id", "error").agg(F.count("*").alias("n")),
    "validate_readiness": lambda s, d: validate.readiness(sections(s, d), validate.errors(sections(s, d))),
    "validate_chunk_flags": lambda s, d: validate.chunk_flags(sections(s, d)),
}
_GATE_SQL = ", ".join(f"NOT coalesce(bool_or({' OR '.join(f'contains(lower(error), {chr(39)}{p.lower()}{chr(39)})' for p in (parts or ('no retrieval',)))}), false) AS {g}" for g, parts in validate.GATES.items())
_UNDER = "(VALUES " + ", ".join(f"('{p}', '{c}')" for p, cs in tree.UNDER.items() for c in cs) + ") v(pt, ct)"


def _linked(rows: str, more: str = "") -> str:
    """SQL: all errors as e, from those of single nodes."""
    return f"""lv AS (SELECT * FROM n WHERE type = 'CONTENT' AND raw <> '' AND NOT is_front_matter),
        bad AS (SELECT c.doc_id, c.node_id FROM n c JOIN n p ON c.doc_id = p.doc_id AND c.parent_id = p.node_id WHERE (p.type, c.type) NOT IN (SELECT (pt, ct) FROM {_UNDER})),
        k AS (SELECT doc_id, node_id, ordinal, trim(title) AS title, length(raw) AS chars, regexp_extract(title, '^\\s*(\\d+(?:\\.\\d+)*)', 1) AS sec, {r.token_set(r.DUCK, 'raw')} AS t, {r.content_hash(r.DUCK, 'raw')} AS h FROM lv),
        u AS (SELECT *, len(t) AS m FROM k WHERE chars >= 40 QUALIFY row_number() OVER (PARTITION BY doc_id, h ORDER BY ordinal) = 1),
        e AS ({rows}
            UNION ALL SELECT doc_id, node_id, 'Duplicate hash' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY ordinal) AS i FROM lv WHERE content_hash <> '') WHERE i > 1
            UNION ALL SELECT doc_id, node_id, 'Invalid hierarchy' FROM bad
            UNION ALL SELECT DISTINCT b.doc_id, b.node_id, 'Adjacent overlap' FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.sec = b.sec AND a.ordinal < b.ordinal AND a.title <> b.title AND a.h <> b.h WHERE a.sec <> '' AND len(list_intersect(a.t, b.t)) > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.15
            UNION ALL SELECT b.doc_id, b.node_id, 'Overlap duplicate' FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.ordinal < b.ordinal AND least(a.m, b.m) >= 0.85 * greatest(a.m, b.m) WHERE b.m > 0 AND len(list_intersect(a.t, b.t))::DOUBLE / (a.m + b.m - len(list_intersect(a.t, b.t))) >= 0.85{more})"""


_ALONE = """
            UNION ALL SELECT doc_id, node_id, 'Duplicate node_id' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, node_id ORDER BY ordinal) AS i FROM n WHERE node_id <> '') WHERE i > 1
            UNION ALL SELECT doc_id, NULL, 'No retrieval candidate nodes in index' FROM (SELECT DISTINCT doc_id FROM n) ANTI JOIN lv USING (doc_id)"""
_ALL = _linked(_row_errors(), _ALONE)
ORACLE_SQL = {
    "index_merged_results": """SELECT event_id AS doc_id, CASE WHEN event_id % 4 = 0 THEN 'ready' WHEN event_id % 5 > 0 THEN 'done' ELSE 'running' END AS status, CAST(CASE WHEN event_id % 4 = 0 THEN 7 WHEN event_id % 5 > 0 THEN event_id END AS INT) AS page_count,
        CASE WHEN event_id % 4 > 0 AND event_id % 5 > 0 THEN 4 END AS error_count, CASE WHEN event_id % 6 = 0 THEN '[0]' WHEN event_id % 4 = 0 THEN '[' || event_id || ']' WHEN event_id % 5 > 0 THEN '[1]' END AS structure FROM events""",
    "index_slim_results": """SELECT event_id AS doc_id, CAST(event_id AS INT) AS page_count, 2 AS error_count, 'a,b' AS errors, CASE WHEN length(replace(props, ' ', '')) <= 9 THEN replace(props, ' ', '') END AS structure FROM events""",
    "validate_node_errors": f"WITH {_NODES} {_row_errors()}",
    "validate_all_errors": f"""WITH {_NODES}, {_linked(_row_errors(GROUNDED))}
        SELECT doc_id, error, count(*) AS n FROM e GROUP BY ALL""",
    "validate_gates": f"WITH {_NODES}, {_ALL} SELECT doc_id, {_GATE_SQL}, count(error) AS n_errors FROM (SELECT DISTINCT doc_id FROM n) LEFT JOIN e USING (doc_id) GROUP BY doc_id",
    "validate_readiness": f"WITH {_NODES}, {_ALL}, g AS (SELECT doc_id, {_GATE_SQL} FROM (SELECT DISTINCT doc_id FROM n) LEFT JOIN e USING (doc_id) GROUP BY doc_id), o AS (SELECT doc_id, {' AND '.join(validate.GATES)} AS open FROM g), c AS (SELECT doc_id, {validate.passes(r.DUCK)} AS sound FROM n WHERE type = 'CONTENT' AND NOT is_front_matter) SELECT doc_id, count(sound) AS candidates, count(*) FILTER (sound AND open) AS ready, open AND count(sound) > 0 AND count(sound) = count(*) FILTER (sound AND open) AS retrieval_ready FROM o LEFT JOIN c USING (doc_id) GROUP BY doc_id, open",
    "validate_chunk_flags": f"WITH {_NODES}, b AS (SELECT c.doc_id, c.node_id FROM n c JOIN n p ON c.doc_id = p.doc_id AND c.parent_id = p.node_id WHERE (p.type, c.type) NOT IN (SELECT (pt, ct) FROM {_UNDER})), f AS (SELECT doc_id, node_id, type = 'CONTENT' AND length(compressed_content) > 50 AND content_hash <> '' AND page_start >= 1 AND (doc_id, node_id) NOT IN (SELECT (doc_id, node_id) FROM b) AS ok FROM n) SELECT doc_id, node_id, ok AS retrieval_ready, ok AS is_retrieval_chunk FROM f",
}
