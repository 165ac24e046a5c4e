"""The whole index: lines to a validated tree of sections, and saved provider trees to the same shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.functions import unicode
from quire.operators import enrich, similarity, tree, validate
from quire.operators import structure as st
from quire.sources.shared import materialized

D = r.SPARK
_NUMBERED = r"^\d+\.\d+"
_COLUMNS = ["doc_id", "key", "parent_key", "type", "title", "line", "rank", "raw_content", "start", "end"]


def _rows(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The working columns of nodes, by expression; those not given are null."""
    kinds = {"line": "long", "rank": "int", "start": "long", "end": "long"}
    return df.select("doc_id", *((F.expr(c) if isinstance(c, str) else c).cast(kinds.get(k, "string")).alias(k) for k in _COLUMNS[1:] for c in [columns.get(k, F.lit(None))]))


def placed_chunks(lines: DataFrame, heads: DataFrame, placed: DataFrame, max_chars: int, adjacent: float, near: float) -> DataFrame:
    """Accepted chunks with their heading's role and parent: not on a contents page, under a usable
    title, and no duplicate of an earlier chunk of the document."""
    spans = heads.join(placed.select("doc_id", "line_idx", "role", "parent_key"), ["doc_id", "line_idx"]).where("role IN ('content', 'front')")
    chunks = st.usable_chunks(st.semantic_chunks(lines, spans, max_chars, adjacent))
    pages = lines.join(st.contents_pages(lines), ["doc_id", "page"]).select("doc_id", F.col("global_idx").cast("long").alias("start"))
    chunks = materialized(chunks.join(pages, ["doc_id", "start"], "left_anti").withColumn("id", F.concat_ws("\x1f", "doc_id", F.format_string("%012d%04d", "line_idx", "chunk"))), "chunks")
    kept = similarity.greedy_dedup(chunks.select("id", "doc_id", F.col("raw_content").alias("text")), near, scope="doc_id").where("outcome = 'accepted'").select("id")
    return merged_siblings(chunks.join(kept, "id", "left_semi").drop("id").join(placed.select("doc_id", "line_idx", "role", "parent_key"), ["doc_id", "line_idx"]), adjacent)


_SIBLING = "doc_id string, line_idx long, chunk int, title string, raw_content string, start long, end long, role string, parent_key string"


def merged_siblings(chunks: DataFrame, adjacent: float = 0.15) -> DataFrame:
    """Leaves of one parent with the same section number, in order: a leaf joins the first earlier one
    whose words it shares, unless their titles differ and one is structural. Wrapped leaves have a
    parent of their own. One task holds the leaves of one number below one parent."""
    wrapped = (F.col("role") == "content") & F.col("title").rlike(_NUMBERED) & F.col("parent_key").rlike("^(unit|section):")
    n = chunks.withColumn("number", F.when(~wrapped, F.nullif(F.regexp_extract(F.trim("title"), r"^(\d+(?:\.\d+)*)", 1), F.lit(""))))
    n = n.withColumn("structural", F.expr(r.structural_line(D, "title")))
    columns = [c.split()[0] for c in _SIBLING.split(", ")]

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for x in group.sort_values(["line_idx", "chunk"]).to_dict("records"):
            same = lambda y, x=x: y["title"].strip().lower() == x["title"].strip().lower() or not (x["structural"] or y["structural"])
            host = next((y for y in out if same(y) and st.overlap(y["raw_content"], x["raw_content"]) >= adjacent), None)
            if host is None:
                out.append(x)
            else:
                host.update(raw_content=host["raw_content"] + "\n" + x["raw_content"], start=min(host["start"], x["start"]), end=max(host["end"], x["end"]))
        return pd.DataFrame(out, columns=columns)

    folded = n.where("number IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("doc_id", "parent_key", "number").applyInPandas(fold, _SIBLING)
    return n.where("number IS NULL").select(*columns).unionByName(folded)


def tree_of(placed: DataFrame, chunks: DataFrame, max_title: int = 85) -> DataFrame:
    """Containers, wrappers of numbered topics, and leaves, as adjacency rows in order of construction."""
    docs = placed.select("doc_id").distinct()
    top = _rows(docs, key="'root'", type="'ROOT'", title="'ROOT'", line="-3L", rank="0")
    top = top.unionAll(_rows(docs, key="'document'", parent_key="'root'", type="'DOCUMENT'", title="'Document'", line="-2L", rank="0"))
    top = top.unionAll(_rows(docs, key="'front'", parent_key="'document'", type="'FRONT_MATTER'", title="'Front Matter'", line="-1L", rank="0"))
    heads = placed.where("role IN ('chapter', 'section', 'unit', 'contents')")
    top = top.unionAll(_rows(heads, key="concat(role, ':', line_idx)", parent_key="parent_key", type="CASE role WHEN 'contents' THEN 'TABLE_OF_CONTENTS' ELSE upper(role) END", title="title", line="line_idx", rank="2"))
    # the sections and chapters that are made where none is open
    used = placed.where("parent_key LIKE 'section:MAIN/%' OR parent_key = 'chapter:MAIN'").groupBy("doc_id", "parent_key").agg(F.min("line_idx").alias("line"))
    mains = used.where("parent_key LIKE 'section:%'")
    top = top.unionAll(_rows(mains, key="parent_key", parent_key="substring(parent_key, 14)", type="'SECTION'", title="'SECTION MAIN'", line="line", rank="1"))
    bodies = mains.where("parent_key = 'section:MAIN/chapter:MAIN'").select("doc_id", "line").unionAll(used.where("parent_key = 'chapter:MAIN'").select("doc_id", "line")).groupBy("doc_id").agg(F.min("line").alias("line"))
    top = top.unionAll(_rows(bodies, key="'chapter:MAIN'", parent_key="'document'", type="'CHAPTER'", title="'Main Body'", line="line", rank="0"))
    number = F.col("title").rlike(_NUMBERED)
    c = chunks.withColumn("wrapped", (F.col("role") == "content") & number & F.col("parent_key").rlike("^(unit|section):"))
    wrapper = F.concat_ws(":", F.lit("wrap"), "line_idx", "chunk")
    cut = lambda kind: F.substring(F.expr(r.cut_title(D, r.tidy_title(D, "title"), f"'{kind}'")), 1, max_title)
    wraps = _rows(c.where("wrapped"), key=wrapper, parent_key="parent_key", type=r"CASE WHEN title RLIKE r'^\d+\.\d+\.\d+' THEN 'SUBTOPIC' ELSE 'TOPIC' END", title=cut("TOPIC"), line="start", rank="3")
    leaves = _rows(c, key=F.concat_ws(":", F.lit("content"), "line_idx", "chunk"), parent_key=F.when(F.col("wrapped"), wrapper).otherwise(F.col("parent_key")), type="'CONTENT'", title=cut("CONTENT"), line="start", rank="4", raw_content="raw_content", start="start", end="end")
    nodes = top.unionAll(wraps).unionAll(leaves)
    order = Window.partitionBy("doc_id").orderBy("line", "rank", "key")
    named = nodes.withColumn("ordinal", F.row_number().over(order)).withColumn("node_id", F.format_string("%s_%04d", F.when(F.col("rank") == 3, "wrap").when(F.col("type") == "CONTENT", "content").when(F.col("type") == "ROOT", "root").otherwise(F.lower(F.substring("type", 1, 3))), "ordinal"))
    up = named.select("doc_id", F.col("key").alias("parent_key"), F.col("node_id").alias("parent_id"))
    return named.join(up, ["doc_id", "parent_key"], "left").select("doc_id", "node_id", "parent_id", "ordinal", "type", "title", "raw_content", "start", "end", (F.col("parent_key") == "front").alias("is_front_matter"))


def without_contained(nodes: DataFrame) -> DataFrame:
    """nodes whose text is emptied where it stands in the text of a parent that has one (containers have none), or
    is nearly the same: the parent's own text, before any is emptied, decides."""
    ups = nodes.where(~F.col("type").isin(*tree.CONTAINERS) & (F.coalesce("raw_content", F.lit("")) != "")).select("doc_id", F.col("node_id").alias("parent_id"), F.trim("raw_content").alias("parent_text"))
    pairs = nodes.where("raw_content <> ''").select("doc_id", "node_id", "parent_id", F.trim("raw_content").alias("text")).join(ups, ["doc_id", "parent_id"])
    gone = similarity.contained(pairs).where("duplicates_parent").select("doc_id", "node_id", F.lit(True).alias("_gone"))
    out = nodes.join(gone, ["doc_id", "node_id"], "left").withColumn("raw_content", F.when(F.col("_gone"), "").otherwise(F.col("raw_content")))
    if "retrieval_ready" in nodes.columns:
        out = out.withColumn("retrieval_ready", F.when(F.col("_gone"), False).otherwise(F.col("retrieval_ready")))
    return out.select(*nodes.columns)


def finished(nodes: DataFrame, lines: DataFrame, settings=None) -> DataFrame:
    """Spans, metadata, summaries, paths, token roll-ups and hashes of a tree of nodes."""
    nodes = without_contained(nodes)
    target, least = (0.70, 0.60) if settings is None else (settings.compression_target_ratio, settings.compression_min_ratio)
    leaves = nodes.where("type = 'CONTENT'")
    spans = st.char_spans(lines.withColumn("doc_id", F.col("doc_id").cast("string")), leaves.select("doc_id", "node_id", "start", "end")).drop("start", "end")
    # the join's own shuffle, with a given number of partitions: compressing a leaf is large work against its bytes
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rich = enrich.enriched(leaves.repartition(tasks, "doc_id", "node_id").join(spans, ["doc_id", "node_id"], "left").drop("start", "end"), target, least)
    rich = rich.withColumn("micro_summary", F.when(F.coalesce("is_front_matter", F.lit(False)), "Front matter (non-retrieval).").otherwise(F.col("micro_summary")))
    rich = materialized(rich, "leaves")
    none = F.expr("CAST(array() AS array<string>)")
    count = tree.children(nodes).select("doc_id", "node_id", F.size("children").alias("n"))
    kept = nodes.where("type <> 'CONTENT'").join(count, ["doc_id", "node_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    summary = F.when(F.col("type") == "TABLE_OF_CONTENTS", "Table of contents (navigation only).").otherwise(F.concat("title", F.lit(": contains "), F.col("n").cast("string"), F.lit(" subsections.")))
    empty = {"raw_content": F.lit(""), "compressed_content": F.lit(""), "content_hash": F.lit(""), "aliases": none, "keywords": none, "synonyms": none, "micro_summary": summary}
    zero = {c: F.lit(0) for c in ("page_start", "page_end", "char_start", "char_end", "token_count_raw", "token_count_compressed")}
    plain = kept.withColumns({**empty, **zero}).withColumn("is_front_matter", F.col("type").isin(*tree.FRONT_TYPES))
    every = rich.unionByName(plain.select(*rich.columns))
    every = materialized(tree.paths(every).drop("depth"), "nodes")
    sums = tree.rollup(every, "token_count_raw", "token_count_compressed")
    hashes = tree.structural_hashes(every).withColumnRenamed("content_hash", "_hash")
    out = every.drop("token_count_raw", "token_count_compressed").join(sums, ["doc_id", "node_id"]).join(hashes, ["doc_id", "node_id"], "left")
    return out.withColumn("content_hash", F.coalesce("_hash", "content_hash")).drop("_hash").withColumn("is_front_matter", F.coalesce("is_front_matter", F.lit(False)))


def repaired(nodes: DataFrame, last_leaf: int = 82) -> DataFrame:
    """Nodes as adjacency rows with unique ids, misplaced ones under an ancestor that may hold them, and
    chapters in their groups."""
    n = materialized(tree.relinked(nodes), "relinked")
    n = tree.reparented(n).withColumn("parent_id", F.coalesce("new_parent", "parent_id")).drop("new_parent")
    return tree.grouped(materialized(n, "reparented"), last_leaf)


def with_pages(nodes: DataFrame) -> DataFrame:
    """A CONTENT node without a page takes that of the first index tag in its text; one without a tag
    becomes FRONT_MATTER."""
    tag = F.regexp_extract("raw_content", r"<\s*physical_index_(\d+)\s*>", 1).try_cast("int")
    bare = (F.col("type") == "CONTENT") & (F.coalesce("page_start", F.lit(0)) == 0)
    n = nodes.withColumn("_tag", F.when(bare, tag)).withColumn("_lost", bare & F.col("_tag").isNull())
    n = n.withColumn("page_end", F.when(F.col("_tag").isNotNull() & (F.coalesce("page_end", F.lit(0)) == 0), F.col("_tag")).otherwise(F.col("page_end")))
    n = n.withColumn("page_start", F.coalesce("_tag", "page_start")).withColumn("type", F.when(F.col("_lost"), "FRONT_MATTER").otherwise(F.col("type")))
    return n.drop("_tag", "_lost")


def build_index(lines: DataFrame, max_chars: int = 6000, adjacent: float = 0.15, near: float = 0.85, settings=None, nfkc: bool = False) -> DataFrame:
    """Lines to sections: headings, hierarchy, chunks, repair, metadata, validation. A document's leaves
    are retrieval_ready if all its gates are open. nfkc: lines are in compatibility form first."""
    lines = materialized(lines.withColumn("text", unicode.nfkc("text")) if nfkc else lines, "lines")
    heads = materialized(st.ranges(st.without_clusters(st.headings(lines)), lines), "headings")
    placed = materialized(st.placed(heads), "placed")
    chunks = placed_chunks(lines, heads, placed, max_chars, adjacent, near)
    nodes = materialized(finished(materialized(repaired(materialized(tree_of(placed, chunks), "tree")), "repaired"), lines, settings).withColumn("retrieval_ready", F.lit(False)), "index")
    found = materialized(validate.errors(nodes), "errors")
    ready = validate.readiness(nodes, found).select("doc_id", F.col("retrieval_ready").alias("open"))
    leaf = (F.col("type") == "CONTENT") & ~F.col("is_front_matter")
    return nodes.join(ready, "doc_id", "left").withColumn("retrieval_ready", F.coalesce("open", F.lit(False)) & leaf).drop("open")


# --- provider trees -----------------------------------------------------------------------------------

#: Title beginnings and words that decide a container's type.
BOOK = r"(?i)^(?:introduction|background|definitions?|provisions?|summary|conclusion|appendix|glossary|preface|acknowledg(?:e)?ments?|table\s+of\s+contents|contents|index|foreword|overview|penalty|liability|profession|business|sales|turnover|gross\s+receipts|specified\s+date|tax\s+audit)\b"
CHAPTER = r"(?i)^(?:chapter|unit|part)\s+([IVXLC\d]+)(?:\s*[:\-–]\s*(.+))?$"
FRONT_WORDS = ("preface", "syllabus", "contents", "table of", "objective", "reading", "acknowledg", "glossary", "foreword", "committee", "publication")


def container_type(t: str = "title") -> str:
    """SQL: type of a node with children, from its stripped title."""
    has = lambda *w: D.contains(f"lower({t})", w)
    book = r.case((has("contents", "table of"), "'TABLE_OF_CONTENTS'"), (has("preface", "foreword"), "'PREFACE'"), (has("syllabus"), "'SYLLABUS'"), (has("objective"), "'OBJECTIVES'"), (has("reading", "reference", "glossary"), "'REFERENCES'"), otherwise="'TOPIC'")
    return r.case((D.has(t, r"(?i)^appendix\b"), "'APPENDIX'"), (D.has(t, CHAPTER), "'CHAPTER'"), (D.has(t, BOOK), book), (D.has(t, r"^\d+\.\d+\.\d+"), "'SUBTOPIC'"), (D.has(t, _NUMBERED), "'TOPIC'"), (f"{D.has(t, r'(?i)^section\s+')} AND length({t}) < 60", "'SECTION'"), otherwise="'TOPIC'")


def declared_type(t: str = "title", body: str = "has_body") -> str:
    """SQL: type of a node of the older tree form, from its stripped title and whether it has a body."""
    front = f"({D.has(t, r.PREFACE)} OR {D.contains(f'lower({t})', ('syllabus', 'objective', 'course coordinator', 'suggested reading'))} OR lower({t}) IN ('structure', 'introduction', 'table of contents'))"
    return r.case((D.has(t, r.SECTION), "'SECTION'"), (D.has(t, r.UNIT), "'UNIT'"), (front, f"CASE WHEN contains(lower({t}), 'preface') THEN 'PREFACE' ELSE 'SYLLABUS' END"), (D.has(t, r"^\d+\.\d+\.\d+"), "'SUBTOPIC'"), (D.has(t, _NUMBERED), "'TOPIC'"), (body, "'CONTENT'"), otherwise="'TOPIC'")


def provider_title(t: str = "t", lines: str = "lines") -> str:
    """SQL: the declared, stripped title if it is structural, else the first heading in the first lines of the body, else
    what the declared title or the first line says of a chapter (as Chapter, its number, its name) or part of a book, else empty."""
    usable = f"{t} <> '' AND NOT {D.has(t, r'(?i)^section[_\s-]*\d+$')} AND NOT {r.legal_title(D, t)} AND NOT ({r.paragraph_title(D, t)} AND NOT {r.structural_line(D, t)}) AND NOT {r.synthetic_title(D, t)}"

    def named(c: str) -> str:
        chapter = f"concat('Chapter ', {D.group(c, CHAPTER, 1)}, ' ', {D.group(c, CHAPTER, 2)})"
        return f"CASE WHEN {D.has(c, CHAPTER)} THEN {r.tidy_title(D, chapter)} WHEN {D.has(c, BOOK)} AND length({c}) < 90 THEN {c} END"

    return f"CASE WHEN {usable} THEN {t} ELSE coalesce(get(filter(slice({lines}, 1, 6), x -> {r.structural_line(D, 'x')}), 0), {named(t)}, {named(f'get({lines}, 0)')}, '') END"


def normalized_trees(flat: DataFrame) -> DataFrame:
    """Rows of saved trees (files.trees) as typed nodes under ROOT, DOCUMENT and FRONT_MATTER, APPENDIX
    or chapters by key. A node with children is a container, another with a body of 20 characters a
    CONTENT; the rest are dropped. A container that may not stand under its parent is a TOPIC."""
    kids = flat.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    n = flat.join(kids, ["doc_id", "node_id"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    n = n.withColumn("lines", F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")).withColumn("raw_content", F.array_join("lines", "\n")).withColumn("t", F.expr(D.strip("coalesce(title, '')")))
    # written, so that the long rules below see columns and not the expressions behind them
    n = materialized(n, "trees").withColumn("found", F.expr(provider_title())).where(F.col("has_children") | (F.length("raw_content") >= 20))
    span = F.when(F.col("page_end") > F.col("page_start"), F.concat(F.lit("Topic (pp. "), "page_start", F.lit("-"), "page_end", F.lit(")"))).otherwise("Topic block")
    first = F.get(F.split("raw_content", "\n"), 0)
    title = F.when(F.col("found") != "", F.col("found")).when(F.col("has_children"), span).otherwise(F.coalesce(F.nullif("title", F.lit("")), F.nullif(first, F.lit("")), F.lit("Content")))
    n = n.withColumn("title", F.substring(title, 1, 85))
    n = materialized(n, "titles").withColumn("type", F.when(F.col("has_children"), F.expr(container_type("title"))).otherwise("CONTENT"))
    front = F.col("title").rlike(BOOK) & F.expr(D.contains("lower(title)", FRONT_WORDS)) | F.expr(r.contents_page(D, "title", "raw_content"))
    group = F.when(front, "front").when(F.col("title").rlike(r"(?i)^appendix\b"), F.concat(F.lit("appendix:"), "node_id")).otherwise(F.concat(F.lit("chapter:"), F.coalesce(F.nullif(F.upper(F.regexp_extract("title", CHAPTER, 1)), F.lit("")), F.lit("main"))))
    n = n.withColumn("parent_id", F.when(F.col("parent_id").isNull(), group).otherwise(F.col("parent_id")))
    tops = n.where(F.col("parent_id").rlike("^(front$|appendix:|chapter:)")).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.min("ordinal").alias("ordinal"), F.min_by("title", "ordinal").alias("t"))
    head = tops.select("doc_id", "node_id", F.lit("document").alias("parent_id"), (F.col("ordinal") * 2 - 1).alias("ordinal"), F.when(F.col("node_id") == "front", "FRONT_MATTER").when(F.col("node_id").startswith("app"), "APPENDIX").otherwise("CHAPTER").alias("type"), F.when(F.col("node_id") == "front", "Front Matter").when(F.col("node_id") == "chapter:main", "Document Body").otherwise(F.col("t")).alias("title"), F.lit("").alias("raw_content"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"))
    docs = flat.select("doc_id").distinct()
    fixed = lambda i, p, k, t, o: docs.select("doc_id", F.lit(i).alias("node_id"), F.lit(p).cast("string").alias("parent_id"), F.lit(o).cast("long").alias("ordinal"), F.lit(k).alias("type"), F.lit(t).alias("title"), F.lit("").alias("raw_content"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"))
    body = n.select("doc_id", "node_id", "parent_id", (F.col("ordinal") * 2).alias("ordinal"), "type", "title", F.when(F.col("has_children"), "").otherwise(F.col("raw_content")).alias("raw_content"), "page_start", "page_end")
    body = materialized(body, "typed")
    every = fixed("root", None, "ROOT", "ROOT", -9).unionByName(fixed("document", "root", "DOCUMENT", "Document", -8)).unionByName(head).unionByName(body)
    bad = tree.misplaced(every).where("type <> 'CONTENT'").select("doc_id", "node_id", F.lit(True).alias("bad"))
    return every.join(bad, ["doc_id", "node_id"], "left").withColumn("type", F.when(F.col("bad"), "TOPIC").otherwise(F.col("type"))).drop("bad")


def page_estimate(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id").agg(F.max(F.greatest("page_start", "page_end")).alias("pages"))


def exported(nodes: DataFrame, body: bool = True) -> DataFrame:
    """The public columns of nodes, nulls filled, children listed, nothing else; without body, no texts
    but titles and summaries."""
    kids = tree.children(nodes)
    text, numbers, lists = ("parent_id", "type", "title", "path", "raw_content", "compressed_content", "micro_summary", "content_hash"), ("page_start", "page_end", "char_start", "char_end", "token_count_raw", "token_count_compressed"), ("aliases", "keywords", "synonyms")
    level = F.element_at(F.create_map(*(F.lit(x) for kv in tree.LEVEL.items() for x in kv)), F.col("type"))
    none = F.expr("CAST(array() AS array<string>)")
    text = text if body else tuple(c for c in text if c not in ("raw_content", "compressed_content"))
    n = nodes.join(kids, ["doc_id", "node_id"], "left")
    return n.select("doc_id", "node_id", level.alias("level"), *(F.coalesce(c, F.lit("")).alias(c) for c in text), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), *(F.coalesce(c, none).alias(c) for c in lists), F.coalesce("children", none).alias("children"), F.coalesce("retrieval_ready", F.lit(False)).alias("retrieval_ready"), F.col("type").isin(*tree.FRONT_TYPES).alias("is_front_matter"))


def slim_results(jobs: DataFrame, most: int = 1_500_000) -> DataFrame:
    """jobs: doc_id, results (JSON). Metadata for lists; the structure only while it is short."""
    get = lambda p: F.get_json_object("results", p)
    structure = F.coalesce(get("$.structure_vrag"), get("$.structure"))
    errors = F.from_json(get("$.validation.errors"), "array<string>")
    return jobs.select("doc_id", get("$.pipeline").alias("pipeline"), get("$.status").alias("status"), get("$.page_count").try_cast("int").alias("page_count"), get("$.retrieval_ready").try_cast("boolean").alias("retrieval_ready"), get("$.validation.error_count").try_cast("int").alias("error_count"), F.slice(errors, 1, 15).alias("errors"), F.when(F.length(structure) <= most, structure).alias("structure"))


def merged_results(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """jobs: doc_id, status, results (JSON); runs: doc_id, result, structure (JSON, null: none). One row a
    job: the run's result before the stored one, the run's structure before the stored one."""
    j = jobs.join(runs.select("doc_id", "result", F.col("structure").alias("made")), "doc_id", "left")
    get = lambda p: F.get_json_object("results", p)
    own = lambda k: F.coalesce(F.get_json_object("result", f"$.{k}"), F.when(F.col("result").isNull(), get(f"$.{k}")))
    structure = F.coalesce("made", own("structure_vrag"), get("$.structure_vrag"))
    return j.select("doc_id", F.coalesce(own("status"), "status").alias("status"), own("page_count").try_cast("int").alias("page_count"), own("validation.error_count").try_cast("int").alias("error_count"), structure.alias("structure"))
