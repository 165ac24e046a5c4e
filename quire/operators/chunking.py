"""Vector ingestion: sliding-window chunks, notice and reply pages, question and answer pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.operators import store

#: Breaks by priority; the last one in the window counts, and it belongs to the chunk before.
BREAKS = ("\n\n", ". ", "? ", "! ", ".\n", "?\n", "!\n", "\n", " ")


def windows(text: str | None, size: int = 1000, overlap: int = 200) -> list[str]:
    """Overlapping windows that end at the best break, if that lies in the last two thirds."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text or "").strip())
    size = max(100, size)
    overlap = max(0, min(overlap, size - 1))
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            found = next(((at, b) for b in BREAKS if (at := text.rfind(b, start, end)) >= 0), None)
            if found and found[0] + len(found[1]) - start >= size // 3:
                end = found[0] + len(found[1])
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(0, end - overlap)
    return out


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 200, whole: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, chunk_index, chunk_text, content_hash, token_count; Arrow-batched,
    one map without a shuffle. whole: the cleaned text as one chunk."""
    if size < 100 or not 0 <= overlap < size:
        raise ValueError("size must be at least 100, overlap at least 0 and below size")

    @F.pandas_udf("array<string>")
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda t: windows(t, 2**62, 0) if whole else windows(t, size, overlap))

    parts = docs.select("doc_id", F.posexplode(cut(F.col("text"))).alias("chunk_index", "chunk_text"))
    return parts.withColumn("content_hash", F.sha2("chunk_text", 256)).withColumn("token_count", F.expr(r.tokens_ceil(r.SPARK, "chunk_text")))


def notice_pages(pages: DataFrame) -> DataFrame:
    """pages: doc_id, page, text. Adds part: 'notice' from a page with GST / NOTICE on, 'reply' from one
    with GST / REPLY on; a notice mark wins on its page, and pages before the first mark are left out."""
    up = F.upper("text")
    mark = F.when(up.contains("GST / NOTICE"), "notice").when(up.contains("GST / REPLY"), "reply")
    part = F.last(mark, True).over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.withColumn("part", part).where("part IS NOT NULL")


def notices(pages: DataFrame) -> DataFrame:
    """One row a document: notice_text, reply_text, page counts, metadata, issue; missing names a part
    that has no page (its text is null)."""
    p = notice_pages(pages)
    text = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == k, F.struct("page", "text")))), lambda x: x["text"]), "\n")
    n = lambda k: F.count_if(F.col("part") == k)
    by = p.groupBy("doc_id").agg(*(F.when(n(k) > 0, text(k)).alias(f"{k}_text") for k in ("notice", "reply")), *(n(k).alias(f"{k}_page_count") for k in ("notice", "reply")))
    all_ = pages.select("doc_id").distinct().join(by, "doc_id", "left").na.fill(0, ["notice_page_count", "reply_page_count"])
    fields = [F.expr(v).alias(k) for k, v in r.notice_fields(r.SPARK, "coalesce(notice_text, '')").items()]
    missing = F.concat_ws(",", F.when(F.col("notice_text").isNull(), "notice"), F.when(F.col("reply_text").isNull(), "reply"))
    return all_.select("*", *fields, F.expr(r.issue_category(r.SPARK, "notice_text")).alias("issue"), missing.alias("missing"))


FAQ = r"(?is)(?:Q|Question)\s*[:\-]\s*(.*?)\s*(?:A|Answer)\s*[:\-]\s*(.*?)(?=(?:Q|Question)\s*[:\-]|$)"
FAQ_ANCHORED = r"(?ism)^\s*(?:Q|Question)\s*[:\-]\s*(.*?)\s*^\s*(?:A|Answer)\s*[:\-]\s*(.*?)(?=^\s*(?:Q|Question)\s*[:\-]|\z)"


def faq_pairs(docs: DataFrame, anchored: bool = False) -> DataFrame:
    """docs: doc_id, text. doc_id, pair, question, answer; neither is empty. Unanchored, marks count
    inside words as well, as in the behaviour this matches."""
    pattern = FAQ_ANCHORED if anchored else FAQ
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("q"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("a"))
    rows = docs.select("doc_id", F.posexplode(both).alias("pair", "x"))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return rows.select("doc_id", "pair", strip(F.col("x")["q"]).alias("question"), strip(F.col("x")["a"]).alias("answer")).where("question <> '' AND answer <> ''")


def dialogue_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = conversations.withColumn("next", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return n.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("next").alias("answer"))


#: Modes and document kinds of an upload.
MODES, KINDS = ("pageindex", "vector", "hybrid"), ("book", "notice_reply", "faq")


def _plain(c: Column, default: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(default))))


def upload_error(file_name: Column, mode: Column, doc_type: Column, size: Column, overlap: Column, whole: Column) -> Column:
    """The first fault of an upload, null if there is none; chunk settings count for books only, and a
    null size or overlap is the default one."""
    size, overlap = F.coalesce(size, F.lit(1000)), F.coalesce(overlap, F.lit(200))
    book = _plain(doc_type, "book") == "book"
    return (
        F.when(~F.lower(F.coalesce(file_name, F.lit(""))).endswith(".pdf"), "Only PDF files are supported.")
        .when(~_plain(mode, "hybrid").isin(*MODES), f"mode must be one of: {', '.join(MODES)}")
        .when(~_plain(doc_type, "book").isin(*KINDS), f"doc_type must be one of: {', '.join(KINDS)}")
        .when(book & (size < 100), "chunk_size must be >= 100")
        .when(book & (overlap < 0), "chunk_overlap must be >= 0")
        .when(book & (overlap >= size) & ~F.coalesce(whole, F.lit(False)), "chunk_overlap must be < chunk_size")
    )


def routed(pages: DataFrame, kinds: DataFrame, table: DataFrame, size: int = 1000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """pages: doc_id, page, text; kinds: doc_id, doc_type (null: book), one row a document. New vector rows
    of all documents, and the failed ones: doc_id, error. Books are cut into windows; a notice with its
    reply, and each question with its answer, are pairs of which the first text is embedded. A notice
    without one of its parts fails, so does an unknown kind, and a document without pairs."""
    named = pages.join(kinds.select("doc_id", _plain(F.col("doc_type"), "book").alias("doc_type")), "doc_id")
    of = lambda kind: named.where(F.col("doc_type") == kind).drop("doc_type")
    joined = lambda p: p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    split = notices(of("notice_reply"))
    both = split.where("missing = ''").select("doc_id", F.lit(0).alias("pair"), F.col("notice_text").alias("notice"), F.col("reply_text").alias("reply"))
    asked = faq_pairs(joined(of("faq")))
    candidates = store.pair_rows(both, "notice_reply", ("notice", "reply")).unionByName(store.pair_rows(asked, "faq", ("question", "answer")))
    rows, _ = store.ingested_pairs(table, candidates)
    book = store.completed(store.embedded(store.vector_rows(chunks(joined(of("book")), size, overlap)), "chunk_text")).withColumn("role", F.lit(None).cast("string")).withColumn("pair_id", F.lit(None).cast("string"))
    out = ["id", "doc_id", "doc_type", "role", "pair_id", "chunk_index", "chunk_text", "content_hash", "status", "embedding"]
    failed = split.where("missing <> ''").select("doc_id", F.concat(F.lit("missing: "), "missing").alias("error"))
    failed = failed.unionByName(of("faq").select("doc_id").distinct().join(asked.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no pairs").alias("error")))
    failed = failed.unionByName(named.where(~F.col("doc_type").isin(*KINDS)).select("doc_id", F.concat(F.lit("Unknown doc_type: "), "doc_type").alias("error")).distinct())
    return rows.select(*out).unionByName(book.select(*out)), failed
