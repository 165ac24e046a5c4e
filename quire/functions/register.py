"""The text rules as SQL functions of a session: no Python runs where they are used."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.functions import rules as r

D = r.SPARK
#: name -> (arguments, result, body)
FUNCTIONS = {
    "normalize_for_hash": ("t STRING", "STRING", r.normalized(D, "t")),
    "content_hash": ("t STRING", "STRING", r.content_hash(D, "t")),
    "token_set": ("t STRING", "ARRAY<STRING>", r.token_set(D, "t")),
    "query_tokens": ("t STRING", "ARRAY<STRING>", r.query_tokens(D, "t")),
    "strip": ("t STRING", "STRING", D.strip("coalesce(t, '')")),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE CAST(size(array_intersect(a, b)) AS DOUBLE) / size(array_union(a, b)) END"),
    "is_legal_title": ("t STRING", "BOOLEAN", r.legal_title(D, "t")),
    "is_synthetic_title": ("t STRING", "BOOLEAN", r.synthetic_title(D, "t")),
    "is_paragraph_title": ("t STRING", "BOOLEAN", r.paragraph_title(D, "t")),
    "is_structural_line": ("t STRING", "BOOLEAN", r.structural_line(D, "t")),
    "is_valid_heading": ("t STRING", "BOOLEAN", r.valid_heading(D, "t")),
    "tidy_title": ("t STRING", "STRING", r.tidy_title(D, "t")),
    "cut_title": ("t STRING, kind STRING", "STRING", r.cut_title(D, "t", "kind")),
    "is_garbage_line": ("t STRING", "BOOLEAN", r.garbage_line(D, "t")),
    "has_artifact": ("t STRING", "BOOLEAN", r.artifact(D, "t")),
    "clean_line": ("t STRING", "STRING", r.clean_line(D, "t")),
    "is_contents_page": ("title STRING, raw STRING", "BOOLEAN", r.contents_page(D, "title", "raw")),
    "split_sentences": ("t STRING", "ARRAY<STRING>", r.sentences(D, "t")),
    "micro_sentences": ("t STRING", "ARRAY<STRING>", r.micro_sentences(D, "t")),
    "sentence_score": ("s STRING", "DOUBLE", r.sentence_score(D, "s")),
    "issue_category": ("t STRING", "STRING", r.issue_category(D, "t")),
    "path_segment": ("title STRING, kind STRING", "STRING", r.path_segment(D, "title", "kind")),
    "query_entities": ("t STRING", "ARRAY<STRING>", r.entities(D, "t")),
    "token_count": ("t STRING", "INT", r.token_count(D, "t")),
}


def register(spark: SparkSession) -> None:
    """Create every function as a temporary one of the session."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def register_tables(spark: SparkSession) -> None:
    """Create the table functions of the session, for SQL:

    sliding_chunks(text, size, overlap): chunk_index, chunk_text of one text (LATERAL).
    page_chunks(TABLE(pages) PARTITION BY (doc_id) ORDER BY (page), size, overlap): doc_id, chunk_index, chunk_text of the
    pages (doc_id, page, text) of a document, joined by blank lines in their order. Null texts have no chunk.
    """
    from quire.operators.chunking import windows  # here, as operators use the functions of this package

    class SlidingChunks:
        def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple[int, str]]:
            yield from enumerate(windows(text, size, overlap))

    class PageChunks:
        def __init__(self) -> None:
            self.doc_id, self.parts, self.bounds = None, [], (1000, 200)

        def eval(self, page, size: int, overlap: int) -> None:
            self.doc_id, self.bounds = page["doc_id"], (size, overlap)
            if (page["text"] or "").strip():
                self.parts.append(page["text"].strip())

        def terminate(self) -> Iterator[tuple]:
            for i, chunk in enumerate(windows("\n\n".join(self.parts), *self.bounds)):
                yield self.doc_id, i, chunk

    spark.udtf.register("sliding_chunks", udtf(SlidingChunks, returnType="chunk_index int, chunk_text string"))
    spark.udtf.register("page_chunks", udtf(PageChunks, returnType="doc_id string, chunk_index int, chunk_text string"))
