"""Structure queries over the lines of documents and a small handbook, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.operators import structure as st
from quire.plans.text import _values

#: A handbook with every kind of heading: page, font size, bold, text.
HANDBOOK = [
    (1, 18.0, True, "PREFACE"), (1, 10.0, False, "This book was made for readers of the trade, by the board of studies."), (1, 10.0, False, "OBJECTIVES:"), (1, 10.0, False, "To know the forms and the due dates of every return."), (1, 18.0, True, "PREFACE"),
    (2, 10.0, False, "CONTENTS"), (2, 10.0, False, "6.1 Scope ........ 3"), (2, 10.0, False, "6.2 FORM GST REG-06 ........ 4"), (2, 10.0, False, "6.3 Returns ........ 5"), (2, 10.0, False, "SECTION A ........ 6"),
    (3, 16.0, True, "SECTION B"), (3, 10.0, False, "UNIT NO: 6"), (3, 10.0, False, "6.1 Scope of the levy"), (3, 10.0, False, "The levy covers every supply of goods within the state and is due on the date of supply."), (3, 10.0, False, "A second line of text that follows the first one and is about the same supply of goods."),
    (3, 10.0, False, "A third line that ends in a hyphen-"), (3, 10.0, False, "ated word and goes on for a while so that the chunk is long enough."), (3, 10.0, False, "6.2 FORM GST REG-06"), (3, 10.0, False, "The certificate is issued on the portal after the application was approved by the officer."), (3, 10.0, False, "It can be downloaded from the portal in three steps, as long as the account is active."),
    (4, 10.0, False, "6.3 GSTR-1 and its due date"), (4, 10.0, False, "GSTR-1 is due on the eleventh of the month after the month of supply, for monthly filers."), (4, 10.0, False, "6.3.1 Late fees"), (4, 10.0, False, "A late fee of fifty a day is charged for each day of delay in filing the return."), (4, 10.0, False, "7.1 Outside the unit"), (4, 10.0, False, "This topic has another number than the unit and stays with the open unit of its section."),
    (5, 10.0, False, "CHAPTER II"), (5, 10.0, False, "8.1 Refunds"), (5, 10.0, False, "Refunds are made within sixty days of a complete application, with interest after that."), (5, 10.0, False, "GLOSSARY"), (5, 10.0, False, "Levy: a charge. Supply: a sale. Return: a form that a person files every month."), (5, 12.0, False, "Short bold heading"), (5, 10.0, False, "8.2 12,345.00"), (5, 10.0, False, "Section 44AB of the Act applies to all persons named in it without any exception at all."), (5, 10.0, False, "8.3 Let us sum up"), (5, 10.0, False, "That was all about refunds and the glossary of terms in this chapter of the book."),
]
_ROWS = [("h", p, i + 1, i, t, f, b) for i, (p, f, b, t) in enumerate(HANDBOOK)]
_SCHEMA = "doc_id string, page int, line_no int, global_idx int, text string, font_size double, is_bold boolean"


def handbook(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_ROWS, _SCHEMA)


def lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents: 40 a page, every ninth in larger type."""
    x = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("global_idx", "text"))
    page = F.floor(F.col("global_idx") / 40).cast("int") + 1
    return x.select("doc_id", page.alias("page"), (F.col("global_idx") % 40 + 1).alias("line_no"), "global_idx", "text", F.when(F.col("global_idx") % 9 == 4, 13.0).otherwise(10.0).alias("font_size"), F.lit(False).alias("is_bold"))


def everything(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).unionByName(handbook(s))


#: Documents of a book, and what stands before the k-th: chapter, sections, units, a subtopic, else a topic by number.
BOOK = 20
_HEADING = """CASE WHEN k = 0 AND b % 3 > 0 THEN 'CHAPTER ' || (b % 9 + 1) WHEN k IN (1, 11) AND b % 4 > 0 THEN 'SECTION ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST((b + k) % 26 + 1 AS INT), 1)
    WHEN k IN (2, 7, 13) THEN 'UNIT NO: ' || substr('345', CAST(k % 3 + 1 AS INT), 1) WHEN k = 5 THEN '4.5.1 Details of ' || k WHEN k = 17 AND b % 5 = 0 THEN 'GLOSSARY' ELSE (k % 5 + 1) || '.' || k || ' Matter ' || b END"""


def library(s: SparkSession, d: str) -> DataFrame:
    """Lines of books: BOOK documents each, a heading before every document, 40 lines a page."""
    x = s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "doc_id div 20 AS b", "doc_id % 20 AS k", "split(text, '\\n', -1) AS l").withColumn("head", F.expr(_HEADING))
    every = x.select("b", "doc_id", F.posexplode(F.concat(F.array("head"), "l")).alias("i", "text"))
    n = every.withColumn("global_idx", (F.row_number().over(Window.partitionBy("b").orderBy("doc_id", "i")) - 1).cast("int"))
    page = F.floor(F.col("global_idx") / 40).cast("int") + 1
    return n.select(F.concat(F.lit("book"), F.col("b").cast("string")).alias("doc_id"), page.alias("page"), (F.col("global_idx") % 40 + 1).alias("line_no"), "global_idx", "text", F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"))


_LINES = f"""h AS (SELECT doc_id, page, line_no, global_idx, text, font_size::DOUBLE AS font_size, is_bold FROM {_values(_ROWS)} v(doc_id, page, line_no, global_idx, text, font_size, is_bold)),
    x AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(range(len(l))) AS global_idx, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    lines AS (SELECT doc_id, CAST(global_idx // 40 + 1 AS INT) AS page, global_idx % 40 + 1 AS line_no, global_idx, text, CASE WHEN global_idx % 9 = 4 THEN 13.0 ELSE 10.0 END::DOUBLE AS font_size, false AS is_bold FROM x UNION ALL SELECT * FROM h)"""
_D = r.DUCK
_FOUND = f"""
    med AS (SELECT doc_id, list_sort(list(font_size))[count(*) // 2 + 1] AS median FROM lines WHERE font_size > 0 GROUP BY doc_id),
    pg AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS raw FROM lines GROUP BY ALL), toc AS (SELECT doc_id, page FROM pg WHERE {r.contents_page(_D, "''", 'raw')}),
    t0 AS (SELECT l.*, {_D.strip('text')} AS t, median FROM lines l JOIN med USING (doc_id)), t1 AS (SELECT *, {st.typographic_line(_D, 't', 'is_bold', 'font_size', 'median')} AS typo FROM t0),
    t2 AS (SELECT *, {st.heading_type(_D, 't', 'typo', 'false')} AS closed, {st.heading_type(_D, 't', 'typo', 'true')} AS opened FROM t1),
    t3 AS (SELECT *, min(global_idx) FILTER (closed IN ('CHAPTER', 'SECTION')) OVER (PARTITION BY doc_id) AS first FROM t2), t4 AS (SELECT *, CASE WHEN global_idx > first THEN opened ELSE closed END AS type FROM t3),
    heads AS (SELECT doc_id, global_idx AS line_idx, type, page, t FROM t4 WHERE type IS NOT NULL AND NOT (type IN ('TOPIC', 'SUBTOPIC', 'PREFACE', 'OBJECTIVES', 'REFERENCES', 'SYLLABUS', 'COURSE_INFO') AND (doc_id, page) IN (SELECT (doc_id, page) FROM toc))),
    tops AS (SELECT *, line_idx - lag(line_idx) OVER w AS b, lead(line_idx) OVER w - line_idx AS f FROM heads WHERE type IN ('TOPIC', 'SUBTOPIC') WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_idx)),
    kept AS (SELECT doc_id, line_idx, type, page, t FROM tops WHERE coalesce(b, 9) >= 5 AND coalesce(f, 9) >= 5 UNION ALL SELECT doc_id, line_idx, type, page, t FROM heads WHERE type NOT IN ('TOPIC', 'SUBTOPIC'))"""
_HEADS = f"{_LINES},{_FOUND}"
_LIBRARY = f"""x AS (SELECT doc_id // 20 AS b, doc_id, doc_id % 20 AS k, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT b, doc_id, unnest(range(len(l) + 1)) AS i, unnest(list_prepend({_HEADING}, l)) AS text FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id, i) - 1 AS global_idx FROM y),
    lines AS (SELECT 'book' || b AS doc_id, CAST(global_idx // 40 + 1 AS INT) AS page, global_idx % 40 + 1 AS line_no, global_idx, text, 10.0::DOUBLE AS font_size, false AS is_bold FROM z)"""
_LIST = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_ROMAN = "CASE unit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in st._ROMAN.items()) + " ELSE TRY_CAST(unit AS INT) END"
_KEPT = f"ev AS (SELECT doc_id, line_idx, type, {r.cut_title(_D, r.tidy_title(_D, 't'))} AS title, CASE WHEN type IN ('TOPIC', 'SUBTOPIC') THEN TRY_CAST(regexp_extract(t, '^(\\d+)\\.\\d+(?:\\.\\d+)?\\s', 1) AS INT) END AS topic, CASE WHEN type = 'UNIT' THEN upper({_D.group('t', r.UNIT, 1)}) END AS unit FROM kept)"
#: The open chapter, section and unit at each heading, by windows; then the unit of a topic's number.
_PLACED = f"""{_KEPT}, h1 AS (SELECT *, coalesce(max(CASE WHEN type IN {_LIST(st.BODY)} THEN 1 ELSE 0 END) OVER upto, 0) = 1 AS body, last_value(CASE WHEN type = 'CHAPTER' THEN line_idx END IGNORE NULLS) OVER upto AS c,
        last_value(CASE type WHEN 'SECTION' THEN line_idx WHEN 'CHAPTER' THEN -1 END IGNORE NULLS) OVER upto AS s, last_value(CASE WHEN type = 'UNIT' THEN line_idx WHEN type IN ('SECTION', 'CHAPTER') THEN -1 END IGNORE NULLS) OVER before AS u FROM ev
        WINDOW upto AS (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), before AS (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h2 AS (SELECT *, body AND type NOT IN ('CHAPTER', 'SECTION', 'TABLE_OF_CONTENTS') AS plain FROM h1),
    h3 AS (SELECT *, max(CASE WHEN plain AND c IS NULL AND coalesce(s < 0, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS main FROM h2),
    h4 AS (SELECT *, CASE WHEN c IS NOT NULL THEN 'chapter:' || c WHEN main THEN 'chapter:MAIN' ELSE 'document' END AS ck FROM h3), h5 AS (SELECT *, CASE WHEN s >= 0 THEN 'section:' || s ELSE 'section:MAIN/' || ck END AS sk FROM h4),
    un AS (SELECT doc_id, sk, line_idx AS ul, {_ROMAN} AS number FROM h5 WHERE type = 'UNIT'), hit AS (SELECT h5.doc_id, h5.line_idx, min(ul) AS own FROM h5 JOIN un ON un.doc_id = h5.doc_id AND un.sk = h5.sk AND un.number = h5.topic AND ul < h5.line_idx WHERE plain AND type <> 'UNIT' GROUP BY ALL),
    h6 AS (SELECT h5.*, own, row_number() OVER (PARTITION BY h5.doc_id, body, type = 'TABLE_OF_CONTENTS', CASE WHEN type IN {_LIST(st.FRONT)} THEN type ELSE 'PREFACE' END ORDER BY h5.line_idx) AS first FROM h5 LEFT JOIN hit ON hit.doc_id = h5.doc_id AND hit.line_idx = h5.line_idx),
    h7 AS (SELECT *, CASE WHEN type = 'CHAPTER' THEN 'chapter' WHEN type = 'SECTION' THEN 'section' WHEN type = 'TABLE_OF_CONTENTS' THEN 'contents' WHEN NOT body AND first > 1 THEN 'skipped' WHEN NOT body THEN 'front' WHEN type = 'UNIT' THEN 'unit' ELSE 'content' END AS role, coalesce(own, CASE WHEN u >= 0 THEN u END) AS ou FROM h6),
    pl AS (SELECT doc_id, line_idx, type, title, role, CASE WHEN role = 'chapter' THEN 'document' WHEN role = 'section' THEN ck WHEN role IN ('contents', 'front', 'skipped') THEN 'front' WHEN role = 'content' AND ou IS NOT NULL THEN 'unit:' || ou ELSE sk END AS parent_key FROM h7)"""


def _ranges(s: SparkSession, d: str) -> DataFrame:
    x = everything(s, d)
    return st.ranges(st.without_clusters(st.headings(x)), x)


def _shelved(s: SparkSession, d: str) -> DataFrame:
    x = library(s, d)
    return st.ranges(st.without_clusters(st.headings(x)), x)


QUERIES = {
    "structure_library_headings": lambda s, d: st.headings(library(s, d)).select("doc_id", "line_idx", "type", "title", "page"),
    "structure_library_without_clusters": lambda s, d: st.without_clusters(st.headings(library(s, d))).select("doc_id", "line_idx", "type"),
    "structure_library_ranges": lambda s, d: _shelved(s, d).select("doc_id", "line_idx", "type", "start", "end"),
    "structure_library_placed": lambda s, d: st.placed(_shelved(s, d)),
    "structure_library_chunks": lambda s, d: st.semantic_chunks(library(s, d), _shelved(s, d)).select("doc_id", "line_idx", "chunk", "title", "start", "end"),
    "structure_offsets": lambda s, d: st.with_offsets(lines(s, d)).select("doc_id", "global_idx", "char_start", "char_end"),
    "structure_font_medians": lambda s, d: st.font_medians(everything(s, d)),
    "structure_contents_pages": lambda s, d: st.contents_pages(everything(s, d)),
    "structure_headings": lambda s, d: st.headings(everything(s, d)).select("doc_id", "line_idx", "type", "title", "page"),
    "structure_without_clusters": lambda s, d: st.without_clusters(st.headings(everything(s, d))).select("doc_id", "line_idx", "type"),
    "structure_ranges": lambda s, d: _ranges(s, d).select("doc_id", "line_idx", "type", "start", "end"),
    "structure_placed": lambda s, d: st.placed(_ranges(s, d)),
    "structure_char_spans": lambda s, d: st.char_spans(everything(s, d), _ranges(s, d).select("doc_id", "start", "end")).select("doc_id", "start", "char_start", "char_end", "page_start", "page_end"),
    "structure_semantic_chunks": lambda s, d: st.semantic_chunks(everything(s, d), _ranges(s, d)),
    "structure_usable_chunks": lambda s, d: st.usable_chunks(st.semantic_chunks(everything(s, d), _ranges(s, d))),
}
_RANGED = ", sz AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), rg AS (SELECT doc_id, line_idx, type, line_idx AS start, coalesce(lead(line_idx) OVER (PARTITION BY doc_id ORDER BY line_idx), n) AS \"end\" FROM kept JOIN sz USING (doc_id) UNION ALL SELECT doc_id, 0, 'PREFACE', 0, n FROM sz ANTI JOIN kept USING (doc_id))"
_RANGES = _HEADS + _RANGED
_SHELVED = f"{_LIBRARY},{_FOUND}"
ORACLE_SQL = {
    "structure_library_headings": f"WITH {_SHELVED} SELECT doc_id, line_idx, type, {r.cut_title(_D, r.tidy_title(_D, 't'))} AS title, page FROM heads",
    "structure_library_without_clusters": f"WITH {_SHELVED} SELECT doc_id, line_idx, type FROM kept",
    "structure_library_ranges": f"WITH {_SHELVED}{_RANGED} SELECT * FROM rg",
    "structure_library_placed": f"WITH {_SHELVED}, {_PLACED} SELECT * FROM pl",
    "structure_offsets": f"WITH {_LINES} SELECT doc_id, global_idx, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS char_start, CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS BIGINT) AS char_end FROM lines WHERE doc_id <> 'h' WINDOW w AS (PARTITION BY doc_id ORDER BY global_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    "structure_font_medians": f"WITH {_HEADS} SELECT * FROM med",
    "structure_contents_pages": f"WITH {_HEADS} SELECT * FROM toc",
    "structure_headings": f"WITH {_HEADS} SELECT doc_id, line_idx, type, {r.cut_title(_D, r.tidy_title(_D, 't'))} AS title, page FROM heads",
    "structure_without_clusters": f"WITH {_HEADS} SELECT doc_id, line_idx, type FROM kept",
    "structure_ranges": f"WITH {_RANGES} SELECT * FROM rg",
    "structure_char_spans": f"WITH {_RANGES}, o AS (SELECT doc_id, global_idx, page, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY global_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(text) AS n FROM lines) SELECT doc_id, start, CAST(min(a) AS BIGINT) AS char_start, CAST(max(a + n) AS BIGINT) AS char_end, min(page) AS page_start, max(page) AS page_end FROM rg JOIN o USING (doc_id) WHERE global_idx >= start AND global_idx < \"end\" GROUP BY ALL",
}
