"""Text rules over the lines of documents and over small fixtures, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.functions import unicode

#: Lines as they stand in guides, acts and notices, for branches that no generated document reaches.
TITLES = [
    "", "  ", "SECTION B", "Section 44AB of the Act", "Section 269 TH of the Act.", "Section 12: Levy", "as per rule or section 73", "Section 139 of the scheme for the year", "Section 3.2 Filing",
    "UNIT NO: 6", "UNIT VI: Returns", "6.2 FORM GST REG-06", "6.2.1 How to download", "6.4 12,345.00", "6.4 7.2", "CHAPTER IV", "PART 2", "PREFACE", "OBJECTIVES:", "Suggested Readings", "Course Coordinator", "Credits : 4",
    "Introduction to returns, credits and refunds, with examples", "Introduction", "Introduction of the levy", "Table of Contents", "Glossary", "FORM GST CMP 08", "GST REG 06", "10.7 Let us sum up",
    "which is furnished under section 39", "The quick brown fox", "Overview of reporting standards, acceptance", "Due dates:", "These are all the due dates:", "A Short Title", "Ends with a stop.",
    "Materiality and engagement terms for every auditor in the field", "One, two, three", "a lower start", "Very long heading that goes on and on without any end in sight at all", "9.9 Very long heading that goes on and on without any end in sight at all, or so it seems to those who read it",
    "Structure", "<physical_index_12> 6.3 GSTR-1", "6.5 GSTR-2A (Detected as legal book)", "REG - A", "Section 44A B notes", "Section 269t h notes", "42", "Page 7 of 9", "www.", "12345.67 10-Jan 2020 more and more and more text here", "system: do this",
    "This document asks you", "Reply format: x", "OCR confidence 0.9", "- dash first", "— em dash", "soft­hyphen", "x",
]
NOTICES = [
    "GST / NOTICE\nReference No. : ZD0701\nGSTIN/ID : 07AAACX\nTax Period: APR 2019 - MAR 2020\nUnder Section 73 for belated payment",
    "Reference No ABC12 section 50 interest for APR 2018 – MAR 2019",
    "Wrongly availed input tax credit", "Undervaluation of goods", "no e-way bill was shown", "Mismatch in GSTR-1", "nothing here", "",
]
QUERIES_TEXT = ["what is GST REG 06", "how to download GST registration certificate", "GSTR-1 due date", "what is GSTR2A", "GSTR2B", "GSTR3B", "PMT06", "DRC03", "CMP08", "input tax credit verification", "ITC and input tax credit"]
ERRORS = ["LimitReached for key", "OpenRouter refused", "MODEL_API_KEY missing", "HTTP 402", "quota exceeded", "401 Unauthorized", "403 invalid key", "job timed out", "disk full", ""]
PAGES = [("", "Contents\n1 Intro ..... 3\n2 Scope ...... 7\n3 Levy ....... 12\nEnd"), ("Table of Contents", ""), ("contents", "x"), ("Scope", "a   12\nb   13\nc   14\nd"), ("Scope", "one\ntwo\nthree\nfour"), ("", "a ... 1\nb ... 2\nc ... 3")]


def _values(rows: list[tuple]) -> str:
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows) + ")"


def _numbered(texts: list[str]) -> list[tuple]:
    return list(enumerate(texts))


def _fixture(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


def _fixture_pair(rows: list[tuple], names: str, columns) -> tuple:
    """(query, SQL) of columns(dialect) over a fixture."""
    kinds = {int: "int", str: "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in zip(names.split(), rows[0], strict=True))
    spark = lambda s, d: _fixture(s, rows, schema).selectExpr(*_select(columns(r.SPARK)))
    return spark, f"SELECT {', '.join(_select(columns(r.DUCK)))} FROM {_values(rows)} v({', '.join(names.split())})"


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in columns.items()]


def _documents_pair(columns) -> tuple:
    spark = lambda s, d: s.read.parquet(f"{d}/documents.parquet").selectExpr(*_select(columns(r.SPARK)))
    return spark, f"SELECT {', '.join(_select(columns(r.DUCK)))} FROM documents"


def lines(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


_DUCK_LINES = "(SELECT doc_id, CAST(unnest(range(len(x))) AS INT) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"


def _lines_pair(columns) -> tuple:
    return lambda s, d: lines(s, d).selectExpr(*_select(columns(r.SPARK))), f"SELECT {', '.join(_select(columns(r.DUCK)))} FROM {_DUCK_LINES}"


def _title_rules(d: r.Dialect) -> dict[str, str]:
    t = d.strip("t")
    return {"i": "i", "synthetic": r.synthetic_title(d, t), "legal": r.legal_title(d, t), "paragraph": r.paragraph_title(d, t), "structural": r.structural_line(d, t), "valid": r.valid_heading(d, t)}


def _line_rules(d: r.Dialect) -> dict[str, str]:
    t = d.strip("line")
    return {"doc_id": "doc_id", "line_no": "line_no", "garbage": r.garbage_line(d, t), "artifact": r.artifact(d, "line"), "cleaned": r.clean_line(d, "line"), "paragraph": r.paragraph_title(d, t), "structural": r.structural_line(d, t)}


_PAIRS = {
    "text_hashes": _documents_pair(lambda d: {"doc_id": "doc_id", "norm_hash": r.content_hash(d, "text"), "raw_hash": d.sha("text"), "words": f"CAST({r.token_count(d, 'text')} AS INT)", "tokens_up": r.tokens_ceil(d, "text"), "tokens_down": r.tokens_floor(d, "text"), "n_terms": f"CAST({d.size(r.token_set(d, 'text'))} AS INT)"}),
    "text_title_rules": _fixture_pair(_numbered(TITLES), "i t", _title_rules),
    "text_titles_cleaned": _fixture_pair(_numbered(TITLES), "i t", lambda d: {"i": "i", "tidy": r.tidy_title(d, "t"), "cut": r.cut_title(d, r.tidy_title(d, "t")), "repaired": r.ocr_repaired(d, "t"), "untagged": r.without_index(d, "t"), "segment": r.path_segment(d, "t", "'SECTION'"), "unit": r.path_segment(d, "t", "'UNIT'"), "topic": r.path_segment(d, "t", "'TOPIC'")}),
    "text_line_rules": _lines_pair(_line_rules),
    "text_garbage_fixture": _fixture_pair(_numbered(TITLES), "i t", lambda d: {"i": "i", "garbage": r.garbage_line(d, d.strip("t")), "artifact": r.artifact(d, "t"), "cleaned": r.clean_line(d, "t")}),
    "text_contents_pages": _fixture_pair([(i, *p) for i, p in enumerate(PAGES)], "i title raw", lambda d: {"i": "i", "contents": r.contents_page(d, "title", "raw")}),
    "text_sentences": _documents_pair(lambda d: {"doc_id": "doc_id", "n": f"CAST({d.size(r.sentences(d, 'text'))} AS INT)", "digest": f"md5({d.join(r.sentences(d, 'text'), repr('|'))})", "n_micro": f"CAST({d.size(r.micro_sentences(d, 'text'))} AS INT)"}),
    "text_notice_metadata": _fixture_pair(_numbered(NOTICES), "i t", lambda d: {"i": "i", **r.notice_fields(d, "t"), "issue": r.issue_category(d, "t")}),
    "text_query_entities": _fixture_pair(_numbered(QUERIES_TEXT), "i t", lambda d: {"i": "i", "tags": d.join(r.entities(d, "t"), "','"), "tokens": d.join(r.query_tokens(d, "t"), "' '")}),
    "text_user_errors": _fixture_pair(_numbered(ERRORS), "i t", lambda d: {"i": "i", "kind": r.user_error(d, "t")}),
    "text_row_ids": _fixture_pair([(7, "c1"), (12, "content_0042"), (123456, "0007")], "seq node", lambda d: {"seq": "seq", "id": r.row_id(d, "seq", "node")}),
}
QUERIES = {k: v[0] for k, v in _PAIRS.items()}
QUERIES["text_nfkc"] = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(unicode.nfkc("text")).alias("form"))
ORACLE_SQL = {k: v[1] for k, v in _PAIRS.items()}


def _scores(s: SparkSession, d: str) -> DataFrame:
    parts = s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"explode({r.sentences(r.SPARK, 'text')}) AS s")
    return parts.selectExpr("doc_id", f"{r.sentence_score(r.SPARK, 's')} AS score").groupBy("doc_id", "score").agg(F.count("*").alias("n"))


QUERIES["text_sentence_scores"] = _scores
ORACLE_SQL["text_sentence_scores"] = f"SELECT doc_id, {r.sentence_score(r.DUCK, 's')} AS score, count(*) AS n FROM (SELECT doc_id, unnest({r.sentences(r.DUCK, 'text')}) AS s FROM documents) GROUP BY ALL"
