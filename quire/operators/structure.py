"""Structure of line tables: offsets, headings, ranges, hierarchy, semantic chunks, nodes.

A line has doc_id, page, line_no, global_idx (0 up in each document), text, font_size, is_bold.
Headings and hierarchy are windows over lines; only the splitting and merging of chunks, which
depends on texts merged before, runs as a fold over the ranges of one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules as r

BODY = ("CHAPTER", "APPENDIX", "SECTION", "UNIT")
SUPPRESSED = ("TOPIC", "SUBTOPIC", "PREFACE", "OBJECTIVES", "REFERENCES", "SYLLABUS", "COURSE_INFO")
FRONT = ("TABLE_OF_CONTENTS", "PREFACE", "COURSE_INFO", "OBJECTIVES", "SYLLABUS", "REFERENCES")


# --- lines -----------------------------------------------------------------------------------------


def with_offsets(lines: DataFrame) -> DataFrame:
    """Adds char_start and char_end in the text joined by line feeds."""
    before = Window.partitionBy("doc_id").orderBy("global_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return lines.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def char_spans(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """ranges: doc_id, start, end (exclusive) in lines. Adds char_start, char_end, page_start, page_end."""
    o = with_offsets(lines).select("doc_id", "global_idx", "page", "char_start", "char_end")
    inside = ranges.join(o, "doc_id").where((F.col("global_idx") >= F.col("start")) & (F.col("global_idx") < F.col("end")))
    return inside.groupBy(*ranges.columns).agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))


def font_medians(lines: DataFrame) -> DataFrame:
    """doc_id, median: the upper median of the sizes above 0, 10 without any. Equal sizes are counted
    before they are ordered, so a document's lines are never collected."""
    sizes = lines.where("font_size > 0").groupBy("doc_id", "font_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id")
    upto = F.sum("n").over(w.orderBy("font_size"))
    middle = sizes.withColumn("upto", upto).withColumn("at", F.expr("(SUM(n) OVER (PARTITION BY doc_id)) div 2 + 1")).where("upto >= at").groupBy("doc_id").agg(F.min("font_size").alias("median"))
    return lines.select("doc_id").distinct().join(middle, "doc_id", "left").na.fill(10.0, ["median"])


def contents_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page of the pages that list contents."""
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("raw"))
    return pages.where(r.contents_page(r.SPARK, "''", "raw")).select("doc_id", "page")


# --- headings -----------------------------------------------------------------------------------------


def heading_type(d: r.Dialect, t: str, typographic: str, body: str, structural: str | None = None) -> str:
    """SQL: the type of a stripped line, null for none. structural: a column that has the rule of that name."""
    low, structural = f"lower({t})", structural or r.structural_line(d, t)
    has = lambda *w: d.contains(low, w)
    book = r.case((has("contents", "table of"), "'TABLE_OF_CONTENTS'"), (has("preface", "foreword", "acknowledg"), "'PREFACE'"), (has("glossary", "index"), "'REFERENCES'"), otherwise="'TOPIC'")
    front = f"(NOT {body} AND {d.contains(low, r.FRONT_WORDS)} AND length({t}) < 100)"
    return r.case(
        (f"{t} = '' OR length({t}) > 120 OR NOT ({structural} OR {typographic} OR {front})", "NULL"),
        (f"{typographic} AND NOT {structural}", f"CASE WHEN {body} THEN 'TOPIC' ELSE 'PREFACE' END"),
        (d.has(t, r.SUBTOPIC), "'SUBTOPIC'"),
        (f"{d.has(t, r.TOPIC)} AND NOT {r.bad_topic(d, t)}", "'TOPIC'"),
        (d.has(t, r.SECTION), "'SECTION'"),
        (d.has(t, r.UNIT), f"CASE WHEN {body} THEN 'UNIT' END"),
        (d.has(t, r.CHAPTER), "'CHAPTER'"),
        (d.has(t, r.STRUCTURE), "NULL"),
        (d.has(t, r.PREFACE), "'PREFACE'"),
        (d.has(t, r.OBJECTIVES), "'OBJECTIVES'"),
        (d.has(t, r.REFERENCES), "'REFERENCES'"),
        (f"{d.has(t, r.COURSE)} AND length({t}) < 90", "'COURSE_INFO'"),
        (d.has(t, r.SYLLABUS), "'SYLLABUS'"),
        (d.has(t, r.BOOK_SECTION), book),
        (f"{body} AND {d.any(t, (r.TAX_FORM, r.TAX_TOPIC, r.LET_SUM))}", "'TOPIC'"),
        (f"NOT {body} AND {has('preface')}", "'PREFACE'"),
        (f"NOT {body} AND {has('objective')}", "'OBJECTIVES'"),
        (f"NOT {body} AND {has('reading')}", "'REFERENCES'"),
        (f"NOT {body} AND {has('syllabus', 'max. marks', 'credits')}", "'SYLLABUS'"),
        otherwise="NULL",
    )


def typographic_line(d: r.Dialect, t: str, bold: str, size: str, median: str) -> str:
    return f"(({bold} OR {size} > {median} + 0.5) AND {r.token_count(d, t)} < 12 AND NOT {r.paragraph_title(d, t)} AND NOT {r.legal_title(d, t)})"


def headings(lines: DataFrame) -> DataFrame:
    """doc_id, line_idx, type, title, page, topic, section, unit, chapter (numbers or letters, else
    empty), in two passes: what opens the body is found first, then later lines are read as body."""
    d = r.SPARK
    n = lines.join(font_medians(lines), "doc_id").join(contents_pages(lines).withColumn("on_contents", F.lit(True)), ["doc_id", "page"], "left")
    n = n.withColumn("t", F.expr(d.strip("text"))).withColumn("typo", F.expr(typographic_line(d, "t", "is_bold", "font_size", "median")))
    n = n.withColumn("structural", F.expr(r.structural_line(d, "t")))
    n = n.withColumn("closed", F.expr(heading_type(d, "t", "typo", "false", "structural"))).withColumn("open", F.expr(heading_type(d, "t", "typo", "true", "structural")))
    opened = F.min(F.when(F.col("closed").isin("CHAPTER", "SECTION"), F.col("global_idx"))).over(Window.partitionBy("doc_id"))
    n = n.withColumn("type", F.when(F.col("global_idx") > opened, F.col("open")).otherwise(F.col("closed")))
    found = n.where(F.col("type").isNotNull() & ~(F.coalesce("on_contents", F.lit(False)) & F.col("type").isin(*SUPPRESSED)))
    found = found.withColumn("tidy", F.expr(r.tidy_title(d, "t")))  # a column: the next rule names it in many places
    title = F.expr(r.cut_title(d, "tidy"))
    group = lambda kind, pattern, k=1: F.when(F.col("type") == kind, F.upper(F.regexp_extract("t", pattern, k))).otherwise("")
    topic = F.when(F.col("type").isin("TOPIC", "SUBTOPIC"), F.regexp_extract("t", r"^(\d+\.\d+(?:\.\d+)?)\s", 1)).otherwise("")
    return found.select("doc_id", F.col("global_idx").alias("line_idx"), "type", title.alias("title"), "page", topic.alias("topic"), group("SECTION", r.SECTION).alias("section"), group("UNIT", r.UNIT).alias("unit"), group("CHAPTER", r.CHAPTER).alias("chapter"))


def without_clusters(found: DataFrame, gap: int = 5) -> DataFrame:
    """Drops topics with another topic of their page less than gap lines away: an outline, not headings."""
    topic = F.col("type").isin("TOPIC", "SUBTOPIC")
    w = Window.partitionBy("doc_id", "page", "_topic").orderBy("line_idx")  # in one pass: headings cost many patterns a line
    back, on = F.col("line_idx") - F.lag("line_idx").over(w), F.lead("line_idx").over(w) - F.col("line_idx")
    near = F.col("_topic") & (F.coalesce(back < gap, F.lit(False)) | F.coalesce(on < gap, F.lit(False)))
    return found.withColumn("_topic", topic).withColumn("_near", near).where("NOT _near").drop("_topic", "_near")


def ranges(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds start and end (exclusive) in lines; a document without headings gets one PREFACE 'Document'."""
    sizes = lines.groupBy("doc_id").agg(F.count("*").cast("int").alias("n_lines"))
    default = {"line_idx": 0, "type": "PREFACE", "title": "Document", "page": 1, "topic": "", "section": "", "unit": "", "chapter": ""}
    every = sizes.where("doc_id IS NOT NULL").join(found.withColumn("_found", F.lit(True)), "doc_id", "left")
    every = every.select("doc_id", "n_lines", *(F.when(F.col("_found"), F.col(c)).otherwise(F.lit(v).cast(found.schema[c].dataType)).alias(c) for c, v in default.items()))
    end = F.lead("line_idx").over(Window.partitionBy("doc_id").orderBy("line_idx"))
    return every.withColumn("start", F.col("line_idx")).withColumn("end", F.coalesce(end, F.col("n_lines"))).drop("n_lines")


# --- hierarchy ----------------------------------------------------------------------------------------

_ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9, "X": 10}


def placed(heads: DataFrame) -> DataFrame:
    """Where each heading stands: role (chapter, section, unit, contents, front, content, skipped) and
    parent, a key: 'document', 'front', 'chapter:<line>', 'section:<line>', 'unit:<line>', or the MAIN
    chapter and section that are made where none is open. The state is carried by windows: a chapter
    closes the section, both close the unit. A topic goes to the unit of its section that has its
    number, else the open unit, else the section."""
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kind, at = F.col("type"), F.col("line_idx")
    mark = lambda *cases: F.coalesce(*(F.when(c, v) for c, v in cases))
    no = F.lit(-1).cast("long")
    line = at.cast("long")
    h = heads.withColumn("body", F.coalesce(F.max(kind.isin(*BODY).cast("int")).over(upto), F.lit(0)) == 1)
    plain = F.col("body") & ~kind.isin("CHAPTER", "SECTION", "TABLE_OF_CONTENTS")
    h = h.withColumn("c", F.last(F.when(kind == "CHAPTER", line), True).over(upto)).withColumn("s", F.last(mark((kind == "SECTION", line), (kind == "CHAPTER", no)), True).over(upto)).withColumn("u", F.last(mark((kind == "UNIT", line), (kind.isin("SECTION", "CHAPTER"), no)), True).over(before))
    # the MAIN chapter is made where a plain heading finds neither chapter nor section open
    main = F.max((plain & F.col("c").isNull() & F.coalesce(F.col("s") < 0, F.lit(True))).cast("int")).over(upto) == 1
    h = h.withColumn("main", F.coalesce(main, F.lit(False)))
    chapter = F.when(F.col("c").isNotNull(), F.concat(F.lit("chapter:"), F.col("c"))).when(F.col("main"), "chapter:MAIN").otherwise("document")
    section = F.when(F.col("s") >= 0, F.concat(F.lit("section:"), F.col("s"))).otherwise(F.concat(F.lit("section:MAIN/"), chapter))
    h = h.withColumn("chapter_key", chapter).withColumn("section_key", section)
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in _ROMAN.items() for x in kv)), F.col("unit")), F.col("unit").try_cast("int"))
    units = h.where(kind == "UNIT").select("doc_id", "section_key", line.alias("unit_line"), number.alias("number"))
    topic = F.regexp_extract("topic", r"^(\d+)", 1).try_cast("int")
    hits = h.where(plain & (kind != "UNIT")).select("doc_id", "line_idx", "section_key", topic.alias("number")).join(units, ["doc_id", "section_key", "number"]).where("unit_line < line_idx").groupBy("doc_id", "line_idx").agg(F.min("unit_line").alias("own_unit"))
    h = h.join(hits, ["doc_id", "line_idx"], "left")
    front = F.when(kind.isin(*FRONT), kind).otherwise("PREFACE")
    first = F.row_number().over(Window.partitionBy("doc_id", F.col("body"), kind == "TABLE_OF_CONTENTS", front).orderBy("line_idx"))
    unit = F.coalesce(F.col("own_unit"), F.when(F.col("u") >= 0, F.col("u")))
    role = F.when(kind == "CHAPTER", "chapter").when(kind == "SECTION", "section").when(kind == "TABLE_OF_CONTENTS", "contents").when(~F.col("body") & (first > 1), "skipped").when(~F.col("body"), "front").when(kind == "UNIT", "unit").otherwise("content")
    h = h.withColumn("role", role)
    parent = F.when(F.col("role") == "chapter", "document").when(F.col("role") == "section", F.col("chapter_key")).when(F.col("role").isin("contents", "front", "skipped"), "front").when((F.col("role") == "content") & unit.isNotNull(), F.concat(F.lit("unit:"), unit)).otherwise(F.col("section_key"))
    return h.select("doc_id", "line_idx", "type", "title", "role", parent.alias("parent_key"))


# --- chunks -------------------------------------------------------------------------------------------


def prepared_lines(lines: DataFrame) -> DataFrame:
    """Flags and cleaned text of each line, for chunking."""
    d, t = r.SPARK, "t"
    numbered = f"({d.has(t, r'^\d+\.\d+(?:\.\d+)?\s+\S')} AND length(t) < 100)"
    form = f"({d.has(t, r.FORM_LINE)} AND length(t) < 90)"
    boundary = f"(t <> '' AND ({numbered} OR {form} OR {d.any(t, r.CONCEPTS)}))"
    n = lines.withColumn("t", F.expr(d.strip("text"))).withColumn("cleaned", F.expr(r.clean_line(d, "text")))
    n = n.withColumn("tidy", F.expr(r.tidy_title(d, t)))  # a column: the rule below names it in many places
    return n.select(
        "doc_id", "global_idx", "page", F.expr(boundary).alias("boundary"), F.expr(r.structural_line(d, t)).alias("structural"),
        F.expr(r.cut_title(d, "tidy", "'CONTENT'")).alias("as_title"), F.when(F.expr(r.garbage_line(d, "cleaned")), "").otherwise(F.col("cleaned")).alias("cleaned"),
    )


#: Forms whose presence at the start of lines makes a chunk hold more than one concept.
FORMS = [re.compile(p, re.I) for p in (r"gstr[- ]?1\b", r"gstr[- ]?2a", r"gstr[- ]?2b", r"gstr[- ]?3b", r"reg[- ]?0?6", r"cmp[- ]?0?8", r"pmt[- ]?0?6", r"drc[- ]?0?3")]
_STARTS = re.compile(r"\d+\.\d+(?:\.\d+)?\s+.|(?:\d+\.\d+\s+)?(?:FORM\s+)?(?:GST\s+)?(?:REG|GSTR|CMP|PMT|DRC)", re.I)


def unhyphenated(lines: list[str]) -> list[str]:
    """Lines without blank ones; a line that ends in a hyphen runs on in the next, unless a blank comes between."""
    out: list[str] = []
    open_ = False
    for line in (x.strip() for x in lines):
        if line and open_ and len(out[-1]) > 1 and out[-1].endswith("-"):
            out[-1] = out[-1][:-1] + line
        elif line:
            out.append(line)
        open_ = bool(line)
    return out


def concepts(raw: str) -> int:
    heads = [x for x in (y.strip() for y in raw.split("\n")) if x and len(x) <= 120 and _STARTS.match(x)]
    return sum(any(p.search(x) for x in heads) for p in FORMS)


def overlap(a: str, b: str) -> float:
    sets = [set(re.findall("[a-z0-9]{3,}", re.sub(r"[^\w\s]", "", " ".join(x.lower().split())))) for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if all(sets) else 0.0


class _Cutter:
    """lines: boundary, structural, title and text of the lines of a document, in order."""

    def __init__(self, lines: list[tuple], max_chars: int, whole: bool) -> None:
        self.flag, self.structural, self.title, self.text = map(list, zip(*lines, strict=True)) if lines else ([], [], [], [])
        self.max, self.whole = max_chars, whole

    def raw(self, a: int, b: int) -> str:
        return "\n".join(unhyphenated([x for x in self.text[a:b] if x]))

    def edges(self, a: int, b: int) -> list[int]:
        return [a, *(i for i in range(a + 1, b) if self.flag[i]), b]

    def name(self, a: int, b: int, fallback: str) -> str:
        return next((self.title[i] for i in range(a, b) if self.structural[i]), fallback[:80])

    def cut(self, title: str, a: int, b: int) -> list[tuple[str, str, int, int]]:
        """Ranges that are small enough and hold one concept; a single line is cut into pieces of max, or,
        if not whole, cut off there."""
        raw = self.raw(a, b)
        if len(raw) <= self.max and concepts(raw) <= 1:
            return [(title, raw, a, b)] if len(raw) >= 20 else []
        edges = self.edges(a, b)
        if len(edges) == 2:
            middle = a + (b - a) // 2
            if not a < middle < b:
                return [(title, raw[i : i + self.max], a, b) for i in range(0, len(raw) if self.whole else min(len(raw), 1), self.max)]
            edges = [a, middle, b]
        parts = zip(edges[:-1], edges[1:], strict=True)
        return [chunk for s, e in parts for chunk in self.cut(self.name(s, e, title), s, e)]

    def chunks(self, a: int, b: int, title: str, synthetic) -> list[tuple[str, str, int, int]]:
        edges = self.edges(a, b)
        named = [(self.name(s, e, title), s, e) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return [c for t, s, e in named if not synthetic(t) for c in self.cut(t, s, e)]


def _synthetic(t: str) -> bool:
    """Python form of the rule for titles that chunks get; numbered ones never are."""
    if re.match(r"\d+\.\d+|SECTION|UNIT", t, re.I):
        return False
    low, commas = t.lower(), t.count(",")
    return not t or (commas > 1 and len(t) > 40) or (any(w in low for w in r.SYNTHETIC_WORDS) and (len(t) > 35 or commas > 0)) or bool(len(t) > 50 and "." in t and re.search(r"\b(and|or|including)\b", low))


def merged_neighbours(chunks: list[tuple], structural, threshold: float) -> list[tuple]:
    """Chunks that share words with the one before join it, unless one of two different titles is structural."""
    out: list[tuple] = []
    for title, raw, a, b in chunks:
        if out:
            t, text, s, e = out[-1]
            apart = t.strip().lower() != title.strip().lower() and (structural(title) or structural(t))
            if not apart and overlap(text, raw) >= threshold:
                out[-1] = (t, text + "\n" + raw, s, max(e, b))
                continue
        out.append((title, raw, a, b))
    return out


CHUNK = "doc_id string, line_idx long, chunk int, title string, raw_content string, start long, end long"
_CHUNK_NAMES = [c.split()[0] for c in CHUNK.split(", ")]
_CHUNK_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in CHUNK.split(", ")]


def semantic_chunks(lines: DataFrame, spans: DataFrame, max_chars: int = 6000, threshold: float = 0.15, whole: bool = True) -> DataFrame:
    """spans: doc_id, line_idx, title, start, end. The chunks of each range, in order: doc_id, line_idx,
    chunk, title, raw_content, start, end. One task holds the lines of one document at a time. A line
    longer than max_chars becomes several chunks; without whole, what is over is dropped."""
    # a given number of partitions: the work on a line is large against its bytes, by which they would be joined
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # lines and then ranges of each document, sorted in one stream: a group a document would cost far more than its fold
    own = F.col("doc_id").cast("string").alias("doc_id")
    no = lambda kind: F.lit(None).cast(kind)
    ready = prepared_lines(lines).select(own, F.lit(False).alias("span"), F.col("global_idx").cast("long").alias("start"), "boundary", "structural", F.col("as_title").alias("title"), F.col("cleaned").alias("text"), no("long").alias("end"), no("long").alias("line_idx"))
    wanted = spans.select(own, F.lit(True).alias("span"), F.col("start").cast("long").alias("start"), no("boolean").alias("boundary"), no("boolean").alias("structural"), "title", no("string").alias("text"), F.col("end").cast("long").alias("end"), F.col("line_idx").cast("long").alias("line_idx"))
    rows = ready.unionByName(wanted).repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "span", "start")

    def one(doc_id: str, left: list[tuple], right: list[tuple]) -> Iterator[tuple]:
        cutter = _Cutter(left, max_chars, whole)
        named = {title for _, structural, title, _ in left if structural}
        for title, start, end, line_idx in right:
            cut = cutter.chunks(start, end, title, _synthetic)
            yield from ((doc_id, line_idx, i, *c) for i, c in enumerate(merged_neighbours(cut, named.__contains__, threshold)))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, left, right = None, [], []
        for batch in batches:
            for doc_id, span, start, boundary, structural, title, text, end, line_idx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc_id != at:
                    yield from one(at, left, right)
                    at, left, right = doc_id, [], []
                if span:
                    right.append((title, start, end, line_idx))
                else:
                    left.append((boundary, structural, title, text))
        yield from one(at, left, right)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = documents(batches)
        while some := list(islice(found, 512)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), _CHUNK_TYPES, strict=True)], _CHUNK_NAMES)

    return rows.mapInArrow(fold, CHUNK)


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose title can head a section and that aren't a table of contents."""
    d = r.SPARK
    chunks, columns = chunks.withColumn("_t", F.expr(d.strip("title"))), chunks.columns
    t = "_t"
    numbered = d.has(t, r"^\d+\.\d+")
    weak = f"({r.synthetic_title(d, t)} OR {r.paragraph_title(d, t)} OR length(regexp_replace({t}, '[^A-Za-z]', '')) < 3)"
    return chunks.where(f"({numbered} OR NOT {weak}) AND NOT {r.contents_page(d, 'title', 'raw_content')}").select(*columns)
