"""Text rules as SQL, for Spark and, with another dialect, for engines to test against.

A rule is a function of a dialect and a SQL expression; it returns a SQL expression. The
patterns, word lists and limits below are fixed values of the document model.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------------------------
LEGAL_REFERENCE = r"(?i)^Section\s+\d{2,}[A-Z]{0,4}(?:\s+[A-Z]{1,4})?\s+(?:of\s+the\s+Act|under\s+the\s+Act|of\s+the|or\s+section|or\s+under|and\s+section)\b"
LEGAL_LABEL = r"(?i)^Section\s+\d{2,}[A-Z]{0,4}(?:\s+[A-Z]{1,4})?\s*:\s*"
LEGAL_CHAIN = r"(?i)\bor\s+section\s+\d"
BOOK_SECTION = r"(?i)^(?:INTRODUCTION|BACKGROUND|DEFINITIONS?|PROVISIONS?|SUMMARY|CONCLUSION|APPENDIX|GLOSSARY|PREFACE|ACKNOWLEDGEMENTS?|TABLE\s+OF\s+CONTENTS|CONTENTS|INDEX|FOREWORD)\b"
SYNTHETIC_WORDS = ("engagement terms", "reporting standards", "materiality", "acceptance", "terms,", "standards,", "overview of", "introduction to")
GARBAGE = (
    r"\(Detected as", r"^This (instruction|document) asks", r"^The response should", r"^Reply format", r"^Directly return", r"^concise summary", r"^without any introductory",
    r"^Please note:", r"^system:\s*", r"^assistant:\s*", r"^user:\s*", r"^OCR\s*(metadata|confidence)", r"^extraction\s+instruction", r"^parser\s+label", r"^internal\s+pipeline",
)
PHYSICAL_INDEX = r"(?i)<\s*physical_index_\d+\s*>"
PAGE_MARKER = r"(?i)^(?:page\s+)?\d{1,3}\s*(?:of\s+\d{1,3})?$"
HEADER_FOOTER = r"(?i)^(?:page\s+\d+|www\.|http://|https://|all copyrights|self-instructional study material|reprint\s+\d{4}|jagat guru|panjab university|established by act)$"
TABLE_JUNK = r"^\d{5,}\.\d{2}\s+\d{1,2}-[A-Za-z]+"
ARTIFACTS = ("detected as legal book", "detected as legal act", "ocr metadata", "extraction instruction", "parser label", "internal pipeline", "this instruction asks", "physical_index", "<physical_index")
SECTION = r"(?i)^SECTION\s+([A-Z])\s*$"
UNIT = r"(?i)^UNIT\s*(?:NO:?\s*)?([IVXLC\d]+)\s*[:\.]?\s*(.*)$"
TOPIC, SUBTOPIC = r"^(\d+)\.(\d+)\s+(.+)$", r"^(\d+)\.(\d+)\.(\d+)\s+(.+)$"
PREFACE, OBJECTIVES = r"(?i)^PREFACE\s*$", r"(?i)^(?:OBJECTIVE|OBJECTIVES)\s*:?\s*$"
REFERENCES, COURSE = r"(?i)^(?:SUGGESTED\s+)?READINGS?\s*:?\s*$", r"(?i)^COURSE\s*(?:COORDINATOR|INFO)?"
SYLLABUS, STRUCTURE = r"(?i)^(?:SYLLABUS|MAX\.\s*MARKS|INSTRUCTIONS\s+FOR|CREDITS\s*:)", r"(?i)^STRUCTURE\s*$"
TAX_FORM = r"(?i)^(?:\d+\.\d+\s+)?(?:FORM\s+)?GST\s+(?:REG|GSTR|CMP|PMT|PMT-?\d|DRC)"
TAX_TOPIC = r"(?i)^(\d+)\.(\d+)\s+(?:FORM\s+)?(?:GST|GSTR|DRC|CMP|PMT)"
LET_SUM = r"(?i)^\d+\.\d+\s+(?:Let\s+us\s+sum\s+up|Let\s+Sum\s+Up|Test\s+Your\s+Knowledge)"
CHAPTER = r"(?i)^(?:CHAPTER|UNIT|PART)\s+([IVXLC\d]+)"
FRONT_WORDS = ("preface", "course coordinator", "objectives", "syllabus", "suggested reading", "max. marks", "instructions for")
CONCEPTS = (BOOK_SECTION, r"(?i)^\d+\.\d+(?:\.\d+)?\s+(?:FORM\s+)?(?:GST|GSTR)", r"(?i)^\d+\.\d+\s+GSTR", r"(?i)^\d+\.\d+\s+(?:Let\s+us\s+sum\s+up|Let\s+Sum\s+Up|Test\s+Your)", r"(?i)^FORM\s+GST\s+(?:CMP|PMT|REG)")
FORM_LINE = r"(?i)^(?:\d+\.\d+\s+)?(?:FORM\s+)?(?:GST\s+)?(?:REG|GSTR|CMP|PMT|DRC)"
KEEP = r"(?i)\b(GST|GSTR|REG-?\d|form|section|rule|shall|must|due date|portal|registration|certificate|challan|return|filing|tax|invoice|credit|\d+%|\d{4}|Rs\.|rupee|deadline|procedure|step|download|upload|DRC|CMP|PMT)\b"
DROP = (
    r"^the study material has been prepared", r"^all copyrights with", r"^self-instructional study material", r"^jagat guru nanak dev", r"^established by act no",
    r"^in keeping with the nature", r"^we,? at the university,? welcome", r"^prof\.\s", r"^let us sum up", r"^test your knowledge",
)
ISSUES = {
    "belated_filing_interest": ("belated payment", "belated filing", "section 50", "delayed payment"),
    "itc_mismatch": ("input tax credit", "itc mismatch", "wrongly availed", "wrongly utilized"),
    "valuation_dispute": ("valuation", "undervaluation"),
    "eway_bill": ("e-way bill", "eway bill"),
    "return_mismatch": ("gstr-1", "gstr-3b mismatch", "return mismatch"),
}
ENTITIES = (("reg06", r"gst\s*reg[- ]?0?6"), ("gstr2a", r"gstr[- ]?2a"), ("gstr2b", r"gstr[- ]?2b"), ("gstr1", r"gstr[- ]?1"), ("gstr3b", r"gstr[- ]?3b"), ("cmp08", r"cmp[- ]?0?8"), ("pmt06", r"pmt[- ]?0?6"), ("drc03", r"drc[- ]?0?3"), ("itc", r"input tax credit"), ("itc", r"\bitc\b"))
TITLE_HINTS = {
    "reg06": (r"reg[- ]?0?6", r"6\.2", r"registration certificate"), "gstr1": (r"gstr[- ]?1", r"6\.3", r"6\.4"), "gstr2a": (r"gstr[- ]?2a", r"6\.5"), "gstr2b": (r"gstr[- ]?2b", r"6\.6"), "gstr3b": (r"gstr[- ]?3b", r"6\.7"),
    "cmp08": (r"cmp[- ]?0?8", r"6\.8"), "pmt06": (r"pmt[- ]?0?6", r"6\.9"), "drc03": (r"drc[- ]?0?3", r"6\.10"), "itc": (r"input tax credit", r"\bitc\b", r"10\.7"),
}
WORD_CLASS = r"\p{L}\p{N}_"
#: In Spark's SQL: white space, and a column as such or with null as the empty text.
_BLANKS, _COLUMN = r"' \t\n\u000B\u000C\r'", re.compile(r"\w+|coalesce\(\w+, ''\)")


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def text(self, s: str) -> str:
        return ("r'" if self.spark and "\\" in s else "'") + s.replace("'", "''") + "'"

    def has(self, t: str, pattern: str) -> str:
        return f"({t} RLIKE {self.text(pattern)})" if self.spark else f"regexp_matches({t}, {self.text(pattern)})"

    def any(self, t: str, patterns, flags: str = "") -> str:
        return "(" + " OR ".join(self.has(t, flags + p) for p in patterns) + ")"

    def contains(self, t: str, words) -> str:
        return "(" + " OR ".join(f"contains({t}, {self.text(w)})" for w in words) + ")"

    def sub(self, t: str, pattern: str, by: str) -> str:
        by = by if self.spark else by.replace("$", "\\")
        return f"regexp_replace({t}, {self.text(pattern)}, {self.text(by)}" + (")" if self.spark else ", 'g')")

    def group(self, t: str, pattern: str, n: int) -> str:
        return f"regexp_extract({t}, {self.text(pattern)}, {n})"

    def strip(self, t: str) -> str:
        """Without white space at both ends. Spark's trim reads the whole text to know its end, so a column's end is looked at
        before; a pattern would look at every character."""
        if not self.spark:
            return self.sub(t, r"^\s+|\s+$", "")
        if not _COLUMN.fullmatch(t):
            return f"trim(BOTH {_BLANKS} FROM {t})"
        ends = " OR ".join(f"endswith({t}, '{c}')" for c in (" ", r"\t", r"\n", r"\u000B", r"\u000C", r"\r"))
        return f"trim(LEADING {_BLANKS} FROM CASE WHEN {ends} THEN trim(TRAILING {_BLANKS} FROM {t}) ELSE {t} END)"

    def spaced(self, t: str) -> str:
        """A space for each run of white space. In Spark what is one already is not matched, which is most of them, and a
        match starts with one class of characters: alternatives would be tried at every character."""
        return self.sub(t, r"\s(?:(?<! )\s*|\s+)" if self.spark else r"\s+", " ")

    def split(self, t: str, pattern: str) -> str:
        return f"{'split' if self.spark else 'regexp_split_to_array'}({t}, {self.text(pattern)})"

    def lines(self, t: str) -> str:
        return f"split({t}, '\\n', -1)" if self.spark else f"string_split({t}, chr(10))"

    def each(self, kind: str, array: str, var: str, body: str) -> str:
        """kind: filter or transform."""
        return f"{kind}({array}, {var} -> {body})" if self.spark else f"list_{kind}({array}, lambda {var}: {body})"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def slice(self, array: str, n: int) -> str:
        return f"slice({array}, 1, {n})" if self.spark else f"({array})[1:{n}]"

    def join(self, array: str, by: str) -> str:
        return f"array_join({array}, {by})" if self.spark else f"array_to_string({array}, {by})"

    def words(self, t: str) -> str:
        return self.each("filter", self.split(t, r"\s+"), "w", "w <> ''")

    def sha(self, t: str) -> str:
        return f"sha2({t}, 256)" if self.spark else f"sha256({t})"

    def found(self, t: str, pattern: str) -> str:
        return f"regexp_extract_all({t}, {self.text(pattern)}, 0)" if self.spark else f"regexp_extract_all({t}, {self.text(pattern)})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})" if self.spark else f"list_distinct({array})"

    def count(self, t: str, char: str) -> str:
        return f"(length({t}) - length(replace({t}, '{char}', '')))"


SPARK, DUCK = Dialect(True), Dialect(False)


def case(*steps: tuple[str, str], otherwise: str = "false") -> str:
    """First condition that holds decides."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in steps) + f" ELSE {otherwise} END"


# --- hashes, tokens ------------------------------------------------------------------------------


def normalized(d: Dialect, t: str) -> str:
    return normalized_low(d, f"lower({d.strip(f'coalesce({t}, {d.text('')})')})")


def normalized_low(d: Dialect, low: str) -> str:
    """The same of a stripped text in lower case."""
    return d.sub(d.spaced(low), rf"[^{WORD_CLASS}\s]", "")


def content_hash(d: Dialect, t: str) -> str:
    return d.sha(normalized(d, t))


def token_set(d: Dialect, t: str) -> str:
    return d.distinct(d.found(normalized(d, t), "[a-z0-9]{3,}"))


def query_tokens(d: Dialect, t: str) -> str:
    return d.found(f"lower(coalesce({t}, ''))", "[a-z0-9]+(?:-[a-z0-9]+)?")


def first_query_tokens(t: str, n: int) -> str:
    """The first tokens of query_tokens() in Spark, found without reading on. Two more letters have a lower case that begins
    with a letter from a to z: the Kelvin sign and the dotted I, which ends a token."""
    word = "A-Za-z0-9\\u0130\\u212A"
    start = SPARK.group(f"coalesce({t}, '')", f"^(?:[^{word}]*[{word}]+(?:-[{word}]+)?){{0,{n}}}", 0)
    return SPARK.slice(query_tokens(SPARK, start), n)


def token_count(d: Dialect, t: str) -> str:
    return d.size(d.words(f"coalesce({t}, '')"))


def tokens_ceil(d: Dialect, t: str) -> str:
    return f"CASE WHEN length(coalesce({t}, '')) = 0 THEN 0 ELSE greatest(1, CAST(floor((length({t}) + 3) / 4) AS INT)) END"


def tokens_floor(d: Dialect, t: str) -> str:
    return f"CASE WHEN length(coalesce({t}, '')) = 0 THEN 0 ELSE greatest(1, CAST(floor(length({t}) / 4) AS INT)) END"


# --- titles --------------------------------------------------------------------------------------
# t is stripped and not null


def legal_title(d: Dialect, t: str) -> str:
    prose = f"contains(lower({t}), ' of the ') OR {t} LIKE '%:' OR length({t}) > 45"
    return f"({d.any(t, (LEGAL_REFERENCE, LEGAL_LABEL, LEGAL_CHAIN))} OR ({d.has(t, r'(?i)^Section\s+\d{2,}[A-Z]{0,4}\b')} AND ({prose}) AND NOT {d.has(t, r'^Section\s+\d+\.\d+')}))"


def synthetic_title(d: Dialect, t: str) -> str:
    numbered = d.has(t, r"^\d+\.\d+")
    return case(
        (f"{t} = ''", "true"),
        (d.has(t, r"(?i)^(?:SECTION|UNIT|\d+\.\d+)"), "false"),
        (f"{d.count(t, ',')} >= 2 AND length({t}) > 40", "true"),
        (f"{d.contains(f'lower({t})', SYNTHETIC_WORDS)} AND NOT {numbered} AND (length({t}) > 35 OR {d.count(t, ',')} >= 1)", "true"),
        (f"length({t}) > 50 AND {d.count(t, '.')} >= 1 AND NOT {d.has(t, r'^\d+\.\d+(?:\.\d+)?\s+')} AND {d.has(f'lower({t})', r'\b(and|or|including)\b')}", "true"),
    )


def paragraph_title(d: Dialect, t: str) -> str:
    numbered = d.has(t, r"^\d+\.\d+")
    return case(
        (f"{t} = '' OR {legal_title(d, t)} OR {synthetic_title(d, t)}", "true"),
        (d.has(t, r"(?i)^(?:provisions|introduction|background|definitions)\s+(?:of|to|for|under|in)\b"), "true"),
        (d.has(t, r"(?i)^(?:SECTION|UNIT|CHAPTER)\s+"), "false"),
        (f"{d.has(t, r'^\d+\.\d+(?:\.\d+)?\s+\S')} AND length({t}) <= 90", "false"),
        (f"{d.has(t, r'(?i)^(?:FORM\s+)?GST\s')} AND length({t}) <= 80", "false"),
        (f"{d.has(t, BOOK_SECTION)} AND length({t}) <= 90", "false"),
        (f"{d.has(t, r'^[^a-zA-Z]*[a-z]')} AND NOT {numbered}", "true"),
        (f"{t} LIKE '%.' AND NOT {numbered}", "true"),
        (d.has(t, r"(?i)\b(or|and|of|the|to|in|under|with|for|shall|has|been|which|is|by|its|on|from)\s+section\b"), "true"),
        (f"{t} LIKE '%:' AND NOT {d.has(t, r'(?i)^(?:SECTION|UNIT|CHAPTER|FORM)\b')} AND {token_count(d, t)} > 3", "true"),
        (f"length({t}) > 55", "true"),
        (d.has(t, r"(?i)\b(the|for the|according to|shall be|has been|which is|except where|furnished after|commencement of)\b"), "true"),
        (f"{d.count(t, '.')} >= 2 OR {d.count(t, ',')} >= 2", "true"),
    )


def bad_topic(d: Dialect, t: str) -> str:
    """A topic number whose title is numbers again."""
    rest = d.group(t, TOPIC, 3)
    return f"({d.has(rest, r'^[-+0-9.,\s]+$')} OR {d.has(rest, r'^\d+\.\d+')})"


def structural_line(d: Dialect, t: str) -> str:
    simple = (SECTION, UNIT, TAX_FORM, TAX_TOPIC, LET_SUM, PREFACE, OBJECTIVES, REFERENCES, SYLLABUS, CHAPTER)
    return case(
        # a legal title is a paragraph title; the SQL for other engines says both
        (f"{t} = '' OR length({t}) > 100 OR {paragraph_title(d, t)}" + ("" if d.spark else f" OR {legal_title(d, t)}"), "false"),
        (d.has(t, SUBTOPIC), "true"),
        (d.has(t, TOPIC), f"NOT {bad_topic(d, t)}"),
        (d.any(t, simple), "true"),
        (f"{d.any(t, (COURSE, BOOK_SECTION))} AND length({t}) < 90", "true"),
    )


def valid_heading(d: Dialect, t: str) -> str:
    return f"(length({t}) BETWEEN 1 AND 100 AND NOT {paragraph_title(d, t)} AND NOT {legal_title(d, t)} AND ({structural_line(d, t)} OR ({d.has(t, BOOK_SECTION)} AND length({t}) <= 90)))"


def ocr_repaired(d: Dialect, t: str) -> str:
    for pattern, by in ((r"Section\s+(\d+[A-Z])\s+([A-Z])\b", "Section $1$2"), (r"Section\s+(\d+[a-z])\s+([a-z])\b", "Section $1$2"), (r"([A-Z]{2,})\s+(-)\s+([A-Z])", "$1-$3")):
        t = d.sub(t, pattern, by)
    return t


def without_index(d: Dialect, t: str) -> str:
    """Index tags removed. (A line that holds nothing but one is left empty, as in the line form.)"""
    return d.sub(t, PHYSICAL_INDEX, "")


def tidy_title(d: Dialect, t: str) -> str:
    return ocr_repaired(d, d.strip(d.sub(d.spaced(d.strip(without_index(d, t))), r"(?i)\(Detected as[^)]*\)", "")))


def cut_title(d: Dialect, t: str, kind: str = "'TOPIC'") -> str:
    """t: a tidy title. Prose and very long titles are cut; a number stays in front."""
    numbered = f"({d.has(t, TOPIC)} OR {d.has(t, SUBTOPIC)})"
    rest = case((d.has(t, TOPIC), d.group(t, TOPIC, 3)), otherwise=d.group(t, SUBTOPIC, 4))
    front = d.group(t, r"^(\d+\.\d+)", 1)
    return case(
        (f"{kind} IN ('TOPIC', 'SUBTOPIC', 'CONTENT') AND {paragraph_title(d, t)}", case((numbered, d.strip(f"concat({front}, ' ', substring({rest}, 1, 60))")), (f"length({t}) > 60", d.strip(f"substring({t}, 1, 60)")), otherwise=t)),
        (f"length({t}) > 90 AND {numbered}", d.strip(f"substring({t}, 1, 90)")),
        otherwise=t,
    )


# --- lines ---------------------------------------------------------------------------------------


def garbage_line(d: Dialect, t: str) -> str:
    return f"(length({t}) < 2 OR {d.any(t, (PHYSICAL_INDEX, PAGE_MARKER, HEADER_FOOTER))} OR ({d.has(t, TABLE_JUNK)} AND length({t}) > 40) OR {d.any(t, GARBAGE, '(?i)')})"


def artifact(d: Dialect, t: str, low: str | None = None) -> str:
    """low: t in lower case, where it is there already. In Spark the words alone are looked for, as an index tag holds one."""
    if d.spark:
        return d.contains(low or f"lower({t})", [w for w in ARTIFACTS if not w.startswith("<")])
    return f"({d.contains(f'lower({t})', ARTIFACTS)} OR {d.has(t, PHYSICAL_INDEX)})"


def clean_line(d: Dialect, t: str) -> str:
    soft = f"replace({without_index(d, t)}, {'char(173)' if d.spark else 'chr(173)'}, '')"
    detected = d.strip(d.sub(d.strip(d.spaced(soft)), r"(?i)\(Detected as[^)]*\)", ""))
    return d.sub(detected, r"^[-–—]\s*", "")


def contents_page(d: Dialect, title: str, raw: str) -> str:
    lines = found = d.slice(d.each("filter", d.each("transform", d.lines(f"coalesce({raw}, '')"), "x", d.strip("x")), "x", "x <> ''"), 50)
    if d.spark:  # the lines are named, so that they are made once and not in each place
        lines = "found"
    leader = f"({d.has('x', r'\.{3,}\s*\d{1,4}\s*$')} OR ({d.has('x', r'\s{2,}\d{1,3}\s*$')} AND length(x) < 120))"
    hits, n = d.size(d.each("filter", lines, "x", leader)), d.size(lines)
    named = d.has(f"lower(coalesce({title}, ''))", r"\b(table\s+of\s+contents|^\s*contents\s*$)\b")
    listed = f"({n} >= 4 AND {hits} >= greatest(3, CAST(floor({n} * 0.3) AS INT)))"
    if d.spark:
        listed = f"get(transform(array({found}), found -> {listed}), 0)"
    return f"({named} OR {listed})"


# --- sentences -------------------------------------------------------------------------------------


def micro_sentences(d: Dialect, t: str, longer_than: int = 0) -> str:
    marked = d.sub(d.spaced(f"coalesce({t}, '')"), r"([.!?])\s+", "$1\x1e")
    parts = f"split({marked}, '\x1e')" if d.spark else f"string_split({marked}, '\x1e')"
    return d.each("filter", d.each("transform", parts, "x", d.strip("x")), "x", f"length(x) > {longer_than}")


def sentences(d: Dialect, t: str) -> str:
    return micro_sentences(d, t, 10)


def sentence_score(d: Dialect, s: str) -> str:
    one = lambda c, v: f"CASE WHEN {c} THEN {v} ELSE 0.0 END"
    return f"CAST(1.0 + {one(d.has(s, KEEP), 3.0)} + {one(d.has(s, '[0-9]'), 1.5)} + {one(f'length({s}) < 30', -0.5)} + {one(d.any(s, DROP, '(?i)'), -10.0)} AS DOUBLE)"


# --- notices, errors, paths, entities ------------------------------------------------------------------


def issue_category(d: Dialect, t: str) -> str:
    return case(*((d.contains(f"lower(coalesce({t}, ''))", words), f"'{k}'") for k, words in ISSUES.items()), otherwise="'uncategorized'")


def notice_fields(d: Dialect, t: str) -> dict[str, str]:
    first = lambda p: f"nullif({d.strip(d.group(t, p, 1))}, '')"
    return {
        "reference_no": first(r"(?i)Reference\s*No\.?\s*[:\-]?\s*([A-Z0-9]+)"),
        "notice_section": first(r"(?:^|\b)[Ss]ection\s+(\d+)"),
        "tax_period": f"coalesce({first(r'(?i)Tax\s*Period\s*[:\-]\s*([^\n\r]+)')}, {first(r'\b([A-Z]{3}\s+\d{4}\s*[-–]\s*[A-Z]{3}\s+\d{4})\b')})",
        "gstin": first(r"(?i)GSTIN/ID\s*:\s*([A-Z0-9]+)"),
    }


def slug(d: Dialect, t: str, most: int) -> str:
    s = d.sub(d.strip(d.sub(f"coalesce({t}, '')", rf"[^{WORD_CLASS}\s\-.]", "")), r"\s+", "_")
    return f"coalesce(nullif(substring({s}, 1, {most}), ''), 'NODE')"


def path_segment(d: Dialect, title: str, kind: str) -> str:
    section, unit = d.group(title, r"(?i)SECTION\s+([A-Z])", 1), d.group(title, r"(?i)UNIT\s+([IVXLC\d]+)", 1)
    return case(
        (f"{kind} = 'ROOT'", "'ROOT'"),
        (f"{kind} = 'SECTION' AND {section} <> ''", f"concat('SECTION_', upper({section}))"),
        (f"{kind} = 'UNIT' AND {unit} <> ''", f"concat('UNIT_', upper({unit}))"),
        (f"{kind} IN ('SECTION', 'UNIT')", slug(d, title, 40)),
        otherwise=slug(d, title, 50),
    )


def entities(d: Dialect, t: str) -> str:
    """Ordered tags of the forms that a query names; a tag can come twice."""
    tags = ", ".join(f"CASE WHEN {d.has(f'lower({t})', p)} THEN '{tag}' END" for tag, p in ENTITIES)
    return d.each("filter", f"array({tags})" if d.spark else f"[{tags}]", "x", "x IS NOT NULL")


def row_id(d: Dialect, seq: str, node: str) -> str:
    """Sortable id: six digits of the sequence, then the right-most four characters of the node id."""
    digits = f"format_string('%06d', {seq})" if d.spark else f"printf('%06d', {seq})"
    return f"concat({digits}, {f'right(lpad({node}, CAST(greatest(4, length({node})) AS INT), {chr(39)}0{chr(39)}), 4)'})"


def user_error(d: Dialect, t: str) -> str:
    """Kind of user-facing message for an error text; first match wins."""
    low = f"lower({t})"
    has = lambda *w: d.contains(low, w)
    return case(
        (has("limitreached", "limit reached"), "'upload_limit'"),
        (has("openrouter"), "'router_disabled'"),
        (has('_api_key', 'api key is not set'), "'set_key'"),
        (has("insufficientcredits", "402", "credit", "quota", "payment"), "'credits_exhausted'"),
        (f"{has('401', 'authentication')} OR ({has('403')} AND {has('invalid')} AND {has('key')})", "'invalid_key'"),
        (has("timed out"), "'timed_out'"),
        otherwise="'other'",
    )
