"""Extractive compression and lexical metadata of sections.

Aliases, keywords, synonyms and summaries are SQL expressions. Compression keeps or drops
sentences one after another against a length budget, so it runs as an Arrow-batched function,
a text at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rules as r

#: Names that each form goes by.
FORM_NAMES = (
    (r"GST\s*REG[- ]?0?6", ("FORM GST REG-06", "GST REG 06", "GST REG-06", "GST registration certificate", "registration certificate download")),
    (r"GSTR[- ]?1\b", ("GSTR-1", "GSTR 1", "GSTR1", "GSTR1 return")),
    (r"GSTR[- ]?2A", ("GSTR2A", "GSTR-2A", "GSTR 2A")),
    (r"GSTR[- ]?2B", ("GSTR2B", "GSTR-2B", "GSTR 2B")),
    (r"GSTR[- ]?3B", ("GSTR-3B", "GSTR 3B", "GSTR3B")),
    (r"GST\s*CMP[- ]?0?8", ("GST CMP-08", "CMP08", "CMP-08")),
    (r"GST\s*PMT[- ]?0?6", ("GST PMT-06", "PMT06", "PMT-06", "payment challan")),
    (r"DRC[- ]?0?3", ("DRC03", "DRC-03", "demand recovery")),
    (r"input tax credit|\bitc\b", ("input tax credit", "ITC", "ITC verification")),
)
#: Keyword phrases of a lower-cased text that matches.
KEYWORDS = (
    (r"gstr[- ]?1", ("GSTR-1 return filing",)),
    (r"gstr[- ]?2a", ("GSTR-2A reconciliation", "GSTR2A auto-drafted return")),
    (r"gstr[- ]?2b", ("GSTR-2B matching",)),
    (r"gstr[- ]?3b", ("GSTR-3B monthly return",)),
    (r"reg[- ]?0?6", ("GST REG 06", "registration certificate form")),
    (r"pmt[- ]?0?6", ("GST PMT-06 payment",)),
    (r"cmp[- ]?0?8", ("GST CMP-08 composition return",)),
    (r"drc[- ]?0?3", ("DRC-03 demand payment",)),
    (r"input tax credit|\bitc\b", ("input tax credit verification", "ITC matching verification")),
)
SUMMARY_WORDS = ("gst", "gstr", "form", "registration", "return", "portal", "tax", "filing", "rule", "act")


def _listed(*groups: tuple[Column | None, list[Column]]) -> Column:
    """The items of the groups whose condition holds, in order, without nulls."""
    return F.filter(F.flatten(F.array(*(F.when(c, F.array(*xs)).otherwise(F.array(F.lit(None).cast("string"))) if c is not None else F.array(*xs) for c, xs in groups))), lambda x: x.isNotNull())


def _first_of_each(items: Column, key, longer_than: int, most: int) -> Column:
    """items whose key hasn't come before and is longer than a limit; most of them at most."""
    fit = F.filter(items, lambda x: F.length(key(x)) > longer_than)
    # x is the pair (key so far seen, kept): a fold over a handful of phrases
    start = F.struct(F.expr("CAST(array() AS array<string>)").alias("seen"), F.expr("CAST(array() AS array<string>)").alias("kept"))
    step = lambda acc, x: F.when(F.array_contains(acc["seen"], key(x)), acc).otherwise(F.struct(F.concat(acc["seen"], F.array(key(x))).alias("seen"), F.concat(acc["kept"], F.array(x)).alias("kept")))
    return F.slice(F.aggregate(fit, start, step, lambda acc: acc["kept"]), 1, most)


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def aliases(title: Column, raw: Column) -> Column:
    """The title, names of the forms it or the first 2500 characters mention, its number and short form."""
    blob = F.concat(title, F.lit(" "), F.substring(raw, 1, 2500))
    number, rest = F.regexp_extract(title, r"^(\d+\.\d+(?:\.\d+)?)\s+(.+)$", 1), F.trim(F.substring(F.regexp_extract(title, r"^(\d+\.\d+(?:\.\d+)?)\s+(.+)$", 2), 1, 60))
    short = (rest != "") & ~rest.rlike(r"(?i)\b(the|for the|according)\b")
    groups = [(None, [title])] + [(blob.rlike("(?i)" + p), [F.lit(n) for n in names]) for p, names in FORM_NAMES]
    groups += [(number != "", [number]), ((number != "") & short, [F.concat(number, F.lit(" "), rest)])]
    return _first_of_each(F.transform(_listed(*groups), _squeezed), F.lower, 2, 14)


def keywords(title: Column, raw: Column) -> Column:
    """Phrases of the forms and topics that the title or the first 3200 characters mention."""
    blob = F.lower(F.concat(title, F.lit(" "), F.substring(raw, 1, 3200)))
    lit = lambda *xs: [F.lit(x) for x in xs]
    groups = [
        (blob.contains("download") & (blob.contains("certificate") | blob.contains("reg")), lit("download GST registration certificate", "GST portal certificate download")),
        (blob.contains("due date") | blob.contains("when filing"), lit("GSTR-1 due date", "return filing due date")),
        *((blob.rlike(p), lit(*names)) for p, names in KEYWORDS),
    ]
    words = F.regexp_extract_all(title, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]{2,}"), F.lit(0))
    groups.append(((F.size(words) >= 2) & (F.length(title) < 60), [F.lower(F.array_join(F.slice(words, 1, 5), " "))]))
    found = _first_of_each(F.transform(_listed(*groups), F.trim), lambda x: x, 3, 16)
    alone = F.trim(F.substring(F.lower(title), 1, 80))
    return F.when((F.size(found) == 0) & (F.length(alone) > 3), F.array(alone)).otherwise(found)


def synonyms(names: Column, title: Column) -> Column:
    """Every alias as it is, with spaces for hyphens, and run together; then the title."""
    forms = F.flatten(F.transform(names, lambda a: F.array(a, F.regexp_replace(a, r"[-\s]+", " "), F.regexp_replace(a, r"[-\s]+", ""))))
    return _first_of_each(F.concat(forms, F.array(title)), lambda x: F.trim(F.lower(x)), 2, 18)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once a row, however often it is used: Spark writes out a column in every place
    that names it, and inside a lambda function it would be computed again for each item."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def micro_summary(title: Column, raw_name: str) -> Column:
    """Up to three sentences: the numbered title, sentences with domain words, then others."""
    return _let(F.expr(r.sentences(r.SPARK, raw_name)), lambda sents: _let(_first_sentences(title, sents), lambda joined: F.when((F.trim(F.coalesce(F.col(raw_name), F.lit(""))) == "") | (joined == ""), F.concat(F.lit("Section: "), title, F.lit("."))).otherwise(joined)))


def _first_sentences(title: Column, sents: Column) -> Column:
    cut = lambda s: F.when(F.length(s) <= 220, s).otherwise(F.concat(F.substring(s, 1, 217), F.lit("...")))
    domain = F.filter(sents, lambda s: (F.length(s) >= 20) & F.lower(s).rlike("|".join(SUMMARY_WORDS)))
    head = F.when(F.trim(title).rlike(r"^\d+\.\d+"), F.array(F.concat(F.lit("Covers "), F.trim(title), F.lit(".")))).otherwise(F.expr("CAST(array() AS array<string>)"))
    room = F.lit(3) - F.size(head)
    others = lambda picked: F.transform(F.slice(F.filter(sents, lambda s: ~F.array_contains(picked, s)), 1, 3), cut)
    return _let(F.concat(head, F.transform(F.slice(domain, 1, room), cut)), lambda picked: F.array_join(F.slice(F.concat(picked, others(picked)), 1, 3), " "))


def capped_summary(text: str) -> Column:
    """At most 60 words and three sentences, closed by punctuation. text: a column name."""
    words = F.expr(r.SPARK.words(f"coalesce({text}, '')"))
    sixty = F.when(F.size(words) > 60, F.array_join(F.slice(words, 1, 60), " ")).otherwise(F.trim(text))
    marked = F.split(F.regexp_replace(F.regexp_replace(sixty, r"\s+", " "), r"([.!?])\s+", "$1\x1e"), "\x1e")
    three = F.when(F.size(marked) > 3, F.array_join(F.slice(marked, 1, 3), " ")).otherwise(sixty)
    return F.when((three == "") | three.rlike(r"[.!?]$"), three).otherwise(F.concat(F.regexp_replace(three, r"[ .!?]+$", ""), F.lit(".")))


# --- compression --------------------------------------------------------------------------------------

_KEEP, _DROP, _DIGIT = re.compile(r.KEEP), re.compile("(?i)" + "|".join(r.DROP)), re.compile("[0-9]")


def sentences(text: str, longer_than: int = 10) -> list[str]:
    parts = re.split(r"(?<=[.!?])\s+", " ".join(text.split()))
    return [p for p in parts if len(p) > longer_than]


def _numbered(s: str) -> bool:
    return bool(_DIGIT.search(s)) or (not s.isascii() and any(c.isdigit() for c in s))


def worth(s: str) -> float:
    return 1.0 + 3.0 * bool(_KEEP.search(s)) + 1.5 * _numbered(s) - 0.5 * (len(s) < 30) - 10.0 * bool(_DROP.match(s))


def _closed(s: str) -> str:
    return s if not s or s[-1] in ".?!" else s.rstrip(" .!?") + "."


def _budgeted(words: list[str], budget: int) -> str:
    """As many words as fit, one at least."""
    used, n = 0, 0
    for w in words:
        if n and used + len(w) + 2 > budget:
            break
        used, n = used + len(w) + 1, n + 1
    return " ".join(words[:n])


def _taken(pool: list[str], enough: int, limit: int) -> tuple[list[str], int]:
    """Sentences of the pool in turn, until one would pass the limit after enough is reached."""
    out, total = [], 0
    for s in pool:
        if total >= enough and total + len(s) > limit:
            break
        out.append(s)
        total += len(s) + 1
    return out, total


#: Texts over LONG characters are cut to at most MOST of their length; what fills up to the least
#: share stops at FILLED, what repairs a short text at REPAIRED.
LONG, MOST, FILLED, REPAIRED = 400, 0.92, 0.85, 0.88


def compress(raw: str, target: float = 0.70, least: float = 0.60, key_chars: int | None = None) -> str:
    """The best sentences, in the order of their first occurrence, up to the target share of the text and at
    least the least. Sentences are the same if all their words are, or with key_chars if so many characters are."""
    if not raw or not raw.strip():
        return ""
    first: dict[str, str] = {}
    for s in sentences(raw):
        first.setdefault(" ".join(s.lower().split())[:key_chars], s)
    unique = list(first.values())
    if not unique:
        return raw.strip()
    limit, enough = int(len(raw) * target), int(len(raw) * least)
    worths = {s: worth(s) for s in unique}
    ranked = sorted(unique, key=lambda s: -worths[s])
    kept, total = _taken([s for s in ranked if worths[s] >= 0], enough, limit)
    held = set(kept)
    for s in ranked if total < enough else []:
        if s in held:
            continue
        if kept and total + len(s) > int(len(raw) * FILLED):
            break
        kept.append(s)
        held.add(s)
        total += len(s) + 1
        if total >= enough:
            break
    result = "\n".join(s for s in unique if s in held).strip() or raw.strip()
    if len(raw) > LONG and len(result) > MOST * len(raw):
        result = "\n".join(_taken(unique, enough, limit)[0]).strip() or result
        if len(result) > MOST * len(raw):
            result = _closed(_budgeted(result.split(), max(limit, enough)))
    return result


def _letters(s: str) -> str:
    return re.sub("[^a-z0-9]", "", s.lower())


def _known(s: str, others: list[str]) -> bool:
    a = _letters(s)
    return any(a == b or (len(a) > 10 and len(b) > 10 and (a in b or b in a)) for b in map(_letters, others))


def corrected(text: str, raw: str, least: int = 100) -> str:
    """A compressed text without dangling ends, closed by punctuation, and filled up from the raw text
    to least characters where the raw text has them, within 0.88 of its length."""
    if not text:
        return ""
    text, before = text.strip(), None
    while text != before:
        before = text
        text = re.sub(r"\b[a-zA-Z0-9]\.$", "", re.sub(r"[\s\-:#]+$", "", text))
    text = text.strip()
    if text and text[-1] not in ".?!":
        ends = [m.end() for m in re.finditer(r"[.!?]\s", text)]
        text = text[: ends[-1]].strip() if ends else text + "."
    if len(text) < least <= len(raw):
        held, budget = sentences(text, 0), int(len(raw) * REPAIRED) if len(raw) > LONG else len(raw)
        for s in sentences(raw, 0):
            if _known(s, held):
                continue
            used = len("\n".join(held))
            if used + len(s) + 1 > budget:
                if budget - used - 1 >= 15:
                    held.append(_closed(_budgeted(s.split(), budget - used - 1)))
                text = "\n".join(held)
                break
            held.append(s)
            text = "\n".join(held)
            if len(text) >= least:
                break
    return raw.strip() if len(text) < 15 <= len(raw) else text


def compressed_text(raw: str, target: float = 0.70, least: float = 0.60) -> str:
    text = compress(raw, target, least)
    if len(raw) > LONG and len(text) > MOST * len(raw):
        text = compress(raw, max(0.60, least), least)
    return corrected(text, raw)


def compressed(raw: Column, target: float = 0.70, least: float = 0.60) -> Column:
    """The compressed text of a column, Arrow-batched; empty for null and blank texts."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: compressed_text(t or "", target, least))

    return run(raw)


def enriched(nodes: DataFrame, target: float = 0.70, least: float = 0.60) -> DataFrame:
    """Content nodes (title, raw_content, ...) with compressed_content, content_hash, token counts,
    aliases, keywords, synonyms and micro_summary."""
    n = nodes.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("raw_content", F.coalesce("raw_content", F.lit("")))
    n = n.withColumn("compressed_content", compressed(F.col("raw_content"), target, least)).withColumn("content_hash", F.expr(r.content_hash(r.SPARK, "raw_content")))
    n = n.withColumn("token_count_raw", F.expr(r.token_count(r.SPARK, "raw_content"))).withColumn("token_count_compressed", F.expr(r.token_count(r.SPARK, "compressed_content")))
    n = n.withColumn("aliases", aliases(F.col("title"), F.col("raw_content"))).withColumn("keywords", keywords(F.col("title"), F.col("raw_content")))
    n = n.withColumn("synonyms", synonyms(F.col("aliases"), F.col("title"))).withColumn("micro_summary", micro_summary(F.col("title"), "raw_content"))
    for c in ("aliases", "keywords", "synonyms"):
        n = n.withColumn(c, F.expr(f"transform({c}, x -> {r.ocr_repaired(r.SPARK, 'x')})"))
    return n.withColumn("micro_summary", capped_summary("micro_summary"))
