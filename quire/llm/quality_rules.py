"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams, in SQL functions only.

An n-gram is three neighbouring word shapes (runs of capitals, small letters, other letters
and digits become one sign each; everything else stays), hashed into ``BUCKETS``. Two
multinomials over the buckets, one of trusted documents and one of the raw corpus, give each
bucket ln P(bucket | trusted) - ln P(bucket | raw). Both are smoothed by the same share FLOOR,
not by a count, so the ratios are alike at every size. A document's score is the mean over its
n-grams, so length doesn't count, and it is kept from ``threshold`` on.

Both counts cover every document. What is shuffled to mark the trusted ones is the buckets,
two bytes an n-gram, not the texts; counting aggregates partially into BUCKETS groups, scoring
is one pass without a shuffle; the ratios, BUCKETS numbers, are a literal in the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import let, words_of

BUCKETS = 1 << 14
N = 3
#: Share of all n-grams that each bucket has at least, in either multinomial.
FLOOR = 1e-6
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"


def shapes(text: Column) -> Column:
    """The word shapes of a text, in order."""
    t = F.coalesce(text, F.lit(""))
    for pattern, sign in ((r"\p{Lu}++", "A"), (r"\p{Ll}++", "a"), (r"[\p{L}&&[^Aa]]++", "o"), (r"[0-9]++", "9")):
        t = F.regexp_replace(t, pattern, sign)
    return words_of(t)


def ngram_buckets(text: Column) -> Column:
    """Buckets of the n-grams; of all words if there are fewer than three, none for none."""

    def buckets(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(s) - N))
        each = F.transform(at, lambda i: F.pmod(F.xxhash64(*(F.get(s, i + j) for j in range(N))), F.lit(BUCKETS)).cast("int"))
        return F.when(F.size(s) > 0, each).otherwise(F.expr("CAST(array() AS array<int>)"))

    return let(shapes(text), buckets)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more."""

    def runs(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twin = lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])
        return F.sort_array(F.filter(F.transform(s, twin), lambda i: i.isNotNull()))

    def windows(w: Column) -> Column:
        h = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        at = F.sequence(F.lit(0), F.size(w) - 3)
        keyed = lambda: F.transform(at, lambda i: F.struct(h(i).alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(F.transform(at, h))) == F.size(w) - 2, F.lit(0)).otherwise(let(let(F.sort_array(keyed()), repeats), runs))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(windows(w))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_counts(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {
        "n_words": F.size(words_of(t)).cast("long"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": repeated_lines(t),
        "n_repeat_words": repeated_words(words_of(t)),
    }


def fit(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Ratio of each bucket. docs: doc_id, text (the raw corpus, all of it counted); trusted: doc_id
    of trusted documents. Ids that are trusted twice count once, null ids are not trusted, rows
    that have one id are trusted together. With no trusted n-gram all ratios are 0."""
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(1))
    grams = docs.select("doc_id", ngram_buckets(F.col("text")).cast("array<short>").alias("buckets"))
    # rows without an id don't meet: they would all go to one task; a task's ids are hashed, so that the wide
    # rows need not be sorted
    marked = grams.where("doc_id IS NOT NULL").join(ids.hint("shuffle_hash"), "doc_id", "left").select("good", "buckets").unionByName(grams.where("doc_id IS NULL").select(F.lit(None).cast("int").alias("good"), "buckets"))
    # outer: else a test of the arrays' size would go below the projection and make them twice
    each = marked.select("good", F.explode_outer("buckets").alias("bucket"))
    rows = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good")).where("bucket IS NOT NULL").collect()  # BUCKETS at most
    raw_n, good_n = sum(r.raw for r in rows), sum(r.good for r in rows)
    out = [0.0] * BUCKETS
    for r in rows:
        if good_n:
            out[r.bucket] = math.log(r.good / good_n + FLOOR) - math.log(r.raw / raw_n + FLOOR)
    return out


def llr_score(text: Column, ratios: list[float]) -> Column:
    """Mean ratio of the n-grams; 0 for a text without a word."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return let(ngram_buckets(text), lambda b: F.when(F.size(b) > 0, total(b) / F.size(b)).otherwise(0.0))


def judge(docs: DataFrame, ratios: list[float], threshold: float = -1.0) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    llr of every row of docs (doc_id, text).

    base_failed: under 50 words, or more than half of them in repeated 3-word windows. kept:
    not base_failed, and llr >= threshold. A null or empty text has zeros and fails; null ids
    and repeated rows come back as they are; an empty table gives an empty one; other columns
    are not carried.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in base_counts(F.col("text")).items()), llr_score(F.col("text"), ratios).alias("llr"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(*columns, failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


def keep(docs: DataFrame, ratios: list[float], threshold: float = -1.0) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, in one pass without a shuffle. Null,
    empty and short texts go; repeated rows stay or go together; null ids are kept like others;
    an empty table gives an empty one; columns may have any names, as only text is read."""
    text = F.col("text")
    counts = base_counts(text)
    n = counts["n_words"]
    return docs.where((n >= LEAST_WORDS) & (100 * counts["n_repeat_words"] <= 50 * n) & (llr_score(text, ratios) >= threshold))
