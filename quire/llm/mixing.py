"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in SQL functions only.

Each source gets a target number of words. Whole epochs of a source come first;
the rest is filled by weighted sampling without replacement: every document draws
the exponential key -ln(u) / weight, u from a hash of its id, and documents are taken
in order of their keys until the words reach the remainder.

The order is never built for a whole source. The range of its keys is cut into pieces;
word sums of the pieces, added up in order, show the one in which the budget ends, and that
one is cut again, until it holds ``SORTED`` documents at most, which alone are sorted. Where
all keys of a piece are equal it is cut by a hash of the text, then by row, so neither a
weight nor repeated rows can crowd one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD_GAP, id_order, one_row_each, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Pieces that a range is cut into, and documents of one source that are sorted together.
PIECES, SORTED = 1024, 256
#: The order of the documents of a source.
ORDER = ("key", "tie", "row")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    t = F.coalesce(text, F.lit(""))
    return (F.size(F.split(F.concat(F.lit(" "), t, F.lit(" ")), WORD_GAP)) - 2).cast("long")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the share of the text that is neither a symbol, a digit nor a capital letter."""
    t = F.coalesce(text, F.lit(""))
    odd = F.length(t) - F.length(F.translate(t, "#*$%&|<>!0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - odd / F.greatest(F.length(t), F.lit(1)))


def uniform(doc_id: Column) -> Column:
    """In (0, 1): the first 52 bits of the MD5 of the id as text; a null id counts as empty text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: source, n (words). Adds target: share of all words by weight, none above
    ``most`` times its own words, excess reshared by weight. Filling by level: a source is
    full if the level that would fill it (cap / weight) is below the final level."""
    # one row a source: the number of sources bounds this window, not the documents
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    level = sizes.withColumn("w", w).withColumn("cap", F.col("n") * F.lit(most)).withColumn("at", F.col("cap") / F.col("w"))
    rising = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.orderBy(F.desc("at"), F.col("source").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("n").over(total) * F.lit(share)
    # the level, if just this source and those that fill later share what the earlier ones leave
    level = level.withColumn("here", (budget - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))) / F.sum("w").over(above))
    final = F.max(F.when(F.col("here") <= F.col("at"), F.col("here"))).over(total)
    return level.withColumn("final", final).select("source", "n", F.least("cap", F.col("w") * F.coalesce("final", F.lit(float("inf")))).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """The plan of the mix, without texts: doc_id, size, source_size, target, taken of every row of docs (doc_id, text, source).

    taken: words the mix takes of this row, a multiple of size and at most twice it. A null
    or empty text has size 0 and takes 0; a null source is a source, the last one. Keys are
    hashes, so reruns agree; equal keys (repeated rows) are ordered by a hash of text and id, rows
    that agree in both by their place in the table, which changes no row of the result. A
    source without words has target 0. An empty table gives an empty one; other columns are
    not carried.
    """
    return _plan(docs).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def _plan(docs: DataFrame) -> DataFrame:
    """doc_id, th, size, source_size, target, times."""
    text = F.col("text").cast("string")
    source = F.col("source").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("s"),
        word_count(text).alias("size"), (-F.ln(uniform(F.col("doc_id"))) / quality_weight(text)).alias("key"), F.xxhash64("text", "doc_id").alias("tie"), F.monotonically_increasing_id().alias("row"),
    )
    sized = written(sized, "sized")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("n"))
    plan = source_targets(sizes)
    # the sampled part: more than 0 words for sources that aren't taken whole times only
    plan = plan.withColumn("epochs", F.floor(F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(0.0))).withColumn("rest", F.col("target") - F.col("epochs") * F.col("n"))
    plan = written(plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), F.col("n").alias("source_size"), "target", "epochs", "rest"), "plan")
    ends = plan.join(_ends(sized, plan.where("rest > 0")), "s", "left")
    place = F.struct(*ORDER)
    extra = F.when(F.col("upto").isNotNull(), place <= F.col("upto")).otherwise(F.coalesce(place < F.col("low"), F.lit(False)))
    return sized.join(ends, "s").select("doc_id", "th", "size", "source_size", "target", (F.col("epochs") + extra.cast("long")).cast("long").alias("times"))


def _ends(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Of each source of plan (s, rest): the last place in the order that the rest takes (upto, a struct
    of ORDER), or, where upto is null, the first place (low) from which on it takes none."""
    found = sized.select("s", "size", *ORDER).join(plan.select("s", "rest", F.lit(0).cast("long").alias("before")), "s")
    while True:
        ranges = written(found.groupBy("s").agg(F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"), *(f(c).alias(f"{x}_{c}") for c in ORDER for x, f in (("lo", F.min), ("hi", F.max)))), "ranges")
        if (ranges.agg(F.max("n")).first()[0] or 0) <= SORTED:
            break
        cut = found.drop("rest", "before").join(ranges, "s").withColumn("piece", _piece())
        words = cut.groupBy("s", "piece").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        through = F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ending = words.withColumn("through", through).withColumn("short", F.col("through") < F.col("rest"))
        # the first piece that reaches the rest; rounding could leave none, then the last
        last = ending.groupBy("s").agg(F.coalesce(F.min(F.when(~F.col("short"), F.col("piece"))), F.max("piece")).alias("piece"))
        state = ending.join(last, ["s", "piece"]).select("s", "piece", "rest", (F.col("through") - F.col("words")).alias("before"))
        found = written(cut.select("s", "size", *ORDER, "piece").join(state, ["s", "piece"]).drop("piece"), "edge")
    sofar = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the document in which the budget ends is taken if that brings the total nearer
    taken = found.withColumn("taken", sofar + F.col("size") / 2.0 <= F.col("rest"))
    return taken.groupBy("s").agg(F.max(F.when(F.col("taken"), F.struct(*ORDER))).alias("upto"), F.min(F.struct(*ORDER)).alias("low"))


def _piece() -> Column:
    """Number of the piece of a row, by the first of ORDER that differs in its range; never falls as the order rises."""
    out = F.lit(0)
    for c in reversed(ORDER):
        exact = (lambda name: F.col(name)) if c == "key" else (lambda name: F.col(name).cast("decimal(20,0)"))
        share = (exact(c) - exact(f"lo_{c}")).cast("double") / (exact(f"hi_{c}") - exact(f"lo_{c}")).cast("double")
        out = F.when(F.col(f"lo_{c}") < F.col(f"hi_{c}"), F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).cast("int")).otherwise(out)
    return out


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of docs, with all columns, as often as it takes them. A text without
    words, null ones too, is taken as often as its place in the order says; rows that agree in id
    and text come out as often as they are taken together; an empty table gives an empty one;
    columns may have any names, as whole rows are carried."""
    times = _plan(docs).groupBy(id_order().alias("o"), F.col("th").alias("h")).agg(F.sum("times").cast("int").alias("times"))
    taken = one_row_each(docs, times.where(F.col("times") > 0))
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


ORACLE = r"""
    WITH d AS (
        SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
               coalesce(text, '') AS t, (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
    k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, 1 - (length(t) - length(translate(t, '#*$%&|<>!0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::DOUBLE / greatest(length(t), 1)) AS key FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS n, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
    l AS (SELECT *, 2.0 * n AS cap, 2.0 * n / w AS filled, 1.5 * sum(n) OVER () AS budget FROM s),
    h AS (SELECT *, (budget - coalesce((SELECT sum(cap) FROM l b WHERE b.filled < a.filled), 0)) / (SELECT sum(w) FROM l b WHERE b.filled >= a.filled) AS here FROM l a),
    t AS (SELECT source, n, least(cap, w * (SELECT max(here) FROM h WHERE here <= filled))::DOUBLE AS target FROM h),
    p AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM t),
    r AS (SELECT k.*, n, target, epochs, target - epochs * n AS rest,
          coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
    SELECT doc_id, size, n AS source_size, target,
           CAST((epochs + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r"""
