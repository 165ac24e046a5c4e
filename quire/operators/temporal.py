"""Joins and windows over positions on a line, such as times in microseconds (extensions).

Positions are long columns. Nothing here compares all pairs, and no key is bound to one task: intervals meet points in
buckets, and long histories of one key are cut by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.shared import materialized


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with every interval that holds them, start <= at < end, of the same keys: the columns of both, whose
    names must differ but for the keys.

    An interval belongs to the level whose buckets are as long as itself or up to four times longer, so it lies in one
    or two of them however long it is; a point looks into its bucket of each level in use (a few dozen at
    most). Empty or unbounded intervals, and points that are null, meet nothing.
    """
    length = F.col(end) - F.col(start)
    level = (F.ceil(F.log2(length.cast("double")) / 2) * 2).cast("int")
    i = intervals.where(length > 0).withColumn("_level", F.when(length == 1, 0).otherwise(level))
    bucket = lambda c: F.call_function("shiftright", c, F.col("_level"))
    i = i.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))))
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())  # 32 at most
    p = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bucket", bucket(F.col(at)))
    return p.join(i, [*keys, "_level", "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bucket")


def range_totals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, key: str, value: str) -> DataFrame:
    """Of each interval (key, start, end) that holds points (at, value), start <= at < end: key, n (points), total (the
    sum of their values, null if all are). Equal to a range_join and a grouping, but pairs, which grow with the product of
    the tables, are never rows: points and ends are sorted in ranges, and an interval's total is what has been summed up
    to its end less what had been up to its start. Sums are decimals to 12 places (values
    below 1e14), so the difference loses nothing; values that are no numbers or infinite are counted apart."""
    x = F.col(value).cast("double")
    odd = {"nan": F.isnan(x), "high": x == float("inf"), "low": x == float("-inf")}
    plain = ~F.coalesce(odd["nan"] | odd["high"] | odd["low"], F.lit(True))
    counts = {"n": F.count("*"), "held": F.count(x), **{k: F.count_if(c) for k, c in odd.items()}, "sum": F.coalesce(F.sum(F.when(plain, x).cast("decimal(26,12)")), F.lit(0))}
    kept = lambda k, c: (c.cast("decimal(36,12)") if k == "sum" else c).alias(k)
    known = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("_pos")).agg(*(kept(k, c) for k, c in counts.items()))
    real = intervals.where(F.col(start) < F.col(end))
    sides = [real.select(F.col(c).alias("_pos"), F.col(key).alias("_key"), F.lit(sign).alias("_sign")) for c, sign in ((start, -1), (end, 1))]
    both = known.withColumn("_sign", F.lit(0)).unionByName(sides[0].unionByName(sides[1]), allowMissingColumns=True)
    order = ["_pos", F.abs("_sign").desc(), "_key"]  # what is at an end comes after it
    placed = both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialized(placed, "ranges").withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy("_range").agg(*(F.sum(k).alias(k) for k in counts))  # a row a range
    ends = ends.select("_range", *(kept(k, F.coalesce(F.sum(k).over(before), F.lit(0))).alias(f"_{k}") for k in counts))
    upto = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("_range", "_key", "_sign", *(kept(k, F.coalesce(F.sum(k).over(upto), F.lit(0))) for k in counts)).where("_sign <> 0").join(ends, "_range")
    less = summed.groupBy(F.col("_key").alias(key)).agg(*(F.sum(F.when(F.col("_sign") < 0, -(F.col(k) + F.col(f"_{k}"))).otherwise(F.col(k) + F.col(f"_{k}"))).alias(k) for k in counts)).where("n > 0")
    nan = (F.col("nan") > 0) | ((F.col("high") > 0) & (F.col("low") > 0))
    total = F.when(nan, float("nan")).when(F.col("high") > 0, float("inf")).when(F.col("low") > 0, float("-inf")).when(F.col("held") > 0, F.col("sum").cast("double"))
    return less.select(key, "n", total.alias("total"))


def overlaps(left: DataFrame, right: DataFrame, of_left: tuple[str, str], of_right: tuple[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of intervals [start, end) that share a position: either starts inside the other. The columns of both."""
    columns = [*keys, *(c for d in (left, right) for c in d.columns if c not in keys)]
    nonempty = lambda d, ends: d.where(F.col(ends[0]) < F.col(ends[1]))
    inside = range_join(nonempty(left, of_left), right, of_left[0], *of_right, keys)
    # equal starts have been met already
    after = range_join(nonempty(right, of_right), left, of_right[0], *of_left, keys).where(F.col(of_right[0]) > F.col(of_left[0]))
    return inside.select(*columns).unionByName(after.select(*columns))


def asof_join(left: DataFrame, right: DataFrame, at: str, right_at: str, keys: tuple[str, ...], width: int, tie: str | None = None) -> DataFrame:
    """Every row of left with the columns of the last row of right (null: none) of its keys that is not later:
    right_at <= at, ties on the right to the largest ``tie``. Keys are compared as in a grouping: null is a key.

    A key's rows are cut into spans of ``width`` positions, which are sorted apart; the last right row of each
    span goes on to the later ones, so a long history is no one task's work but for a row a span.
    """
    own = [c for c in right.columns if c not in keys]
    value = F.struct(*own)
    span = lambda c: F.floor(F.col(c) / width)
    rows = left.select(*keys, span(at).alias("_span"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"), F.struct(*left.columns).alias("_left"))
    others = right.where(F.col(right_at).isNotNull()).select(*keys, span(right_at).alias("_span"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("_tie"), value.alias("_right"))
    both = rows.unionByName(others, allowMissingColumns=True)
    order = ["_at", "_side", "_tie"]
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_found", F.last("_right", True).over(inside))
    spans = both.groupBy(*keys, "_span").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_carried", F.last("_last", True).over(before)).drop("_last")
    same = [seen[k].eqNullSafe(carried[k]) for k in (*keys, "_span")]
    found = seen.where("_side = 1").join(carried, F.expr("true") if not same else same, "left")
    result = F.when(F.col("_at").isNotNull(), F.coalesce("_found", "_carried"))
    return found.select("_left.*", result.alias("_hit")).select(*left.columns, *(F.col(f"_hit.{c}").alias(c) for c in own))


def trailing(rows: DataFrame, at: str, keys: tuple[str, ...], width: int, **measures: Column) -> DataFrame:
    """rows with aggregates over the rows of the same keys in [at - width, at]: a RANGE frame, peers included. A
    key's rows are cut into spans of ``width``; a span gets those of the span before it as well, so that its
    frames are whole. Rows at a null position have null measures."""
    span = F.floor(F.col(at) / width)
    sent = rows.withColumn("_span", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_own", F.col("_span") == 0).withColumn("_span", span + F.col("_span"))
    frame = Window.partitionBy(*keys, "_span").orderBy(at).rangeBetween(-width, 0)
    done = sent.where(F.col(at).isNotNull()).withColumns({k: c.over(frame) for k, c in measures.items()}).where("_own").drop("_span", "_own")
    return done.unionByName(rows.where(F.col(at).isNull()), allowMissingColumns=True)
