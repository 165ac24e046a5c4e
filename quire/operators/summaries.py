"""Several groupings in one pass, and sketches that are stored and merged (extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import materialized

#: Sizes of the sketches: 2^12 registers (about 1.6 % error of a distinct count), 200 kept values a level (1.3 % of rank).
REGISTERS, KEPT = 12, 200


def grouping_sets(rows: DataFrame, columns: tuple[str, ...], sets: list[tuple[str, ...]], **measures: Column) -> DataFrame:
    """The measures by each set of the columns, in one shuffle (each row is expanded once a set, and partial sums come
    first); level: the bits of the columns that a row is not grouped by."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*(c.alias(k) for k, c in measures.items()), F.grouping_id().alias("level"))


def cube(rows: DataFrame, columns: tuple[str, ...], **measures: Column) -> DataFrame:
    return rows.cube(*columns).agg(*(c.alias(k) for k, c in measures.items()), F.grouping_id().alias("level"))


def rollup(rows: DataFrame, columns: tuple[str, ...], **measures: Column) -> DataFrame:
    return rows.rollup(*columns).agg(*(c.alias(k) for k, c in measures.items()), F.grouping_id().alias("level"))


def sketched(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """by, n, ids (a sketch of the distinct column's values), spread (one of the value's distribution), as a written
    table: what later reports merge instead of reading the rows again. Nulls are in no sketch."""
    made = rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, REGISTERS).alias("ids"), F.kll_sketch_agg_double(F.col(value).cast("double"), KEPT).alias("spread"))
    return materialized(made, "sketches")


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of sketched() by fewer columns: sizes of a sketch don't grow with the rows behind it."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("ids").alias("ids"), F.kll_merge_agg_double("spread").alias("spread"))


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """The columns of sketches but the sketches themselves, distinct (an estimate) and q: values at the quantiles."""
    q = F.array(*(F.kll_sketch_get_quantile_double("spread", F.lit(float(x))) for x in quantiles))
    return sketches.withColumns({"distinct": F.hll_sketch_estimate("ids"), "q": q}).drop("ids", "spread")
