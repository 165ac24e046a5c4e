"""Range, as-of and interval joins, time frames, grouping sets and sketches over events and customers, and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import summaries, temporal

MINUTE, DAY = 60_000_000, 86_400_000_000


def events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").withColumn("at", temporal.micros(F.col("ts")))


def spans(s: SparkSession, d: str, kind: str, prefix: str) -> DataFrame:
    """Events of a kind as intervals, a minute for each unit of their value."""
    e = events(s, d).where(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("at").alias(f"{prefix}_from"), (F.col("at") + F.floor("value") * MINUTE).alias(f"{prefix}_to"))


def _range(s: SparkSession, d: str) -> DataFrame:
    """Of each error, what happens while it lasts, whoever does it."""
    totals = temporal.range_totals(events(s, d).select("at", "value"), spans(s, d, "error", "error"), "at", "error_from", "error_to", "error_id", "value")
    return totals.select("error_id", "n", F.round("total", 4).alias("total"))


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    pairs = temporal.overlaps(spans(s, d, "error", "error"), spans(s, d, "purchase", "sale"), ("error_from", "error_to"), ("sale_from", "sale_to"), ("user_id",))
    return pairs.select("user_id", "error_id", "sale_id")


def _asof(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("at").alias("viewed"))
    found = temporal.asof_join(e.where("event_type = 'error'").select("user_id", "event_id", "at"), views, "at", "viewed", ("user_id",), 3 * DAY, "view_id")
    return found.select("event_id", "view_id", (F.col("at") - F.col("viewed")).alias("since"))


def _trailing(s: SparkSession, d: str) -> DataFrame:
    found = temporal.trailing(events(s, d).select("user_id", "event_id", "at", "value"), "at", ("user_id",), DAY, n=F.count("*"), total=F.sum("value"), most=F.max("value"))
    return found.select("event_id", "n", F.round("total", 4).alias("total"), "most")


def _customers(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")



def _sets(s: SparkSession, d: str) -> DataFrame:
    columns = ("n_regionkey", "c_nationkey", "c_mktsegment")
    sets = [("n_regionkey", "c_mktsegment"), ("c_nationkey",), ()]
    return summaries.grouping_sets(_customers(s, d), columns, sets, n=F.count("*"), balance=F.round(F.sum("c_acctbal"), 2))


def _cube(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("day", F.dayofmonth("ts"))
    return summaries.cube(e, ("event_type", "day"), n=F.count("*"), total=F.round(F.sum("value"), 4), most=F.max("value"))


def _rollup(s: SparkSession, d: str) -> DataFrame:
    return summaries.rollup(_customers(s, d), ("n_regionkey", "c_nationkey", "c_mktsegment"), n=F.count("*"), balance=F.round(F.sum("c_acctbal"), 2))


def _sketched(s: SparkSession, d: str) -> DataFrame:
    """Daily sketches merged by kind, against exact counts of the same rows: whether the distinct count is within 5 %
    and the share of values up to the median and the ninth decile within 3 points; and whether a sketch of the whole
    counts what the merged ones do, within 5 % (the two use different estimators of the same registers)."""
    e = events(s, d).withColumn("day", F.dayofmonth("ts"))
    daily = summaries.sketched(e, ["event_type", "day"], "event_id", "value")
    whole = summaries.merged(summaries.sketched(e, ["event_type"], "event_id", "value"), ["event_type"])
    got = summaries.estimates(summaries.merged(daily, ["event_type"]), (0.5, 0.9)).withColumnRenamed("n", "rows")
    at_once = summaries.estimates(whole).select("event_type", F.col("distinct").alias("at_once"))
    share = lambda i: F.avg((F.col("value") <= F.get("q", F.lit(i))).cast("double"))
    exact = e.join(F.broadcast(got), "event_type").groupBy("event_type", "rows", "distinct").agg(F.count_distinct("event_id").alias("ids"), share(0).alias("half"), share(1).alias("most"))  # a row a kind
    near = (F.abs(F.col("distinct") - F.col("ids")) <= 0.05 * F.col("ids")).alias("distinct_near")
    ranks = ((F.abs(F.col("half") - 0.5) <= 0.03) & (F.abs(F.col("most") - 0.9) <= 0.03)).alias("quantiles_near")
    return exact.join(at_once, "event_type").select("event_type", F.col("rows").alias("n"), "ids", near, ranks, (F.abs(F.col("distinct") - F.col("at_once")) <= 0.05 * F.col("ids")).alias("merge_near"))


QUERIES = {
    "join_range": _range,
    "join_overlaps": _overlaps,
    "join_asof": _asof,
    "window_trailing_day": _trailing,
    "agg_grouping_sets": _sets,
    "agg_cube": _cube,
    "agg_rollup": _rollup,
    "agg_sketches": _sketched,
}
_E = "e AS (SELECT *, epoch_us(ts) AS pos FROM events)"
_SPANS = f"{_E}, x AS (SELECT user_id, event_id AS error_id, pos AS f, pos + CAST(floor(value) AS BIGINT) * {MINUTE} AS u FROM e WHERE event_type = 'error')"
_CUSTOMERS = "c AS (SELECT * FROM customer JOIN nation ON n_nationkey = c_nationkey)"
ORACLE_SQL = {
    "join_range": f"WITH {_SPANS} SELECT error_id, count(*) AS n, round(sum(value), 4) AS total FROM x JOIN e ON e.pos >= f AND e.pos < u GROUP BY error_id",
    "join_overlaps": f"WITH {_SPANS}, y AS (SELECT user_id, event_id AS sale_id, pos AS g, pos + CAST(floor(value) AS BIGINT) * {MINUTE} AS v FROM e WHERE event_type = 'purchase') SELECT user_id, error_id, sale_id FROM x JOIN y USING (user_id) WHERE f < v AND g < u AND f < u AND g < v",
    "join_asof": f"WITH {_E} SELECT a.event_id, b.event_id AS view_id, a.pos - b.pos AS since FROM (SELECT * FROM e WHERE event_type = 'error') a ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.pos >= b.pos",
    "window_trailing_day": f"WITH {_E} SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS most FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)",
    "agg_grouping_sets": f"WITH {_CUSTOMERS} SELECT n_regionkey, c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, grouping(n_regionkey, c_nationkey, c_mktsegment) AS level FROM c GROUP BY GROUPING SETS ((n_regionkey, c_mktsegment), (c_nationkey), ())",
    "agg_cube": "SELECT event_type, CAST(dayofmonth(ts) AS INT) AS day, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most, grouping(event_type, dayofmonth(ts)) AS level FROM events GROUP BY CUBE (event_type, dayofmonth(ts))",
    "agg_rollup": f"WITH {_CUSTOMERS} SELECT n_regionkey, c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, grouping(n_regionkey, c_nationkey, c_mktsegment) AS level FROM c GROUP BY ROLLUP (n_regionkey, c_nationkey, c_mktsegment)",
    "agg_sketches": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, true AS distinct_near, true AS quantiles_near, true AS merge_near FROM events GROUP BY event_type",
}
