"""Usage queries over the events table, and the same in SQL.

An event of the table is one of a job: job = user_id, document = user_id modulo 40, operation =
event_type, credits = value, tokens = props.k split one to two, page = event_id modulo 6,
accuracy and cache hits by event_id, failed if the operation is 'error'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import usage

EVENTS = """SELECT event_id, user_id AS job_id, user_id % 40 AS document_id, CAST(event_id % 6 AS INT) AS page_number, event_type AS operation,
    CASE WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END AS model,
    CAST({k} AS BIGINT) % 37 AS input_tokens, CAST({k} AS BIGINT) AS output_tokens, value AS credits_used, CAST({k} AS BIGINT) * 3 AS latency_ms,
    event_id % 5 = 0 AS cache_hit,
    CASE WHEN user_id % 7 = 0 THEN 'LOCAL' WHEN user_id % 7 = 1 THEN 'EXACT' WHEN event_id % 3 = 0 THEN 'EXACT' ELSE 'ESTIMATED' END AS accuracy,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, ts AS "timestamp" FROM events"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark.read.parquet(f"{sf_dir}/events.parquet"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files."""
    known = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return shaped(spark.readStream.schema(known).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern: one file or a folder


def shaped(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", F.col("user_id").alias("job_id"), (F.col("user_id") % 40).alias("document_id"), (F.col("event_id") % 6).cast("int").alias("page_number"), F.col("event_type").alias("operation"),
        F.when(F.col("event_id") % 2 == 0, "large").otherwise("small").alias("model"), (k % 37).alias("input_tokens"), k.alias("output_tokens"), F.col("value").alias("credits_used"), (k * 3).alias("latency_ms"),
        (F.col("event_id") % 5 == 0).alias("cache_hit"),
        F.when(F.col("user_id") % 7 == 0, "LOCAL").when((F.col("user_id") % 7 == 1) | (F.col("event_id") % 3 == 0), "EXACT").otherwise("ESTIMATED").alias("accuracy"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.col("ts").alias("timestamp"),
    )


def jobs(e: DataFrame) -> DataFrame:
    return usage.job_totals(e).withColumn("document_id", F.col("job_id") % 40).withColumn("page_count", (F.col("job_id") % 5).cast("int")).withColumn("retries", (F.col("job_id") % 9).cast("int"))


def _text_map(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("operations"), lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 100).cast("long").cast("string")))
    return df.withColumn("operations", F.array_join(F.array_sort(pairs), ","))


def _overview(s: SparkSession, d: str) -> DataFrame:
    return usage.overview(events(s, d))


def _other_rates(s: SparkSession, d: str) -> DataFrame:
    """Costs and alerts under rates of one's own; latencies stand for sizes of uploads, page numbers for polls."""
    rates = usage.Rates.from_env({"QUIRE_RATE_PAGE_OCR": "0.5", "QUIRE_RATE_OUTPUT_1K": "0.03", "QUIRE_RATE_PAGE_LIMIT": "50", "QUIRE_RATE_POLL": "none"})
    e = events(s, d)
    high = usage.event_alerts(e, rates).where("alert_type = 'page_cost_high'").select("event_id", F.lit(True).alias("high"))
    kind = F.when(F.col("page_number") == 1, "ocr_extraction").otherwise(F.col("operation"))
    tokens = usage.credits_from_tokens(kind, F.lit(1), F.col("input_tokens"), F.col("output_tokens"), rates)
    costs = e.select("event_id", tokens.alias("tokens"), usage.upload_credits(F.col("latency_ms") * 1000, rates).alias("upload"), usage.poll_credits(F.col("page_number"), rates).alias("polls"))
    return costs.join(high, "event_id", "left").withColumn("high", F.coalesce("high", F.lit(False)))


QUERIES = {
    "usage_job_totals": lambda s, d: usage.job_totals(events(s, d)),
    "usage_credits_breakdown": lambda s, d: usage.credits_breakdown(events(s, d)),
    "usage_timeline": lambda s, d: usage.timeline(events(s, d)),
    "usage_reverse_trace": lambda s, d: usage.reverse_trace(events(s, d), 500.0),
    "usage_stage_order": lambda s, d: usage.stage_order(events(s, d)),
    "usage_page_stats": lambda s, d: _text_map(usage.page_stats(events(s, d))),
    "usage_overview": _overview,
    "usage_synthetic_pages": lambda s, d: usage.synthetic_pages(jobs(events(s, d))),
    "usage_split_over_pages": lambda s, d: usage.split_over_pages(events(s, d).select(F.col("event_id").alias("stage_id"), "page_number", F.col("page_number").alias("page_start"), (F.col("page_number") + F.col("event_id") % 4).alias("page_end"), F.col("credits_used").alias("credits"), F.col("output_tokens").alias("tokens"), "latency_ms").drop("page_number")),
    "usage_other_rates": lambda s, d: _other_rates(s, d),
    "usage_pricing": lambda s, d: events(s, d).select("event_id", usage.credits_from_tokens(F.when(F.col("page_number") == 1, "ocr_extraction").when(F.col("page_number") == 2, "keyword_generation").otherwise(F.col("operation")), F.col("page_number"), F.col("input_tokens"), F.col("output_tokens")).alias("token_credits"), usage.upload_credits(F.col("event_id") * 1000).alias("upload_credits"), usage.poll_credits(F.col("page_number")).alias("poll_credits")),
    "usage_provider_answer": lambda s, d: _provider(s, d),
    "usage_event_alerts": lambda s, d: usage.event_alerts(events(s, d)),
    "usage_job_alerts": lambda s, d: usage.job_alerts(jobs(events(s, d))),
    "usage_recent_jobs": lambda s, d: usage.recent_jobs(jobs(events(s, d))).select("job_id", "started_at", "total_credits"),
    "usage_latest_job": lambda s, d: usage.latest_job(jobs(events(s, d))),
    "usage_events_of_job": lambda s, d: usage.events_of(events(s, d), 5000, job_id=8).select("event_id", "operation", "credits_used", "timestamp"),
    "usage_dashboard": lambda s, d: usage.dashboard(events(s, d), "click large").select("event_id", "page_number", "operation", "model", "accuracy"),
    "usage_dashboard_sorted": lambda s, d: usage.dashboard(events(s, d), "view", "latency_ms", True).select("event_id", "operation", "latency_ms"),
    "usage_page_summary": lambda s, d: usage.page_summary(events(s, d), document_id=8, page_number=3),
    "usage_appended": lambda s, d: usage.appended(events(s, d).where("event_id % 3 > 0"), events(s, d).where("event_id % 2 = 0")).select("event_id", "operation"),
    "usage_alerts_by_time": lambda s, d: usage.alerts_by_time(events(s, d)).select("event_id", "alert_type", "created_at"),
}


def _provider(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    v, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    body = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"usage": {"credits_used": 0, "credits": '), v, F.lit(', "prompt_tokens": '), k, F.lit("}}")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"billing": {"total_credits": '), v, F.lit(', "input_tokens": '), k, F.lit(', "output_tokens": 7}}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"credits": '), v, F.lit(', "completion_tokens": '), k, F.lit("}")))
        .otherwise(F.lit('{"usage": {"input_tokens": 3}}'))
    )
    return e.select("event_id", usage.provider_usage(body).alias("u")).select("event_id", "u.credits", "u.input_tokens", "u.output_tokens")


_E = EVENTS.format(k="(props->>'$.k')")
_WITH = f"WITH e AS ({_E}) "
_LABEL = "CASE WHEN bool_and(accuracy = 'EXACT') THEN 'EXACT' WHEN bool_and(accuracy = 'LOCAL') THEN '{}' WHEN bool_or(accuracy = 'EXACT') THEN '{}' ELSE 'ESTIMATED' END"
_SHORT, _LONG = _LABEL.format("LOCAL", "MIXED"), _LABEL.format("LOCAL (no API credits)", "MIXED (EXACT + ESTIMATED)")
_JOBS = f""", j AS (SELECT job_id, round(sum(credits_used), 6) AS total_credits, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms,
    count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses, {_SHORT} AS accuracy_mix,
    round(greatest(0.0, coalesce(sum(credits_used) FILTER (NOT cache_hit), 0) - sum(credits_used)), 6)::DOUBLE AS credits_saved, round(coalesce(sum(credits_used) FILTER (cache_hit), 0), 6) AS hit_credits,
    min("timestamp") AS started_at, max("timestamp") AS finished_at FROM e GROUP BY job_id) """
_PAGES = f""", o AS (SELECT job_id, page_number, operation, sum(credits_used) AS c FROM e GROUP BY ALL),
    p AS (SELECT job_id, page_number, round(sum(credits_used), 6) AS total_credits, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, {_LONG} AS accuracy FROM e GROUP BY job_id, page_number),
    m AS (SELECT job_id, page_number, string_agg(operation || '=' || CAST(round(c * 100) AS BIGINT), ',' ORDER BY operation) AS operations FROM o GROUP BY ALL),
    s AS (SELECT p.*, operations, count(*) OVER (PARTITION BY job_id) AS n FROM p JOIN m USING (job_id, page_number)) """

ORACLE_SQL = {
    "usage_job_totals": _WITH + _JOBS + "SELECT * FROM j",
    "usage_credits_breakdown": _WITH + f"SELECT job_id, operation, round(sum(credits_used), 6) AS credits, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens, count(*) AS event_count, {_SHORT} AS accuracy, CAST(row_number() OVER (PARTITION BY job_id ORDER BY round(sum(credits_used), 6) DESC, operation) AS INT) AS rank FROM e GROUP BY job_id, operation",
    "usage_timeline": _WITH + 'SELECT job_id, event_id, "timestamp", operation, page_number, credits_used AS credits_delta, round(sum(credits_used) OVER (PARTITION BY job_id ORDER BY "timestamp", event_id ROWS UNBOUNDED PRECEDING), 6) AS credits_cumulative, accuracy, status FROM e',
    "usage_reverse_trace": _WITH + """, r AS (SELECT *, CAST(row_number() OVER w AS INT) AS rank, coalesce(sum(credits_used) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WINDOW w AS (PARTITION BY job_id ORDER BY credits_used DESC, "timestamp", event_id))
        SELECT job_id, event_id, rank, page_number, operation, credits_used, concat_ws('; ', operation, CASE WHEN input_tokens <> 0 THEN input_tokens || ' input tokens' END, CASE WHEN page_number <> 0 THEN 'page ' || page_number END, accuracy) AS why FROM r WHERE round(before, 6) < 500 - 1e-9""",
    "usage_stage_order": _WITH + ', f AS (SELECT job_id, operation, min(("timestamp", event_id)) AS first FROM e GROUP BY ALL) SELECT job_id, operation, CAST(row_number() OVER (PARTITION BY job_id ORDER BY first) AS INT) AS stage FROM f',
    "usage_page_stats": _WITH + _PAGES + "SELECT job_id, page_number, total_credits, total_tokens, operations, accuracy FROM s WHERE page_number > 0 OR n = 1",
    "usage_overview": _WITH + _JOBS + _PAGES + """, g AS (SELECT job_id, count(*) AS n, max(total_credits) AS mx, min(total_credits) AS mn FROM s WHERE page_number > 0 GROUP BY job_id),
        t AS (SELECT j.*, coalesce(n, 0) AS total_pages, mx, mn, CAST(floor(epoch_us(finished_at) / 1e6 - epoch_us(started_at) / 1e6) AS BIGINT) AS x, (epoch_us(finished_at) - epoch_us(started_at)) // 1000000 AS sec FROM j LEFT JOIN g USING (job_id))
        SELECT job_id, total_pages, total_credits, total_tokens, round(total_credits / greatest(total_pages, 1), 6) AS average_credits_per_page, coalesce(mx, 0) AS max_credits_page, coalesce(mn, 0) AS min_credits_page,
        CASE WHEN sec < 60 THEN sec || 's' WHEN sec < 3600 THEN (sec // 60) || 'm ' || (sec % 60) || 's' ELSE (sec // 3600) || 'h ' || (sec // 60 % 60) || 'm ' || (sec % 60) || 's' END AS total_processing_time FROM t""",
    "usage_synthetic_pages": _WITH + _JOBS + """, r AS (SELECT job_id, total_credits / (job_id % 5) AS per, CAST(unnest(range(1, job_id % 5 + 1)) AS INT) AS page_number FROM j WHERE job_id % 5 > 0 AND total_credits > 0)
        SELECT job_id, page_number, round(per, 6) AS total_credits, operation, round(per * share / 0.42::DOUBLE, 6) AS credits, 'ESTIMATED_ALLOCATION' AS accuracy FROM r, (VALUES ('ocr_extraction', 0.12::DOUBLE), ('structure_detection', 0.03::DOUBLE), ('compression_generation', 0.21::DOUBLE), ('micro_summary_generation', 0.04::DOUBLE), ('keyword_generation', 0.02::DOUBLE)) v(operation, share)""",
    "usage_split_over_pages": _WITH + "SELECT event_id AS stage_id, page_number + unnest(range(0, event_id % 4 + 1)) AS page_number, round(credits_used / (event_id % 4 + 1), 6) AS credits, output_tokens // (event_id % 4 + 1) AS tokens, latency_ms // (event_id % 4 + 1) AS latency_ms FROM e",
    "usage_other_rates": _WITH + "SELECT event_id, round(CASE operation WHEN 'ocr_extraction' THEN 0.5::DOUBLE ELSE 0::DOUBLE END + input_tokens / 1000.0::DOUBLE * 0.01::DOUBLE + output_tokens / 1000.0::DOUBLE * 0.03::DOUBLE, 6) AS tokens, round(0.05::DOUBLE + latency_ms * 1000.0::DOUBLE / 1048576.0::DOUBLE * 0.01::DOUBLE, 6) AS upload, round(0.002::DOUBLE * page_number, 6) AS polls, credits_used > 50 AS high FROM (SELECT * REPLACE (CASE page_number WHEN 1 THEN 'ocr_extraction' ELSE operation END AS operation) FROM e)",
    "usage_pricing": _WITH + "SELECT event_id, round(CASE page_number WHEN 1 THEN 0.12::DOUBLE WHEN 2 THEN 0.02::DOUBLE ELSE 0::DOUBLE END * greatest(page_number, 1) + input_tokens / 1000.0::DOUBLE * 0.01::DOUBLE + output_tokens / 1000.0::DOUBLE * 0.015::DOUBLE, 6) AS token_credits, round(0.05::DOUBLE + event_id * 1000 / 1048576.0::DOUBLE * 0.01::DOUBLE, 6) AS upload_credits, round(0.002::DOUBLE * page_number, 6) AS poll_credits FROM e",
    "usage_provider_answer": "WITH k AS (SELECT event_id, value, CAST(props->>'$.k' AS BIGINT) AS k, event_id % 4 AS r FROM events) SELECT event_id, CASE WHEN r < 3 THEN value END AS credits, CASE r WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN 0 END AS input_tokens, CASE r WHEN 0 THEN 0 WHEN 1 THEN 7 WHEN 2 THEN k END AS output_tokens FROM k",
    "usage_event_alerts": _WITH + "SELECT job_id, event_id, 'page_cost_high' AS alert_type, 1.0::DOUBLE AS threshold, credits_used AS actual_value FROM e WHERE credits_used > 1 UNION ALL SELECT job_id, event_id, 'wasted_credits', NULL, credits_used FROM e WHERE status = 'failed' AND credits_used > 0",
    "usage_job_alerts": _WITH + _JOBS + "SELECT job_id, 'job_cost_spike' AS alert_type, 25.0::DOUBLE AS threshold, total_credits AS actual_value FROM j WHERE total_credits > 25 UNION ALL SELECT job_id, 'retry_explosion', 5.0, (job_id % 9)::DOUBLE FROM j WHERE job_id % 9 >= 5",
    "usage_recent_jobs": _WITH + _JOBS + "SELECT job_id, started_at, total_credits FROM j ORDER BY started_at DESC, job_id LIMIT 20",
    "usage_latest_job": _WITH + _JOBS + "SELECT job_id % 40 AS document_id, arg_max(job_id, (started_at, job_id)) AS job_id FROM j GROUP BY 1",
    "usage_events_of_job": _WITH + 'SELECT event_id, operation, credits_used, "timestamp" FROM e WHERE job_id = 8 ORDER BY "timestamp", event_id LIMIT 5000',
    "usage_dashboard": _WITH + "SELECT event_id, page_number, operation, model, accuracy FROM e WHERE operation = 'click' AND model = 'large'",
    "usage_dashboard_sorted": _WITH + "SELECT event_id, operation, latency_ms FROM e WHERE contains(lower(concat_ws(' ', page_number, operation, model, accuracy)), 'view') ORDER BY latency_ms DESC, event_id",
    "usage_appended": _WITH + "SELECT event_id, operation FROM e WHERE event_id % 3 > 0 OR event_id % 2 = 0",
    "usage_alerts_by_time": _WITH + "SELECT event_id, unnest(CASE WHEN credits_used > 1 THEN ['page_cost_high'] ELSE [] END || CASE WHEN status = 'failed' AND credits_used > 0 THEN ['wasted_credits'] ELSE [] END) AS alert_type, \"timestamp\" AS created_at FROM e",
    "usage_page_summary": _WITH + f'SELECT operation, round(sum(credits_used), 6) AS credits, {_LONG} AS note FROM e WHERE document_id = 8 AND page_number = 3 GROUP BY operation',
}
