"""Usage accounting: job totals, cost breakdowns, timelines, attribution, pages, caches, alerts.

Operators take an event table (event_id, job_id, document_id, page_number, operation, model,
input_tokens, output_tokens, credits_used, latency_ms, cache_hit, accuracy, status,
timestamp) or a job table, and return DataFrames. Events of one job are ordered by
timestamp, then event_id. Sums of credits are rounded to six digits.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which rate a page of an operation costs.
PAGE_RATE = {
    "ocr_extraction": "page_ocr",
    "structure_detection": "page_structure",
    "compression_generation": "page_compression",
    "micro_summary_generation": "page_summary",
    "alias_generation": "page_metadata",
    "keyword_generation": "page_metadata",
    "document_parsing": "page_structure",
    "heading_detection": "page_structure",
    "chunk_generation": "page_structure",
}


@dataclass(frozen=True)
class Rates:
    """Credits per page, per 1000 tokens, per upload and its MB, per poll, and the limits beyond which alerts are given."""

    page_ocr: float = 0.12
    page_structure: float = 0.03
    page_compression: float = 0.21
    page_summary: float = 0.04
    page_metadata: float = 0.02
    input_1k: float = 0.01
    output_1k: float = 0.015
    upload: float = 0.05
    upload_mb: float = 0.01
    poll: float = 0.002
    page_limit: float = 1.0
    job_limit: float = 25.0
    retry_limit: float = 5.0

    @classmethod
    def from_env(cls, found: Mapping[str, str] = os.environ) -> Rates:
        """QUIRE_RATE_<NAME> in place of a default; what is no number is left out."""
        out = {}
        for f in fields(cls):
            with contextlib.suppress(KeyError, ValueError):
                out[f.name] = float(found[f"QUIRE_RATE_{f.name.upper()}"])
        return cls(**out)


RATES = Rates()
RETRY_LIMIT = int(RATES.retry_limit)
#: Shares of a page's cost by operation, where only a job's total is known.
PAGE_SHARES = {"ocr_extraction": 0.12, "structure_detection": 0.03, "compression_generation": 0.21, "micro_summary_generation": 0.04, "keyword_generation": 0.02}

def _tokens() -> Column:
    return F.sum(F.col("input_tokens") + F.col("output_tokens"))


def _credits(of: str | Column = "credits_used") -> Column:
    return F.round(F.sum(of), 6)


def accuracy_label(mixed: str = "MIXED", local: str = "LOCAL") -> Column:
    """Aggregate: one label for a group's accuracies."""
    exact, rest = F.bool_or(F.col("accuracy") == "EXACT"), F.bool_or(F.col("accuracy") != "EXACT")
    only_local = F.bool_and(F.col("accuracy") == "LOCAL")
    return F.when(exact & ~rest, "EXACT").when(only_local, local).when(exact, mixed).otherwise("ESTIMATED")


def accuracy_note() -> Column:
    return accuracy_label("MIXED (EXACT + ESTIMATED)", "LOCAL (no API credits)")


def job_totals(events: DataFrame) -> DataFrame:
    """Running totals of each job, as if every event had been added in turn."""
    hit = F.col("cache_hit").cast("int")
    without = F.sum(F.when(~F.col("cache_hit"), F.col("credits_used")).otherwise(0.0))
    return events.groupBy("job_id").agg(
        _credits().alias("total_credits"),
        _tokens().alias("total_tokens"),
        F.sum("latency_ms").alias("total_latency_ms"),
        F.sum(hit).alias("cache_hits"),
        F.sum(1 - hit).alias("cache_misses"),
        accuracy_label().alias("accuracy_mix"),
        F.round(F.greatest(F.lit(0.0), without - F.sum("credits_used")), 6).alias("credits_saved"),
        F.round(F.sum(F.when(F.col("cache_hit"), F.col("credits_used")).otherwise(0.0)), 6).alias("hit_credits"),
        F.min("timestamp").alias("started_at"),
        F.max("timestamp").alias("finished_at"),
    )


def credits_breakdown(events: DataFrame) -> DataFrame:
    """Per job and operation, with the rank by credits (then operation)."""
    by = events.groupBy("job_id", "operation").agg(_credits().alias("credits"), _tokens().alias("tokens"), F.count("*").alias("event_count"), accuracy_label().alias("accuracy"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("credits"), "operation")))


def timeline(events: DataFrame) -> DataFrame:
    """Each event with the credits of its job up to it."""
    upto = Window.partitionBy("job_id").orderBy("timestamp", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select("job_id", "event_id", "timestamp", "operation", "page_number", F.col("credits_used").alias("credits_delta"), F.round(F.sum("credits_used").over(upto), 6).alias("credits_cumulative"), "accuracy", "status")


def reverse_trace(events: DataFrame, credits: float) -> DataFrame:
    """Events, most expensive first, until a job's target is reached: an event counts while
    those before it sum to less."""
    w = Window.partitionBy("job_id").orderBy(F.desc("credits_used"), "timestamp", "event_id")
    before = F.coalesce(F.sum("credits_used").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = events.withColumn("rank", F.row_number().over(w)).withColumn("before", F.round(before, 6))
    return ranked.where(F.col("before") < credits - 1e-9).select("job_id", "event_id", "rank", "page_number", "operation", "credits_used", why(F.col).alias("why"))


def why(col) -> Column:
    """Reason text of an event: operation, input tokens, page, accuracy."""
    return F.concat_ws(
        "; ", col("operation"),
        F.when(col("input_tokens") != 0, F.concat(col("input_tokens").cast("string"), F.lit(" input tokens"))),
        F.when(col("page_number") != 0, F.concat(F.lit("page "), col("page_number").cast("string"))),
        col("accuracy"),
    )


def stage_order(events: DataFrame) -> DataFrame:
    """Operations of each job in the order of their first event."""
    first = events.groupBy("job_id", "operation").agg(F.min(F.struct("timestamp", "event_id")).alias("first"))
    return first.select("job_id", "operation", F.row_number().over(Window.partitionBy("job_id").orderBy("first")).alias("stage"))


def page_stats(events: DataFrame) -> DataFrame:
    """Per job and page, with operation -> credits in a map; pages <= 0 only where a job has no
    other page number."""
    by_op = events.groupBy("job_id", "page_number", "operation").agg(F.sum("credits_used").alias("c"), _tokens().alias("t"), F.bool_or(F.col("accuracy") == "EXACT").alias("e"), F.bool_or(F.col("accuracy") != "EXACT").alias("o"), F.bool_and(F.col("accuracy") == "LOCAL").alias("l"))
    note = F.when(F.bool_or("e") & ~F.bool_or("o"), "EXACT").when(F.bool_and("l"), "LOCAL (no API credits)").when(F.bool_or("e"), "MIXED (EXACT + ESTIMATED)").otherwise("ESTIMATED")
    pages = by_op.groupBy("job_id", "page_number").agg(
        F.round(F.sum("c"), 6).alias("total_credits"),
        F.sum("t").alias("total_tokens"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("operation", F.round("c", 6).alias("c"))))).alias("operations"),
        note.alias("accuracy"),
    )
    n = F.count("*").over(Window.partitionBy("job_id"))
    return pages.withColumn("n", n).where("page_number > 0 OR n = 1").drop("n")


def overview(events: DataFrame) -> DataFrame:
    """Per job: totals, and average, largest and smallest page."""
    pages = page_stats(events).where("page_number > 0")
    by_page = pages.groupBy("job_id").agg(F.count("*").alias("total_pages"), F.max("total_credits").alias("max_credits_page"), F.min("total_credits").alias("min_credits_page"))
    t = job_totals(events).join(by_page, "job_id", "left")
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)
    n = F.coalesce("total_pages", F.lit(0))
    return t.select(
        "job_id", n.alias("total_pages"), "total_credits", "total_tokens",
        F.round(F.col("total_credits") / F.greatest(n, F.lit(1)), 6).alias("average_credits_per_page"),
        F.coalesce("max_credits_page", F.lit(0.0)).alias("max_credits_page"), F.coalesce("min_credits_page", F.lit(0.0)).alias("min_credits_page"),
        format_duration(seconds).alias("total_processing_time"),
    )


def format_duration(seconds: Column) -> Column:
    """'5s', '1m 5s', '1h 1m 5s'."""
    s = F.floor(seconds).cast("long")
    text = lambda x, unit: F.concat(x.cast("string"), F.lit(unit))
    sec, minute = text(s % 60, "s"), text(F.floor(s / 60) % 60, "m ")
    return F.when(s < 60, sec).when(s < 3600, F.concat(minute, sec)).otherwise(F.concat(text(F.floor(s / 3600), "h "), minute, sec))


def synthetic_pages(jobs: DataFrame) -> DataFrame:
    """job_id, page_count, total_credits -> a row per page and operation, the total spread evenly."""
    total = sum(PAGE_SHARES.values())
    shares = F.explode(F.array(*(F.struct(F.lit(k).alias("operation"), F.lit(v / total).alias("share")) for k, v in PAGE_SHARES.items())))
    per = F.col("total_credits") / F.col("page_count")
    rows = jobs.where("page_count > 0 AND total_credits > 0").select("job_id", per.alias("per"), F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_number"))
    return rows.select("job_id", "page_number", F.round("per", 6).alias("total_credits"), "per", shares.alias("s")).select("job_id", "page_number", "total_credits", F.col("s.operation").alias("operation"), F.round(F.col("per") * F.col("s.share"), 6).alias("credits"), F.lit("ESTIMATED_ALLOCATION").alias("accuracy"))


def split_over_pages(stages: DataFrame) -> DataFrame:
    """stage_id, page_start, page_end, credits, tokens, latency_ms -> a row per page; whole numbers
    are divided without rest."""
    n = F.greatest(F.lit(1), F.col("page_end") - F.col("page_start") + 1)
    rows = stages.withColumn("n", n.cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("stage_id", (F.col("page_start") + F.col("i")).alias("page_number"), F.round(F.col("credits") / F.col("n"), 6).alias("credits"), F.expr("tokens div n").alias("tokens"), F.expr("latency_ms div n").alias("latency_ms"))


def credits_from_tokens(operation: Column, pages: Column, input_tokens: Column, output_tokens: Column, rates: Rates = RATES) -> Column:
    rate = F.element_at(F.create_map(*(F.lit(x) for o, name in PAGE_RATE.items() for x in (o, getattr(rates, name)))), operation)
    page = F.coalesce(rate, F.lit(0.0)) * F.greatest(pages, F.lit(1))
    return F.round(page + input_tokens / 1000.0 * rates.input_1k + output_tokens / 1000.0 * rates.output_1k, 6)


def upload_credits(size: Column, rates: Rates = RATES) -> Column:
    return F.round(F.lit(rates.upload) + size / (1024.0 * 1024.0) * rates.upload_mb, 6)


def poll_credits(attempt: Column, rates: Rates = RATES) -> Column:
    return F.round(F.lit(rates.poll) * attempt, 6)


def provider_usage(body: Column) -> Column:
    """struct<credits, input_tokens, output_tokens> of a provider's JSON answer; null without credits.

    The usage object is the first of three keys that holds one, else the body itself; of alternative
    keys the first that is neither missing nor zero counts, else one that says zero: an answer of zero credits is exact."""
    get = lambda *path: F.get_json_object(body, "$." + ".".join(path))
    boxes = ("usage", "credit_usage", "billing")

    def first(names: tuple[str, ...], kind: str) -> Column:
        values = lambda box: [get(*box, n).try_cast(kind) for n in names]
        tried = lambda box: F.coalesce(*(F.nullif(v, F.lit(0).cast(kind)) for v in values(box)), *values(box))
        column = tried(())
        for b in reversed(boxes):
            column = F.when(get(b).startswith("{"), tried((b,))).otherwise(column)
        return column

    credits = first(("credits_used", "credits", "total_credits"), "double")
    tokens = lambda *names: F.coalesce(first(names, "bigint"), F.lit(0))
    found = F.struct(credits.alias("credits"), tokens("input_tokens", "prompt_tokens").alias("input_tokens"), tokens("output_tokens", "completion_tokens").alias("output_tokens"))
    return F.when(credits.isNotNull(), found)


def event_alerts(events: DataFrame, rates: Rates = RATES) -> DataFrame:
    """page_cost_high above the page limit; wasted_credits of failed events."""
    high = events.where(F.col("credits_used") > rates.page_limit).select("job_id", "event_id", F.lit("page_cost_high").alias("alert_type"), F.lit(rates.page_limit).alias("threshold"), F.col("credits_used").alias("actual_value"))
    wasted = events.where((F.col("status") == "failed") & (F.col("credits_used") > 0)).select("job_id", "event_id", F.lit("wasted_credits").alias("alert_type"), F.lit(None).cast("double").alias("threshold"), F.col("credits_used").alias("actual_value"))
    return high.unionByName(wasted)


def job_alerts(jobs: DataFrame, rates: Rates = RATES) -> DataFrame:
    """job_cost_spike above the job limit; retry_explosion from the retry limit on."""
    spike = jobs.where(F.col("total_credits") > rates.job_limit).select("job_id", F.lit("job_cost_spike").alias("alert_type"), F.lit(rates.job_limit).alias("threshold"), F.col("total_credits").alias("actual_value"))
    retry = jobs.where(F.col("retries") >= rates.retry_limit).select("job_id", F.lit("retry_explosion").alias("alert_type"), F.lit(float(rates.retry_limit)).alias("threshold"), F.col("retries").cast("double").alias("actual_value"))
    return spike.unionByName(retry)


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(limit)


def latest_job(jobs: DataFrame) -> DataFrame:
    """document_id -> its job that started last (then the larger id)."""
    return jobs.groupBy("document_id").agg(F.max_by("job_id", F.struct("started_at", "job_id")).alias("job_id"))


def events_of(events: DataFrame, limit: int | None = None, **where) -> DataFrame:
    """Events that equal the given columns, oldest first; with limit, a page of so many at most."""
    for k, v in where.items():
        events = events.where(F.col(k) == v)
    return events.orderBy("timestamp", "event_id") if limit is None else events.orderBy("timestamp", "event_id").limit(limit)


def page_summary(events: DataFrame, **where) -> DataFrame:
    """operation, credits, note of all events that equal the given columns."""
    for k, v in where.items():
        events = events.where(F.col(k) == v)
    return events.groupBy("operation").agg(_credits().alias("credits"), accuracy_note().alias("note"))


def appended(events: DataFrame, new: DataFrame) -> DataFrame:
    """events and those new ones whose event_id they lack, each once."""
    return events.unionByName(new.dropDuplicates(["event_id"]).join(events.select("event_id"), "event_id", "left_anti").select(*events.columns))


def alerts_by_time(events: DataFrame, **where) -> DataFrame:
    """The alerts of events that equal the given columns, with the time of their event, newest first."""
    for k, v in where.items():
        events = events.where(F.col(k) == v)
    timed = event_alerts(events).join(events.select("event_id", F.col("timestamp").alias("created_at")), "event_id")
    return timed.orderBy(F.desc("created_at"), F.desc("event_id"), "alert_type")


def dashboard(events: DataFrame, needle: str, by: str | None = None, descending: bool = False) -> DataFrame:
    """Events whose page, operation, model or accuracy contains the needle, case aside; by: sorted by a
    column, nulls first when ascending, then by event_id."""
    found = events.where(F.lower(F.concat_ws(" ", F.col("page_number").cast("string"), "operation", "model", "accuracy")).contains(needle.lower()))
    return found if by is None else found.orderBy(F.desc(by) if descending else F.asc(by), "event_id")
