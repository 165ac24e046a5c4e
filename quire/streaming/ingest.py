"""Streams: usage windows, and documents that land in a folder. Extensions: the behaviour this stands
for is polling and resumable batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules as r
from quire.sources.buckets import BucketTable, newest
from quire.sources.shared import folder


def credit_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Credits and events of each operation in windows of event time; events later than ``late`` are dropped
    by a stream. Runs on streams and on tables."""
    e = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    e = e.withWatermark("timestamp", late) if e.isStreaming else e
    by = e.groupBy(F.window("timestamp", width).alias("w"), "operation").agg(F.round(F.sum("credits_used"), 6).alias("credits"), F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operation", "credits", "n")


def job_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a job's events: session windows that a gap closes."""
    e = events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    e = e.withWatermark("timestamp", late) if e.isStreaming else e
    by = e.groupBy(F.session_window("timestamp", gap).alias("w"), "job_id").agg(F.count("*").alias("n"), F.round(F.sum("credits_used"), 6).alias("credits"))
    return by.select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "credits")


def drained(stream: DataFrame, label: str, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """What a stream has given when it has read all there is now: its rows with batch, the number of their micro-batch.
    State, checkpoint and rows stand in the shared folder. conf holds while the stream runs."""
    spark = stream.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        batch = lambda rows, n: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/rows")


def landing_documents(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A stream of JSON documents (doc_id, text, landed), each content once within the watermark."""
    docs = spark.readStream.schema("doc_id string, text string, landed timestamp").json(path)
    return docs.withColumn("content_hash", F.expr(r.content_hash(r.SPARK, "text"))).withWatermark("landed", late).dropDuplicatesWithinWatermark(["content_hash"])


def ingest(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64):
    """Start a query that upserts each micro-batch by doc_id, the latest landing of each, into a table of hash buckets:
    a batch rewrites the buckets of its documents only, and one that is run again changes nothing."""
    spark = stream.sparkSession
    target = BucketTable(spark, table).create(stream.schema, ["doc_id"], buckets)

    def batch(rows: DataFrame, number: int) -> None:
        target.write(rows, newest("landed", "doc_id"), ("ingest", number))
        target.vacuum()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
