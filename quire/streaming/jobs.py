"""Running totals and retry alerts of jobs, from a stream of usage events with late and repeated rows.

Each job keeps a state of its own: the ids of its events inside the watermark, its totals, whether it has alerted.
An event that is seen again adds nothing; one that is later than the watermark allows is dropped before it comes here
(the query's progress counts those). A restart from the checkpoint goes on with the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.usage import RETRY_LIMIT

#: Of each job and batch: what was counted so far; alert: set once.
TOTALS = "job_id string, events long, credits_nano long, retries long, alert string"
#: The store that keeps several states of a key.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Ids that one row of a job's state holds, at most, and a time before all others.
PAGE, NEVER = 4096, -(1 << 62)


class JobTotals(StatefulProcessor):
    """Totals (events, credits in billionths, retries, alerted) and the ids seen, with the time of each in milliseconds.
    Credits are whole numbers of billionths, so a sum doesn't depend on the order of batches.

    A call to the state costs far more than an id, so ids stand in pages: rows of up to PAGE ids, read one after another for a
    batch of events. An id whose time was before the watermark of the job's last batch (swept) is no longer seen; its page
    goes when all of it is."""

    def __init__(self, limit: int = RETRY_LIMIT):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "events long, credits_nano long, retries long, alerted boolean, swept long")
        self.seen = handle.getListState("seen", "ids array<string>, times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        known = self.totals.get()
        events, credits, retries, alerted, swept = known or (0, 0, 0, False, NEVER)
        watermark = timer.getCurrentWatermarkInMs()
        paged, old = known is not None, False
        for batch in rows:
            new: dict[str, tuple[int, int, int]] = {}
            for event_id, *told in zip(*(batch[c].tolist() for c in ("event_id", "ms", "credits_nano", "retry")), strict=True):
                new.setdefault(event_id, told)
            for ids, times in self.seen.get() if paged else ():
                old = old or max(times) < watermark
                for event_id, ms in zip(ids, times, strict=True):
                    if ms >= swept:
                        new.pop(event_id, None)
            events, credits, retries = events + len(new), credits + sum(x[1] for x in new.values()), retries + sum(x[2] for x in new.values())
            listed, times = list(new), [x[0] for x in new.values()]
            for at in range(0, len(new), PAGE):
                self.seen.appendValue((listed[at : at + PAGE], times[at : at + PAGE]))
                paged, old = True, old or max(times[at : at + PAGE]) < watermark
        if old:  # what repeats these ids from now on is dropped
            kept = [p for p in self.seen.get() if max(p[1]) >= watermark]
            self.seen.put(kept) if kept else self.seen.clear()
        alert = "retry_explosion" if retries >= self.limit and not alerted else None
        self.totals.update((events, credits, retries, alerted or alert is not None, watermark))
        yield pd.DataFrame({"job_id": [key[0]], "events": [events], "credits_nano": [credits], "retries": [retries], "alert": [alert]})

    def close(self) -> None:
        pass


def job_totals(events: DataFrame, late: str = "10 minutes", limit: int = RETRY_LIMIT) -> DataFrame:
    """events: a stream of event_id, job_id, timestamp, credits_used, status. A row of TOTALS for each job of each
    micro-batch; retries are failed events. Null ids are the empty text, null credits count 0; rows without a time
    are dropped (a watermark can't place them)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    nano = F.coalesce(F.round(F.col("credits_used") * 1e9), F.lit(0)).cast("long")
    retry = F.coalesce(F.col("status") == "failed", F.lit(False)).cast("int")
    e = events.select(text("event_id"), text("job_id"), F.col("timestamp").cast("timestamp").alias("timestamp"), nano.alias("credits_nano"), retry.alias("retry")).where("timestamp IS NOT NULL")
    e = e.withColumn("ms", F.unix_millis("timestamp")).withWatermark("timestamp", late)
    return e.groupBy("job_id").transformWithStateInPandas(JobTotals(limit), TOTALS, "Append", "EventTime")
