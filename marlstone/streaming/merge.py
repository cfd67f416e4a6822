"""Events of several sources merged as they come: the stateful twin of text.merge_events.

A key has one event. Its sources are a map, the rest a value: the first event's id and confidence, the best tier and the
number of sources. Each new source raises the confidence, wherever it comes in; what an event says in the end does not
depend on how its parts were cut into batches. State goes when the watermark is ``keep`` past the end of the key's
period, after which no part of it can come.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, source_count long, max_tier long, confidence double"


def raised(confidence: float | None, sources: int) -> float | None:
    """A confidence after so many sources; each after the first adds a tenth more than the one before, 0.3 at most."""
    if confidence is None:
        return None
    boost = 0.0
    for i in range(1, sources):
        boost += min(i * 0.1, 0.3)
    return min(confidence + boost, 1.0)


class MergeSources(StatefulProcessor):
    def __init__(self, keep: datetime.timedelta):
        self.keep = int(keep.total_seconds() * 1000)

    def init(self, handle):
        self.handle = handle
        self.event = handle.getValueState("event", "first_id long, confidence double, tier long, n long")
        self.sources = handle.getMapState("sources", "source string", "tier long")

    def handleInputRows(self, key, rows, timerValues):
        first, confidence, tier, n = self.event.get() if self.event.exists() else (None, None, None, 0)
        until = 0
        for r in rows:
            if first is None or r.id < first:
                first, confidence = r.id, r.confidence
            if r.tier is not None:
                tier = r.tier if tier is None else min(tier, r.tier)
            if r.source is not None and not self.sources.containsKey((r.source,)):
                self.sources.updateValue((r.source,), (r.tier,))
                n += 1
            until = max(until, int(r.until.timestamp() * 1000))
        self.event.update((first, confidence, tier, n))
        self.handle.registerTimer(until + self.keep)
        yield Row(key=key[0], source_count=n, max_tier=tier, confidence=raised(confidence, n))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.event.clear()
        self.sources.clear()
        return iter(())

    def close(self):
        pass


def period_end(kind, day):
    """When the period of an event's key ends: a quarter for earnings, a day for all else."""
    quarter = F.add_months(F.trunc(day, "quarter"), 3)
    return F.when(kind == "earnings", quarter).otherwise(F.date_add(day, 1)).cast("timestamp")


def merge_stream(events: DataFrame, late: str = "24 hours", keep: datetime.timedelta = datetime.timedelta(hours=24)) -> DataFrame:
    """(key, source_count, max_tier, confidence) of each key that changed, for output in update mode.

    events: key, id, source, tier, confidence, ts and until (period_end). Null sources count as none; ids are not null.
    The session's state store has to be ROCKSDB.
    """
    own = events.select("key", F.col("id").cast("long"), F.col("source").cast("string"), F.col("tier").cast("long"), F.col("confidence").cast("double"), "ts", "until")
    return own.withWatermark("ts", late).groupBy("key").transformWithState(MergeSources(keep), OUTPUT, "Update", "EventTime")
