"""Structured Streaming twins of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Event time becomes a timestamp, as watermarks ask for; the session's time zone is UTC."""
    own = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return own.withColumn("ts", F.col("ts").cast("timestamp"))


def of_groups(events: DataFrame, groups: list[str]) -> DataFrame:
    return events.where(F.col("event_type").isin(groups))


def active_users(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Approximate distinct users of the last day, every hour."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
    return g.agg(F.approx_count_distinct("user_id").alias("n_users"), F.count("*").alias("n")).select("w.start", "w.end", "n_users", "n")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def first_events(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each (user, type) once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def cooldown(events: DataFrame, days: int = 5, late: str = "1 hour", forget: int = 90) -> DataFrame:
    """Switches of each user's regime (event_type): one is let through if the last is at least ``days`` old.

    The state is one row a user: the regime and the day of the last switch; it goes when the watermark is ``forget``
    days past that. A user's events of a trigger are put in order as a whole; a null type is no regime.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    day_ms = 86_400_000

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        regime, day = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).dropna(subset=["event_type"]).sort_values("ts", kind="stable")
        dates = (rows["ts"].astype("int64") // (day_ms * 10**6)).to_numpy() if str(rows["ts"].dtype) == "datetime64[ns]" else rows["ts"].map(lambda t: t.toordinal()).to_numpy()
        out = []
        kinds = rows["event_type"].to_numpy()
        # only rows that differ from the one before can be switches
        for k in [0, *((kinds[1:] != kinds[:-1]).nonzero()[0] + 1)] if len(rows) else []:
            held = k
            while held < len(rows) and kinds[held] == kinds[k]:
                if regime is None or (kinds[held] != regime and dates[held] - day >= days):
                    out.append(held)
                    regime, day = kinds[held], int(dates[held])
                    break
                held += 1
        if regime is not None:
            state.update((regime, day))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(rows["ts"].max().timestamp() * 1000) + forget * day_ms))
        found = rows.iloc[out]
        yield pd.DataFrame({"user_id": [key[0]] * len(out), "ts": found["ts"], "regime": found["event_type"]})

    rows = events.withWatermark("ts", late).select("user_id", "ts", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, ts timestamp, regime string", "regime string, day long", "append", GroupStateTimeout.EventTimeTimeout)


def merge_sources(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Events of a key (key, source, confidence, ts) within a day: how many sources, and the first confidence."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", "24 hours").alias("w"), "key")
    return g.agg(F.approx_count_distinct("source").alias("n_sources"), F.min_by("confidence", "ts").alias("confidence")).select("w.start", "key", "n_sources", "confidence")


def first_batch(frames):
    """The first of some frames that has rows, or the last; each is asked once, as a source is polled."""
    last = None
    for last in frames:
        if not last.isEmpty():
            break
    return last


def on_trading_days(spark: SparkSession, calendar: DataFrame, day, job):
    """Run job() if the day is in the calendar; whether it ran. A timer calls this, as availableNow triggers do."""
    if calendar.where(F.col("trade_date") == F.lit(day)).isEmpty():
        return False
    job()
    return True


def run_once(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Everything available now, as a table in memory."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    (w.option("checkpointLocation", checkpoint) if checkpoint else w).start().awaitTermination()
    return df.sparkSession.table(name)
