"""Distinct users of trailing windows from hourly sketches.

Every event is read once, into the HyperLogLog sketch of its hour. A window is the union of the sketches of its hours,
so that windows cost rows by hours and not by events, and late events are one more sketch of an old hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.loads import Ledger, loaded

#: Two to this many registers; the standard error of a sketch is 1.04 over their root, here 1.6 %.
PRECISION = 12


def error(precision: int = PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def hourly(events: DataFrame, user: str = "user_id", ts: str = "ts", precision: int = PRECISION) -> DataFrame:
    """(hour, sketch, n) of events; null users are in n alone, events without a time in none."""
    own = events.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("hour", ts).alias("hour"))
    return own.agg(F.hll_sketch_agg(user, precision).alias("sketch"), F.count("*").alias("n"))


def trailing(sketches: DataFrame, hours: int = 24) -> DataFrame:
    """(end, n_users, n) of every window of so many hours that holds an event; any number of sketches an hour."""
    step = F.expr("interval 1 hour")
    ends = F.sequence(F.col("hour") + step, F.col("hour") + F.expr(f"interval {hours} hour"), step)
    each = sketches.groupBy("hour").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))
    spread = each.select("sketch", "n", F.explode(ends).alias("end"))
    return spread.groupBy("end").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_users"), F.sum("n").alias("n"))


def keep(batch: DataFrame, number: int, path: str) -> None:
    """Add a batch's sketches to a load; one that is delivered again changes nothing."""
    ledger = Ledger(batch.sparkSession, path)
    if number not in ledger.batches():
        hourly(batch).write.mode("overwrite").parquet(f"{path}/data/batch={number}")
        ledger.commit(number, {})


def sketch_stream(events: DataFrame, path: str, checkpoint: str):
    """The writer of a stream of events into hourly sketches; no state, and no event is too late."""
    return events.writeStream.foreachBatch(lambda batch, k: keep(batch, k, path)).option("checkpointLocation", checkpoint)


def users_now(spark: SparkSession, path: str, hours: int = 24) -> DataFrame:
    """trailing() of all that is loaded."""
    return trailing(loaded(spark, path), hours)
