"""Queries whose twins are streams: group messages, increments past marks, users of trailing windows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from marlstone.operators import sketches
from marlstone.registry import query
from marlstone.sources.loads import past_marks
from marlstone.sources.messages import first_poll

from .views import BARS, bars, table

R = lambda c, n=6: F.round(c, n)

GROUPS = (3, 7, 11)
_MSG = f"m AS (SELECT event_id, user_id % 40 AS group_id, user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS poll FROM events), w AS (SELECT * FROM m WHERE group_id IN {GROUPS})"


def messages(spark, sf_dir):
    """Events as messages of forty groups, polled every hour."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("group_id"), "user_id", F.date_trunc("hour", "ts").alias("poll"))


@query("first_messages", f"WITH {_MSG} SELECT event_id, group_id, user_id FROM w WHERE poll = (SELECT min(poll) FROM w)")
def first_messages(spark, sf_dir):
    """What a collector of three groups gives: the messages of the first poll that has any of theirs."""
    wanted = messages(spark, sf_dir).where(F.col("group_id").isin(*GROUPS))
    return first_poll(wanted).select("event_id", "group_id", "user_id")


_NO = "CAST(substr(ticker, 7) AS INTEGER)"
TARGET = datetime.date(1999, 6, 30)


@query("load_increments", f"WITH {BARS}, marks AS (SELECT ticker, max(date) AS last FROM bars WHERE date <= DATE '1996-01-01' + {_NO} * 20 AND {_NO} % 4 <> 0 GROUP BY ticker) SELECT b.ticker, date, round(close, 6) AS close FROM bars b LEFT JOIN marks m ON m.ticker = b.ticker WHERE date <= DATE '{TARGET}' AND (last IS NULL OR date > last)")
def load_increments(spark, sf_dir):
    """The bars that an incremental load adds: past each brand's newest stored day, all of brands that have none."""
    own = bars(spark, sf_dir)
    no = F.substring("ticker", 7, 9).cast("int")
    stored = own.where((F.col("date") <= F.date_add(F.lit(datetime.date(1996, 1, 1)), no * 20)) & (no % 4 != 0))
    marks = stored.groupBy("ticker").agg(F.max("date").alias("last"))
    return past_marks(own, marks, target=TARGET).select("ticker", "date", R("close").alias("close"))


_HOUR = 'date_trunc(\'hour\', ts)'


@query("active_users_sketch", f"WITH h AS (SELECT DISTINCT {_HOUR} AS hour, user_id FROM events), c AS (SELECT {_HOUR} AS hour, count(*) AS n FROM events GROUP BY 1), w AS (SELECT hour + INTERVAL 1 HOUR * k AS end_, user_id FROM h, (SELECT unnest(range(1, 25)) AS k)), x AS (SELECT hour + INTERVAL 1 HOUR * k AS end_, n FROM c, (SELECT unnest(range(1, 25)) AS k)), u AS (SELECT end_, count(DISTINCT user_id) AS users FROM w GROUP BY 1), m AS (SELECT end_, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1) SELECT strftime(u.end_, '%Y-%m-%d %H') AS hour, n, users, true AS near FROM u JOIN m ON m.end_ = u.end_")
def active_users_sketch(spark, sf_dir):
    """Users of the last day at every hour: events counted, users exactly, and whether the sketches are near that.

    Near is within four standard errors, and one user where there are few.
    """
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = sketches.trailing(sketches.hourly(e))
    step = F.expr("interval 1 hour")
    hour = F.date_trunc("hour", "ts")
    exact = e.select(hour.alias("hour"), "user_id").distinct().select("user_id", F.explode(F.sequence(F.col("hour") + step, F.col("hour") + F.expr("interval 24 hour"), step)).alias("end"))
    exact = exact.groupBy("end").agg(F.count_distinct("user_id").alias("users"))
    near = F.abs(F.col("n_users") - F.col("users")) <= F.greatest(F.lit(1.0), 4 * sketches.error() * F.col("users"))
    return found.join(exact, "end").select(F.date_format("end", "yyyy-MM-dd HH").alias("hour"), "n", "users", near.alias("near"))
