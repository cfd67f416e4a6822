"""As-of joins, calendar alignment and filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.rolling import series


def asof_join(left: DataFrame, right: DataFrame, values: list[str], *, key: str = "ticker", on: str = "date", right_on: str = "report_date") -> DataFrame:
    """left with, of each value, the last one known at each row's date (the same day included), column by column.

    One union and one window: both sides meet sorted by key and date, whatever their sizes.
    """
    l = left.withColumn("_side", F.lit(1))
    r = right.select(key, F.col(right_on).alias(on), *values).withColumn("_side", F.lit(0))
    both = l.drop(*values).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in values}).where("_side = 1").drop("_side")


def ffill(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Nulls take the last value of at most ``limit`` rows before."""
    start = Window.unboundedPreceding if limit is None else -limit
    return df.withColumns({c: F.last(c, ignorenulls=True).over(series().rowsBetween(start, 0)) for c in columns})


def bfill(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    end = Window.unboundedFollowing if limit is None else limit
    return df.withColumns({c: F.first(c, ignorenulls=True).over(series().rowsBetween(0, end)) for c in columns})


def interpolate(df: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """Nulls between two values lie on the line between them, by days; ``limit`` rows in a row from the first value on.
    Those after the last value take it, as far as the limit goes."""
    w = series()
    known = F.col(column).isNotNull()
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    own = df.withColumn("_n", F.row_number().over(w))
    at = lambda c: F.when(known, F.col(c))
    own = own.withColumns({"_v0": F.last(column, ignorenulls=True).over(before), "_d0": F.last(at("date"), ignorenulls=True).over(before), "_n0": F.last(at("_n"), ignorenulls=True).over(before), "_v1": F.first(column, ignorenulls=True).over(after), "_d1": F.first(at("date"), ignorenulls=True).over(after)})
    share = F.datediff("date", "_d0") / F.datediff("_d1", "_d0")
    line = F.when(F.col("_v1").isNull(), F.col("_v0")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share)
    filled = F.when(known, F.col(column)).when(F.col("_n") - F.col("_n0") <= limit, line)
    return own.withColumn(column, filled).drop("_n", "_v0", "_d0", "_n0", "_v1", "_d1")


def common_dates(sources: list[DataFrame]) -> list[DataFrame]:
    """Each source on the dates that all have; with no common date the sources as they are."""
    each = [s.select("date").distinct() for s in sources]
    shared = reduce(lambda a, b: a.intersect(b), each)
    none = shared.groupBy().agg((F.count("*") == 0).alias("none"))
    out = []
    for s in sources:
        flagged = s.join(shared.withColumn("_in", F.lit(True)), "date", "left").crossJoin(F.broadcast(none))
        out.append(flagged.where(F.col("none") | F.col("_in")).select(*s.columns))
    return out


def on_calendar(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for each key and calendar day: the row of the last day that has one, its nulls included."""
    columns = [c for c in df.columns if c not in ("ticker", "date")]
    days = df.select("ticker").distinct().join(calendar.select(F.col("trade_date").alias("date")))
    cells = days.withColumn("_cal", F.lit(True)).join(df.withColumn("_row", F.struct(*columns)).select("ticker", "date", "_row"), ["ticker", "date"], "full")
    w = series().rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_row", F.last("_row", ignorenulls=True).over(w)).where("_cal").select("ticker", "date", *[F.col("_row")[c].alias(c) for c in columns])


def decay_events(days: DataFrame, events: DataFrame, value: str, decay_days: int = 5) -> DataFrame:
    """Events by trading day, carried on for ``decay_days`` rows; events between trading days are left out."""
    joined = days.join(events, ["ticker", "date"], "left")
    return ffill(joined, [value], decay_days)
