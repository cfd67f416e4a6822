"""Repair of bars and of numeric columns. ``by`` keeps statistics within a group; without it they span the frame.

Quantiles of a whole frame are found by exact_quantiles(), which reads it several times when the frame is built; NaN and
infinities take no part in them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.safe import clamp, finite, sdiv

from .quantiles import exact_quantiles

PRICES = ("open", "high", "low", "close")


def clean_ohlcv(df: DataFrame) -> DataFrame:
    """One row a ticker and day (the first by all columns), no price of zero or less, no high below its low, volume of
    zero at least; rows without a close go."""
    w = Window.partitionBy("ticker", "date").orderBy(*[c for c in df.columns if c not in ("ticker", "date")])
    own = df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    own = own.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in PRICES if c in df.columns})
    if "volume" in df.columns:
        own = own.withColumn("volume", clamp("volume", 0))
    crossed = F.col("high") < F.col("low")
    own = own.withColumns({c: F.when(~F.coalesce(crossed, F.lit(False)), F.col(c)) for c in ("high", "low")})
    return own.dropna(subset=["close"])


def group_stats(df: DataFrame, by: list[str] | None, **stats) -> DataFrame:
    """df with a statistic in every row: by a join with one row a group, broadcast only if it is one row in all."""
    aggregates = [e.alias(n) for n, e in stats.items()]
    if not by:
        return df.crossJoin(F.broadcast(df.agg(*aggregates)))
    return df.join(df.groupBy(*by).agg(*aggregates), by, "left")


def fill_missing(df: DataFrame, columns: list[str], method: str = "median", value: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Nulls take the median (also for an unknown method), the mean or a constant."""
    if method == "constant" and value is not None:
        return df.fillna({c: value for c in columns})
    if method != "mean" and not by:
        medians = exact_quantiles(df, {c: [0.5] for c in columns})
        return df.withColumns({c: F.coalesce(c, F.lit(medians[c, 0.5])) for c in columns})
    stat = F.avg if method == "mean" else lambda c: F.percentile(c, 0.5)
    own = group_stats(df, by, **{f"_m_{c}": stat(c) for c in columns})
    return own.withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).select(*df.columns)


def winsorize(df: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99, by: list[str] | None = None) -> DataFrame:
    """Values beyond the quantiles take these; columns of under ten different values stay."""
    held = lambda c, lo, hi: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo), hi))
    if not by:
        different = df.agg(*[F.countDistinct(c).alias(c) for c in columns]).first()
        wide = [c for c in columns if different[c] >= 10]
        q = exact_quantiles(df, {c: [lower, upper] for c in wide}) if wide else {}
        return df.withColumns({c: held(c, F.lit(q[c, lower]), F.lit(q[c, upper])) for c in wide})
    stats = {}
    for c in columns:
        stats |= {f"_q_{c}": F.percentile(c, F.array(F.lit(lower), F.lit(upper))), f"_n_{c}": F.countDistinct(c)}
    own = group_stats(df, by, **stats)
    out = {c: F.when(F.col(f"_n_{c}") < 10, F.col(c)).otherwise(held(c, F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1])) for c in columns}
    return own.withColumns(out).select(*df.columns)


def outliers(df: DataFrame, column: str, method: str = "zscore", threshold: float = 3.0, by: list[str] | None = None, out: str = "is_outlier") -> DataFrame:
    if method == "zscore":
        own = group_stats(df, by, _m=F.avg(column), _s=F.stddev_samp(column))
        flag = F.abs(sdiv(F.col(column) - F.col("_m"), "_s")) > threshold
    else:
        if by:
            own, q = group_stats(df, by, _q=F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))), F.col("_q")
        else:
            found = exact_quantiles(df, {column: [0.25, 0.75]})
            own, q = df, [F.lit(found[column, p]).cast("double") for p in (0.25, 0.75)]
        spread = (q[1] - q[0]) * threshold
        flag = (F.col(column) < q[0] - spread) | (F.col(column) > q[1] + spread)
    return own.select(*df.columns, F.coalesce(flag, F.lit(False)).alias(out))


def adjust_for_splits(df: DataFrame, ratio: str = "split_ratio") -> DataFrame:
    """Prices times the ratio, volume divided by it; rows without a ratio stay."""
    r = F.coalesce(F.col(ratio), F.lit(1.0))
    return df.withColumns({c: F.col(c) * r for c in PRICES if c in df.columns} | {"volume": sdiv("volume", r)})


def drop_infinite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Infinities and NaN become null; rows that are null in all of the columns go."""
    return df.withColumns({c: finite(c) for c in columns}).dropna("all", subset=columns)


def clip_by_range(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    return df.withColumns({c: clamp(c, *b) for c, b in ranges.items() if c in df.columns})


def repair_pe(df: DataFrame, column: str = "pe_ttm", by: list[str] | None = None) -> DataFrame:
    """Negative ratios take the median of the positive ones; all are held in [0, 200]."""
    positive = F.when(F.col(column) > 0, F.col(column))
    if by:
        own, median = group_stats(df, by, _m=F.percentile(positive, 0.5)), F.col("_m")
    else:
        own, median = df, F.lit(exact_quantiles(df.select(positive.alias("p")), {"p": [0.5]})["p", 0.5]).cast("double")
    fixed = F.when(F.col(column) < 0, F.coalesce(median, F.col(column))).otherwise(F.col(column))
    return own.withColumn(column, clamp(fixed, 0, 200)).select(*df.columns)


def clean_factors(df: DataFrame, columns: list[str], macro: list[str] = (), by: list[str] | None = None) -> DataFrame:
    """Infinities, medians, quantiles 1 and 99 %, then zero for macro columns still missing."""
    own = winsorize(fill_missing(drop_infinite(df, columns), columns, by=by), columns, 0.01, 0.99, by)
    return own.fillna({c: 0.0 for c in macro})


def clean_valuation(df: DataFrame, pe: str, others: dict[str, tuple], by: list[str] | None = None) -> DataFrame:
    """Infinities, ratios, medians, quantiles 2 and 98 %, then ranges: of ``others`` those given."""
    columns = [pe, *others]
    own = fill_missing(repair_pe(drop_infinite(df, columns), pe, by), columns, by=by)
    return clip_by_range(winsorize(own, columns, 0.02, 0.98, by), {pe: (0, 200), **others})


def clean_daily(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bars as they are stored: clean_ohlcv, infinities, medians, then the ranges of changes and of turnover."""
    columns = [c for c in (*PRICES, "volume", "amount", "pct_change", "turnover") if c in df.columns]
    own = fill_missing(drop_infinite(clean_ohlcv(df), columns), columns, by=by)
    return clip_by_range(own, {"pct_change": (-20, 20), "turnover": (0, 50)})
