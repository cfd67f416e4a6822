"""Market regimes, the weights that go with them, and the second family of indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import rolling as r
from marlstone.functions.safe import sdiv

#: Weight of each source by regime. Fixed values.
SOURCES = ("market_data", "factor_signals", "news_events", "wiki", "facts")
WEIGHTS = {
    "trend": (0.35, 0.35, 0.15, 0.10, 0.05),
    "oscillating": (0.30, 0.25, 0.30, 0.10, 0.05),
    "extreme_volatility": (0.25, 0.20, 0.35, 0.15, 0.05),
    "earnings_season": (0.30, 0.25, 0.35, 0.05, 0.05),
    "policy_window": (0.25, 0.15, 0.40, 0.15, 0.05),
}


def adx(df: DataFrame, period: int = 14, out: str = "adx") -> DataFrame:
    """bars with the strength of their trend: the mean of the directional index over ``period`` rows; null before
    there are enough rows for both means."""
    w = r.series()
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    prev = F.lag("close").over(w)
    own = df.withColumns(
        {
            "_plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "_minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
            "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)),
        }
    )
    range_ = r.mean("_tr", period, w)
    own = own.withColumns({"_p": 100 * sdiv(r.mean("_plus", period, w), range_), "_m": 100 * sdiv(r.mean("_minus", period, w), range_)})
    own = own.withColumn("_dx", 100 * F.abs(F.col("_p") - F.col("_m")) / (F.col("_p") + F.col("_m") + 1e-8))
    return own.withColumn(out, r.mean("_dx", period, w)).drop("_plus", "_minus", "_tr", "_p", "_m", "_dx")


def calendar_regime(day: Column) -> Column:
    """(regime, confidence) that the date alone decides, else null."""
    m, d = F.month(day), F.dayofmonth(day)
    is_ = lambda name, sure: F.struct(F.lit(name).alias("regime"), F.lit(sure).alias("confidence"))
    return (
        F.when(m <= 4, is_("earnings_season", 0.85)).when(m.isin(7, 8), is_("earnings_season", 0.80))
        .when((m == 12) & d.between(10, 25), is_("policy_window", 0.70)).when((m == 11) & d.between(10, 20), is_("policy_window", 0.65))
    )


def regimes(bars: DataFrame, as_of: Column, *, strong: float = 25.0, spike: float = 2.0, width: float = 0.03) -> DataFrame:
    """(ticker, regime, confidence) of each instrument at its last bar: by the calendar, then by its volatility, then
    by its trend. Under 60 bars: oscillating."""
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    own = adx(bars).withColumn("_r", sdiv("close", F.lag("close").over(r.series())) - 1).withColumn("_b", F.row_number().over(back))
    last = lambda c, n: F.when(F.col("_b") <= n, F.col(c))
    g = own.groupBy("ticker").agg(
        F.count("*").alias("n"), F.count("_r").alias("n_r"), F.stddev_samp(last("_r", 20)).alias("short"), F.stddev_samp(last("_r", 60)).alias("long"), F.max(last("adx", 1)).alias("adx"),
        F.max(last("high", 20)).alias("hi"), F.min(last("low", 20)).alias("lo"), F.max(last("close", 1)).alias("close"),
    )
    ratio = F.when((F.col("n_r") >= 60) & (F.col("long") * 252**0.5 >= 1e-8), sdiv("short", "long"))
    span = F.when(F.col("close") > 0, (F.col("hi") - F.col("lo")) / F.col("close")).otherwise(0.0)
    is_ = lambda name, sure: F.struct(F.lit(name).alias("regime"), sure.cast("double").alias("confidence"))
    by_trend = (
        F.when(F.col("adx").isNull(), is_("oscillating", F.lit(0.4)))
        .when((F.col("adx") > strong) & (span > width), is_("trend", F.least((F.col("adx") - strong) / 30 + 0.5, F.lit(0.95))))
        .otherwise(is_("oscillating", F.greatest(F.lit(0.35), 0.7 - F.col("adx") / 50)))
    )
    found = F.when(F.col("n") < 60, is_("oscillating", F.lit(0.3))).otherwise(F.coalesce(calendar_regime(as_of), F.when(ratio > spike, is_("extreme_volatility", F.least(ratio / 4, F.lit(1.0)))), by_trend))
    return g.select("ticker", found.alias("f")).select("ticker", "f.regime", "f.confidence")


def trend_60(bars: DataFrame) -> DataFrame:
    """(ticker, regime): up, down or range by the change over the last 60 bars; unknown with fewer."""
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    own = bars.withColumn("_b", F.row_number().over(back)).where("_b <= 60")
    g = own.groupBy("ticker").agg(F.count("*").alias("n"), (sdiv(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("ret"))
    return g.select("ticker", F.when(F.col("n") < 60, "unknown").when(F.col("ret") > 0.05, "uptrend").when(F.col("ret") < -0.05, "downtrend").otherwise("rangebound").alias("regime"))


def source_weights(regime: Column) -> Column:
    """Array of the weights of SOURCES; those of oscillating markets for a regime that is not known."""
    table = F.create_map(*[x for name, w in WEIGHTS.items() for x in (F.lit(name), F.array(*map(F.lit, w)))])
    return F.coalesce(F.try_element_at(table, regime), F.array(*map(F.lit, WEIGHTS["oscillating"])))


def rsi_plain(c: str, n: int, w) -> tuple[dict, Column]:
    """Columns to add first, and the index of them: null without any loss, and before there are n changes."""
    change = F.col(c) - F.lag(c).over(w)
    steps = {"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))}
    steps = {k: F.when(change.isNotNull(), v) for k, v in steps.items()}
    ratio = sdiv(r.mean("_gain", n, w), r.mean("_loss", n, w))
    return steps, 100 - 100 / (1 + ratio)


def indicators(bars: DataFrame) -> DataFrame:
    """bars with moving averages, the plain RSI, MACD with its doubled bar, volatility and volume averages."""
    w = r.series()
    steps, rsi = rsi_plain("close", 14, w)
    own = bars.withColumns(steps).withColumn("rsi", rsi).drop(*steps)
    own = r.ewms(own, {"_e12": ("close", 12), "_e26": ("close", 26)}).withColumn("dif", F.col("_e12") - F.col("_e26"))
    own = r.ewm(own, "dif", 9, "dea").withColumn("macd_bar", 2 * (F.col("dif") - F.col("dea"))).drop("_e12", "_e26")
    own = own.withColumn("ret", sdiv("close", F.lag("close").over(w)) - 1)
    more = {f"ma{n}": r.mean("close", n, w) for n in (5, 10, 20, 60, 120)}
    more |= {"volatility": r.std("ret", 20, w) * 252**0.5, "vol_ma20": r.mean("volume", 20, w), "vol_ma60": r.mean("volume", 60, w)}
    return own.withColumns(more)

