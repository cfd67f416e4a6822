"""The factor registry: each factor is a builder of one column over a series of bars.

All factors of a panel share one window specification, so that Spark plans a single exchange and sort for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import rolling as r
from marlstone.functions.safe import sdiv

EPS = 1e-8
YEAR = 252**0.5


@dataclass(frozen=True)
class Factor:
    name: str
    build: Callable[..., Column]
    description: str = ""
    params: dict = field(default_factory=dict)


REGISTRY: dict[str, Factor] = {}


def register(name: str, description: str = "", **params):
    def add(fn):
        REGISTRY[name] = Factor(name, fn, description, params)
        return fn

    return add


def list_factors() -> list[str]:
    return list(REGISTRY)


def _momentum(w, n):
    return r.pct_change("close", n, w)


def _deviation(w, n):
    return sdiv(F.col("close") - r.mean("close", n, w), r.mean("close", n, w))


def _volume_ratio(w, n):
    return sdiv("volume", r.mean("volume", n, w) + 1)


for _n in (5, 10, 20, 60):
    register(f"momentum_{_n}d", f"return over {_n} bars", lookback=_n)(lambda w, lookback: _momentum(w, lookback))
for _n in (5, 20):
    register(f"reversal_{_n}d", f"negative return over {_n} bars", lookback=_n)(lambda w, lookback: -_momentum(w, lookback))
for _n in (5, 20, 60):
    register(f"ma_deviation_{_n}", f"distance from the {_n}-bar mean", window=_n)(lambda w, window: _deviation(w, window))


@register("high_low_ratio", "place in the range of the window", window=20)
def _(w, window):
    lo, hi = r.lowest("low", window, w), r.highest("high", window, w)
    return sdiv(F.col("close") - lo, hi - lo + EPS)


for _n in (5, 20):
    register(f"volume_ratio_{_n}d", f"volume against its {_n}-bar mean", window=_n)(lambda w, window: _volume_ratio(w, window))


@register("volume_momentum", "change of volume", lookback=5)
def _(w, lookback):
    return r.pct_change("volume", lookback, w)


@register("turnover_ma5", "mean turnover", window=5)
def _(w, window):
    return r.mean("turnover", window, w)


@register("price_volume_corr", "correlation of price and volume changes", window=20)
def _(w, window):
    return r.corr("_dc", "_dv", window, w)


for _n in (20, 60):
    register(f"volatility_{_n}d", f"annual volatility over {_n} bars", window=_n)(lambda w, window: r.std("_dc", window, w) * YEAR)


@register("atr_14", "average true range by close", window=14)
def _(w, window):
    return sdiv(r.mean("_tr", window, w), "close")


@register("realized_skew", "skewness of returns", window=20)
def _(w, window):
    return r.skew("_dc", window, w)


@register("realized_kurt", "excess kurtosis of returns", window=20)
def _(w, window):
    return r.kurt("_dc", window, w)


@register("rsi_14", "relative strength index; the first change counts as none", window=14)
def _(w, window):
    up, down = r.mean("_up", window, w), r.mean("_down", window, w)
    return 100 - 100 / (1 + up / (down + EPS))


@register("macd_diff", "MACD line less its signal", fast=12, slow=26, signal=9)
def _(w, fast, slow, signal):
    return F.col("_macd") - F.col("_signal")


@register("bollinger_position", "place in the Bollinger band", window=20, num_std=2)
def _(w, window, num_std):
    m, s = r.mean("close", window, w), r.std("close", window, w)
    return sdiv(F.col("close") - (m - s * num_std), s * (2 * num_std) + EPS)


@register("roe", "return on equity, as last reported")
def _(w):
    return F.col("roe")


@register("pe_ttm", "price by earnings")
def _(w):
    return sdiv("close", F.col("eps") + EPS)


@register("revenue_growth", "revenue against 60 bars before", lookback=60)
def _(w, lookback):
    return sdiv("revenue", F.lag("revenue", lookback).over(w) + EPS) - 1


@register("profit_growth", "profit against 60 bars before", lookback=60)
def _(w, lookback):
    return sdiv("net_profit", F.lag("net_profit", lookback).over(w) + EPS) - 1


@register("quality_momentum", "momentum by volatility", lookback=20)
def _(w, lookback):
    return sdiv(_momentum(w, lookback), r.std("_dc", lookback, w) + EPS)


@register("smart_money", "mean product of price and volume changes", window=10)
def _(w, window):
    return r.mean("_dcdv", window, w)


def resolve(name: str, overrides: dict | None = None) -> dict:
    """Parameters of a factor; overrides are by the name's first word and reach every factor that begins with it."""
    return REGISTRY[name].params | (overrides or {}).get(name.split("_")[0], {})


def compute(bars: DataFrame, names: list[str] | None = None, overrides: dict | None = None) -> DataFrame:
    """bars with a column for each factor. Missing input columns are null, and so are the factors made of them.

    An override that a factor does not take makes that factor null, as its definition fails.
    """
    names = names or list_factors()
    for c in ("turnover", "roe", "eps", "revenue", "net_profit"):
        if c not in bars.columns:
            bars = bars.withColumn(c, F.lit(None).cast("double"))
    w = r.series()
    before = F.lag("close", 1).over(w)
    change = F.coalesce(F.col("close") - before, F.lit(0.0))
    own = bars.withColumns({"_dc": r.pct_change("close", 1, w), "_dv": r.pct_change("volume", 1, w), "_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0)), "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    own = own.withColumn("_dcdv", F.col("_dc") * F.col("_dv"))
    if "macd_diff" in names:
        p = resolve("macd_diff", overrides)
        own = r.ewms(own, {"_fast": ("close", p["fast"]), "_slow": ("close", p["slow"])}).withColumn("_macd", F.col("_fast") - F.col("_slow"))
        own = r.ewm(own, "_macd", p["signal"], "_signal")
    made = {}
    for n in names:
        try:
            made[n] = REGISTRY[n].build(w, **resolve(n, overrides))
        except TypeError:
            made[n] = F.lit(None).cast("double")
    kept = [c for c in bars.columns if c not in made]
    return own.select(*kept, *[c.alias(n) for n, c in made.items()])


def lengthen(wide: DataFrame, names: list[str]) -> DataFrame:
    """(ticker, date, factor_name, factor_value), without nulls."""
    return wide.unpivot(["ticker", "date"], names, "factor_name", "factor_value").where("factor_value is not null")
