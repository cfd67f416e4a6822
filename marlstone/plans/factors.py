"""The factor queries: each factor alone, all of them wide and long, and summaries of the long panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import factors as fac
from marlstone.operators.align import asof_join
from marlstone.registry import query

from .views import BARS, FUNDAMENTALS, bars, fundamentals

FIN = ["revenue", "net_profit", "roe", "eps"]


def panel(spark, sf_dir, names=None):
    """Factors of all brands; bars know the last reported figures, and turnover is volume by reported equity."""
    own = bars(spark, sf_dir)
    names = names or fac.list_factors()
    if set(names) & {"roe", "pe_ttm", "revenue_growth", "profit_growth", "turnover_ma5"}:
        own = asof_join(own, fundamentals(spark, sf_dir), [*FIN, "equity"]).withColumn("turnover", fac.sdiv("volume", "equity")).drop("equity")
    return fac.compute(own, names)


W = "PARTITION BY ticker ORDER BY date"


def _w(n):
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(fn, c, n):
    return f"CASE WHEN count({c}) OVER {_w(n)} = {n} THEN {fn}({c}) OVER {_w(n)} END"


def _mom(n):
    return f"close / NULLIF(lag(close, {n}) OVER ({W}), 0) - 1"


def _g(fn, n):
    return f"CASE WHEN count(dc) OVER {_w(n)} = {n} AND stddev_samp(dc) OVER {_w(n)} > 0 THEN {fn}(dc) OVER {_w(n)} END"


def _ewm(c, span):
    q = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"(sum({c} * pow({q}, -i)) OVER ({W} ROWS UNBOUNDED PRECEDING) * pow({q}, i) / ((1 - pow({q}, i + 1)) / (1 - {q})))"


_lo, _hi = _full("min", "low", 20), _full("max", "high", 20)
_m20, _s20 = _full("avg", "close", 20), _full("stddev_samp", "close", 20)

FORMULAS = {
    **{f"momentum_{n}d": _mom(n) for n in (5, 10, 20, 60)},
    **{f"reversal_{n}d": f"-({_mom(n)})" for n in (5, 20)},
    **{f"ma_deviation_{n}": f"(close - ({_full('avg', 'close', n)})) / NULLIF({_full('avg', 'close', n)}, 0)" for n in (5, 20, 60)},
    "high_low_ratio": f"(close - ({_lo})) / (({_hi}) - ({_lo}) + 1e-8)",
    **{f"volume_ratio_{n}d": f"volume / (({_full('avg', 'volume', n)}) + 1)" for n in (5, 20)},
    "volume_momentum": f"volume / NULLIF(lag(volume, 5) OVER ({W}), 0) - 1",
    "turnover_ma5": _full("avg", "turnover", 5),
    "price_volume_corr": f"CASE WHEN count(dc) OVER {_w(20)} = 20 THEN covar_samp(dc, dv) OVER {_w(20)} / NULLIF(stddev_samp(dc) OVER {_w(20)} * stddev_samp(dv) OVER {_w(20)}, 0) END",
    **{f"volatility_{n}d": f"({_full('stddev_samp', 'dc', n)}) * sqrt(252)" for n in (20, 60)},
    "atr_14": f"({_full('avg', 'tr', 14)}) / NULLIF(close, 0)",
    "realized_skew": _g("skewness", 20),
    "realized_kurt": _g("kurtosis", 20),
    "rsi_14": f"100 - 100 / (1 + ({_full('avg', 'up', 14)}) / (({_full('avg', 'down', 14)}) + 1e-8))",
    "macd_diff": None,
    "bollinger_position": f"(close - (({_m20}) - 2 * ({_s20}))) / (4 * ({_s20}) + 1e-8)",
    "roe": "roe",
    "pe_ttm": "close / NULLIF(eps + 1e-8, 0)",
    "revenue_growth": f"revenue / NULLIF(lag(revenue, 60) OVER ({W}) + 1e-8, 0) - 1",
    "profit_growth": f"net_profit / NULLIF(lag(net_profit, 60) OVER ({W}) + 1e-8, 0) - 1",
    "quality_momentum": f"({_mom(20)}) / (({_full('stddev_samp', 'dc', 20)}) + 1e-8)",
    "smart_money": _full("avg", "dcdv", 10),
}

STEPS = f"""{BARS}, {FUNDAMENTALS},
known AS (SELECT b.*, f.revenue, f.net_profit, f.roe, f.eps, b.volume / NULLIF(f.equity, 0) AS turnover
  FROM bars b ASOF LEFT JOIN fundamentals f ON b.ticker = f.ticker AND b.date >= f.report_date),
s1 AS (SELECT *, row_number() OVER ({W}) - 1 AS i, {_mom(1)} AS dc, volume / NULLIF(lag(volume, 1) OVER ({W}), 0) - 1 AS dv,
  greatest(coalesce(close - lag(close) OVER ({W}), 0), 0) AS up, greatest(coalesce(lag(close) OVER ({W}) - close, 0), 0) AS down,
  greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS tr FROM known),
s2 AS (SELECT *, dc * dv AS dcdv, {_ewm('close', 12)} - {_ewm('close', 26)} AS macd FROM s1),
s3 AS (SELECT *, {_ewm('macd', 9)} AS sig FROM s2)"""
FORMULAS["macd_diff"] = "macd - sig"


def _sql(names):
    return f"WITH {STEPS} SELECT ticker, date, " + ", ".join(f"round({FORMULAS[n]}, 6) AS {n}" for n in names) + " FROM s3"


def rounded(df, names):
    return df.select("ticker", "date", *[F.round(n, 6).alias(n) for n in names])


for _name in fac.list_factors():
    query(f"factor_{_name}", _sql([_name]))(lambda spark, sf_dir, n=_name: rounded(panel(spark, sf_dir, [n]), [n]))


@query("factor_panel", _sql(["momentum_20d", "rsi_14"]))
def factor_panel(spark, sf_dir):
    return rounded(panel(spark, sf_dir, ["momentum_20d", "rsi_14"]), ["momentum_20d", "rsi_14"])


@query("factors_wide", _sql(fac.list_factors()))
def factors_wide(spark, sf_dir):
    return rounded(panel(spark, sf_dir), fac.list_factors())


LONG = f"{STEPS}, wide AS (SELECT ticker, date, " + ", ".join(f"{FORMULAS[n]} AS {n}" for n in fac.list_factors()) + """ FROM s3),
long AS (SELECT ticker, date, factor_name, factor_value FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE (ticker, date)) INTO NAME factor_name VALUE factor_value))"""


def long(spark, sf_dir, names=None):
    return fac.lengthen(panel(spark, sf_dir, names), names or fac.list_factors())


@query("factors_long", f"WITH {LONG} SELECT ticker, date, factor_name, round(factor_value, 6) AS factor_value FROM long")
def factors_long(spark, sf_dir):
    return long(spark, sf_dir).withColumn("factor_value", F.round("factor_value", 6))


@query("factor_summary", f"WITH {LONG} SELECT factor_name, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS n_tickers FROM long GROUP BY factor_name")
def factor_summary(spark, sf_dir):
    return long(spark, sf_dir).groupBy("factor_name").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("ticker").alias("n_tickers"))


@query("asof_fundamentals", f"WITH {STEPS} SELECT ticker, date, round(revenue, 4) AS revenue, round(net_profit, 4) AS net_profit, round(roe, 6) AS roe, round(eps, 6) AS eps FROM known")
def asof_fundamentals(spark, sf_dir):
    j = asof_join(bars(spark, sf_dir), fundamentals(spark, sf_dir), FIN)
    return j.select("ticker", "date", *[F.round(c, 4 if c in FIN[:2] else 6).alias(c) for c in FIN])
