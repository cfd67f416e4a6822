"""Factors that are written as text, over the bars of the brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions.expressions import compute
from marlstone.registry import query

from .factors import _ewm
from .views import BARS, bars

R = lambda c, n=6: F.round(c, n)
W = "PARTITION BY ticker ORDER BY date"

#: The default set. Fixed values.
DEFAULT = {
    "body": "$close/$open - 1",
    "length": "$high/$low - 1",
    "shift": "($close - $open)/($high - $low + 1e-8)",
    "momentum_5": "$close/Ref($close, 5) - 1",
    "momentum_10": "$close/Ref($close, 10) - 1",
    "momentum_20": "$close/Ref($close, 20) - 1",
    "deviation_5": "Mean($close, 5)/$close - 1",
    "deviation_std_20": "Std($close, 20)",
}


def _w(n):
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_DEFAULT_SQL = {
    "body": "close / NULLIF(open, 0) - 1", "length": "high / NULLIF(low, 0) - 1", "shift": "(close - open) / NULLIF(high - low + 1e-8, 0)",
    **{f"momentum_{n}": f"close / NULLIF(lag(close, {n}) OVER ({W}), 0) - 1" for n in (5, 10, 20)},
    "deviation_5": f"avg(close) OVER {_w(5)} / NULLIF(close, 0) - 1", "deviation_std_20": f"stddev_samp(close) OVER {_w(20)}",
}


def _rounded(df, names):
    return df.select("ticker", "date", *[R(n).alias(n) for n in names])


@query("expressions_default", f"WITH {BARS} SELECT ticker, date, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _DEFAULT_SQL.items()) + " FROM bars")
def expressions_default(spark, sf_dir):
    return _rounded(compute(bars(spark, sf_dir), DEFAULT), DEFAULT)


for _name in DEFAULT:

    @query(f"expression_{_name}", f"WITH {BARS} SELECT ticker, date, round({_DEFAULT_SQL[_name]}, 6) AS {_name} FROM bars")
    def _one(spark, sf_dir, name=_name):
        return _rounded(compute(bars(spark, sf_dir), {name: DEFAULT[name]}), [name])


#: Every word of the language, windows upon windows among them.
ALL = {
    "sums": "Sum($volume, 5) / Max($volume, 5) + Min($volume, 5) / Mean($volume, 5)",
    "change": "Delta(Mean($close, 3), 2)",
    "smooth": "EMA($close, 12) - EMA($close, 26)",
    "signal": "EMA(EMA($close, 12) - EMA($close, 26), 9)",
    "weighted": "WMA($close, 7)",
    "place": "Rank($close, 10)",
    "together": "Corr(Log($close), Log($volume + 1), 10)",
    "side": "If(Abs($close - Mean($close, 3)) > Std($close, 5) & $volume >= 1, Sign($close - Ref($close, 1)), -0.5)",
}
_ALL_SQL = f"""a AS (SELECT *, avg(close) OVER {_w(3)} AS m3, {_ewm('close', 12)} - {_ewm('close', 26)} AS macd, ln(close) AS lc, ln(volume + 1) AS lv, list(close) OVER {_w(10)} AS win
 FROM (SELECT *, row_number() OVER ({W}) - 1 AS i FROM bars)),
b AS (SELECT *, {_ewm('macd', 9)} AS sig FROM a)"""


@query("expressions_all", f"""WITH {BARS}, {_ALL_SQL}
SELECT ticker, date, round(sum(volume) OVER {_w(5)} / NULLIF(max(volume) OVER {_w(5)}, 0) + min(volume) OVER {_w(5)} / NULLIF(avg(volume) OVER {_w(5)}, 0), 6) AS sums,
 round(m3 - lag(m3, 2) OVER ({W}), 4) AS change, round(macd, 4) AS smooth, round(sig, 4) AS signal,
 round(list_sum([k * win7[k] for k in range(1, len(win7) + 1)]) / (len(win7) * (len(win7) + 1) / 2), 6) AS weighted,
 round((len(list_filter(win, lambda x: x < close)) + (len(list_filter(win, lambda x: x = close)) + 1) / 2.0::DOUBLE) / len(win), 6) AS place,
 round(covar_samp(lc, lv) OVER {_w(10)} / NULLIF(stddev_samp(lc) OVER {_w(10)} * stddev_samp(lv) OVER {_w(10)}, 0), 6) AS together,
 CASE WHEN abs(close - m3) > stddev_samp(close) OVER {_w(5)} AND volume >= 1 THEN CAST(sign(close - lag(close) OVER ({W})) AS DOUBLE) ELSE -0.5 END AS side
 FROM (SELECT *, list(close) OVER {_w(7)} AS win7 FROM b)""")
def expressions_all(spark, sf_dir):
    own = compute(bars(spark, sf_dir), ALL)
    return own.select("ticker", "date", *[R(n, 4 if n in ("change", "smooth", "signal") else 6).alias(n) for n in ALL if n != "side"], "side")
