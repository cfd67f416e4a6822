"""Checks of orders and portfolios, decay of signals, volatility targets and performance against a benchmark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.safe import sdiv

YEAR = 252**0.5
LIMITS = {"single": 0.05, "sector": 0.20, "turnover": 0.10, "volume": 5e7, "drawdown": -0.05, "daily_loss": -0.02}


def order_sectors(orders: DataFrame, portfolio: DataFrame) -> DataFrame:
    """orders with the sector of the held position of that ticker (the first by sector), or the ticker itself."""
    known = portfolio.groupBy("ticker").agg(F.min("sector").alias("_sector"))
    return orders.join(known, "ticker", "left").withColumn("sector", F.coalesce("_sector", "ticker")).drop("_sector")


def order_violations(orders: DataFrame, portfolio: DataFrame, volumes: DataFrame | None = None, blacklist: list[str] = (), limits: dict | None = None) -> DataFrame:
    """(rule, ticker, value, severity) of every rule that the orders (ticker, target_weight) break.

    portfolio: (ticker, weight, sector); volumes: (ticker, volume). A sector's weight is what is held and ordered. Only
    blacklisted orders block. No orders, no violations of turnover; null weights count as none.
    """
    at = LIMITS | (limits or {})
    orders = orders.withColumn("_w", F.coalesce(F.abs("target_weight"), F.lit(0.0)))
    row = lambda rule, ticker, value, severity: (F.lit(rule).alias("rule"), ticker.alias("ticker"), value.cast("double").alias("value"), F.lit(severity).alias("severity"))
    found = [
        orders.where(F.col("ticker").isin(list(blacklist))).select(*row("blacklist", F.col("ticker"), F.col("_w"), "block")),
        orders.where(F.col("_w") > at["single"]).select(*row("single_name", F.col("ticker"), F.col("_w"), "warning")),
    ]
    held = portfolio.select("sector", F.coalesce(F.abs("weight"), F.lit(0.0)).alias("_w"))
    sectors = held.unionByName(order_sectors(orders, portfolio).select("sector", "_w")).groupBy("sector").agg(F.sum("_w").alias("_w"))
    found.append(sectors.where(F.col("_w") > at["sector"]).select(*row("sector_exposure", F.col("sector"), F.col("_w"), "warning")))
    found.append(orders.agg((F.sum("_w") / 2).alias("_w")).where(F.col("_w") > at["turnover"]).select(*row("daily_turnover", F.lit("PORTFOLIO"), F.col("_w"), "warning")))
    if volumes is not None:
        thin = orders.join(volumes.groupBy("ticker").agg(F.first("volume").alias("_v")), "ticker").where(F.col("_v") < at["volume"])
        found.append(thin.select(*row("liquidity", F.col("ticker"), F.col("_v"), "warning")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def passed(violations: DataFrame) -> DataFrame:
    """One row: how many violations there are, and whether none blocks."""
    return violations.agg(F.count("*").alias("n_violations"), (F.count_if(F.col("severity") == "block") == 0).alias("passed"))


def breakers(curve: DataFrame, limits: dict | None = None) -> DataFrame:
    """(date, drawdown, daily_return, drawdown_stop, daily_stop) of a curve (date, equity): whether trading must stop."""
    at = LIMITS | (limits or {})
    w = Window.orderBy("date")
    own = curve.withColumns({"drawdown": sdiv(F.col("equity") - F.max("equity").over(w), F.max("equity").over(w)), "daily_return": sdiv("equity", F.lag("equity").over(w)) - 1})
    worst = F.min("drawdown").over(w)
    return own.select("date", "drawdown", "daily_return", F.coalesce(worst < at["drawdown"], F.lit(False)).alias("drawdown_stop"), F.coalesce(F.col("daily_return") < at["daily_loss"], F.lit(False)).alias("daily_stop"))


def rolling_quality(returns: DataFrame, window: int = 20) -> DataFrame:
    """returns (ticker, date, r) with the share of gains and the Sharpe ratio of the last ``window`` rows."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    whole = F.count("r").over(w) == window
    gains = F.avg((F.col("r") > 0).cast("double")).over(w)
    return returns.withColumns({"win_rate": F.when(whole, gains), "sharpe": F.when(whole, sdiv(F.avg("r").over(w), F.stddev_samp("r").over(w)) * YEAR)})


def decay(quality: DataFrame, win: float = 0.40, sharpe: float = 0.0, ic: float = 0.02, days: int = 20, speed: int = 5, loss: float = 0.5) -> DataFrame:
    """(ticker, weak, low_ic, flipped, fading, level) from (ticker, date, r, win_rate, sharpe, ic), a row a bar.

    weak: the last share of gains and Sharpe ratio are both low; low_ic: ``days`` coefficients in a row are near zero;
    flipped: the first of the last 20 is positive and the last negative; fading: the mean of the last ``speed`` returns
    is under ``loss`` of the one before. Series too short for a rule do not break it.
    """
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    own = quality.withColumn("_b", F.row_number().over(back))
    coefficients = quality.where("ic is not null").withColumn("_b", F.row_number().over(back))
    returns = quality.where("r is not null").withColumn("_b", F.row_number().over(back))
    last = own.groupBy("ticker").agg(F.max(F.when(F.col("_b") == 1, F.col("win_rate"))).alias("w"), F.max(F.when(F.col("_b") == 1, F.col("sharpe"))).alias("s"))
    of = lambda c, lo, hi: F.when(F.col("_b").between(lo, hi), F.col(c))
    ics = coefficients.groupBy("ticker").agg(F.count_if((F.col("_b") <= days) & (F.abs("ic") < ic)).alias("low"), F.max(of("ic", 1, 1)).alias("new"), F.max(of("ic", 20, 20)).alias("old"))
    means = returns.groupBy("ticker").agg(F.avg(of("r", 1, speed)).alias("m1"), F.avg(of("r", speed + 1, 2 * speed)).alias("m0"), F.count("*").alias("n"))
    j = last.join(ics, "ticker", "left").join(means, "ticker", "left")
    sure = lambda c: F.coalesce(c, F.lit(False))
    j = j.select(
        "ticker", sure((F.col("w") < win) & (F.col("s") < sharpe)).alias("weak"), sure(F.col("low") >= days).alias("low_ic"), sure((F.col("old") > 0) & (F.col("new") < 0)).alias("flipped"),
        sure((F.col("n") >= 2 * speed) & (F.col("m0") > 0) & (F.col("m1") < F.col("m0") * (1 - loss))).alias("fading"),
    )
    return j.withColumn("level", F.when(F.col("weak") | F.col("flipped"), "critical").when(F.col("low_ic") | F.col("fading"), "warning").otherwise("ok"))


#: Tickers and days of a tile, about.
TICKERS, DAYS = 256, 512


def _tile(got: pa.Table) -> pa.Table:
    """Sums over the days of a tile for each two tickers of its blocks: both there, x, y and their product."""
    first, ticker, day, r = (got.column(c) for c in ("first", "ticker", "day", "r"))
    days, at = np.unique(day.to_numpy(), return_inverse=True)
    first, r = first.to_numpy(zero_copy_only=False), r.to_numpy()
    names = ticker.combine_chunks().dictionary_encode()
    code, words = names.indices.to_numpy(), names.dictionary.to_pylist()

    def dense(rows):
        own, column = np.unique(code[rows], return_inverse=True)
        x, known = np.zeros((len(days), len(own))), np.zeros((len(days), len(own)))
        x[at[rows], column] = r[rows]
        known[at[rows], column] = 1.0
        return [words[k] for k in own], x, known

    same = got.column("i")[0].as_py() == got.column("j")[0].as_py()
    a, xa, ka = dense(np.flatnonzero(first))
    b, xb, kb = (a, xa, ka) if same else dense(np.flatnonzero(~first))
    n, sx, sy, sxy = ka.T @ kb, xa.T @ kb, ka.T @ xb, xa.T @ xb
    i, j = np.nonzero(n)
    order = np.array([a[p] <= b[q] for p, q in zip(i, j)], bool)
    if same:
        i, j, order = i[order], j[order], order[order]
    lo = np.where(order, sx[i, j], sy[i, j])
    hi = np.where(order, sy[i, j], sx[i, j])
    left, right = [a[p] for p in i], [b[q] for q in j]
    pairs = [(p, q) if p <= q else (q, p) for p, q in zip(left, right)]
    return pa.table({"a": pa.array([p for p, _ in pairs], pa.string()), "b": pa.array([q for _, q in pairs], pa.string()), "n": n[i, j].astype(np.int64), "sx": lo, "sy": hi, "sxy": sxy[i, j]})


def covariance(returns: DataFrame, scale: float = 252.0, tickers: int = TICKERS, days: int = DAYS) -> DataFrame:
    """(a, b, cov) of the returns (ticker, date, r) of any two tickers on the days that both have, a up to b.

    A ticker has one row a day; null tickers, days and returns are left out, and null is the covariance of tickers with
    one day in common. Tickers are dealt into blocks and days into spans. Each two blocks and span are a tile, two dense
    matrices and the masks of what is known, whose products are all that leaves a task: rows grow with pairs of tickers
    and with spans, not with days. Returns are taken relative to their ticker's mean, for the sake of accuracy.
    """
    r = returns.where("ticker is not null and date is not null and r is not null").select("ticker", "date", "r")
    means = r.groupBy("ticker").agg(F.avg("r").alias("_mean"))
    blocks = max(1, -(-(means.count()) // tickers))
    own = r.join(means, "ticker").select("ticker", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("day"), (F.col("r") - F.col("_mean")).alias("r"), F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    dealt = own.select("*", F.floor(F.col("day") / days).alias("span"), other).select("ticker", "day", "r", "span", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") <= F.col("o")).alias("first"))
    sums = dealt.groupBy("i", "j", "span").applyInArrow(_tile, "a string, b string, n long, sx double, sy double, sxy double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy")])
    return total.select("a", "b", (sdiv(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1) * scale).alias("cov"))


def portfolio_variance(returns: DataFrame, scale: float = 252.0) -> DataFrame:
    """(v): the sum of all covariances. Where no return is missing it is the variance of the days' sums, and no matrix."""
    r = returns.where("r is not null")
    shape = r.agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("t"), F.count_distinct("date").alias("d")).first()
    if shape.n == shape.t * shape.d:
        return r.groupBy("date").agg(F.sum("r").alias("s")).agg((F.var_samp("s") * scale).alias("v"))
    return covariance(returns, scale).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(2 * F.col("cov"))).alias("v"))


def volatility_target(returns: DataFrame, target: float = 0.15) -> DataFrame:
    """(ticker, weight): equal weights, scaled down (never up) to the target volatility of the portfolio."""
    names = returns.select("ticker").distinct()
    n = names.agg(F.count("*").alias("n"))
    j = names.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(portfolio_variance(returns)))  # one row each
    sigma = F.sqrt(F.greatest(F.col("v"), F.lit(0.0))) / F.col("n")
    return j.select("ticker", (F.least(target / (sigma + 1e-8), F.lit(1.0)) / F.col("n")).alias("weight"))


def performance(curve: DataFrame, benchmark: DataFrame, rate: float = 0.02) -> DataFrame:
    """One row of figures of a curve (date, equity) against a benchmark (date, r).

    The benchmark is put on the curve's dates: its last return known by then, none before its first.
    """
    w = Window.orderBy("date")
    both = curve.select("date", "equity", F.lit(None).cast("double").alias("b"), F.lit(1).alias("_s")).unionByName(benchmark.select("date", F.lit(None).cast("double").alias("equity"), F.col("r").alias("b"), F.lit(0).alias("_s")))
    seen = F.coalesce(F.last("b", ignorenulls=True).over(Window.orderBy("date", "_s").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    own = both.withColumn("b", seen).where("_s = 1").withColumn("r", sdiv("equity", F.lag("equity").over(w)) - 1)
    gain, lost = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") < 0, F.col("r")))
    return own.agg(
        sdiv(F.count_if(F.col("r") > 0), F.count("r")).alias("win_rate"), sdiv(gain, F.abs(lost)).alias("profit_loss_ratio"),
        F.sum(F.when(F.col("r").isNotNull(), F.col("r") - F.col("b"))).alias("excess_return"),
    )


def long_only(weights: DataFrame) -> DataFrame:
    """Negative weights go, the others add up to one; all zero without any positive one."""
    w = F.greatest(F.col("weight"), F.lit(0.0))
    return weights.withColumn("weight", F.coalesce(sdiv(w, F.sum(w).over(Window.partitionBy())), F.lit(0.0)))


def direction(weight: Column, edge: float = 0.1) -> Column:
    return F.when(weight > edge, "long").when(weight < -edge, "short").otherwise("flat")


def deployment(ratio: Column) -> Column:
    """What to do with idle cash, by its share of the portfolio: (action, ratio)."""
    act = lambda name, share: F.struct(F.lit(name).alias("action"), (ratio * share).alias("ratio"))
    return F.when(ratio < 0.05, act("hold", 0.0)).when(ratio > 0.3, act("repo", 0.8)).otherwise(act("mmf", 0.5))
