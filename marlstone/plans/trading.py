"""Signals, backtests, portfolio and risk queries."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.rolling import series
from marlstone.functions.safe import sdiv
from marlstone.operators import backtest as bt
from marlstone.registry import query

from .factors import FORMULAS, STEPS, panel
from .views import BARS, INDEX, SBARS, bars, index_bars, sbars, table

R = lambda c, n=6: F.round(c, n)
W = "PARTITION BY ticker ORDER BY date"
SIG = f"""{STEPS}, feat AS (SELECT ticker, date, close, volume, amount, {FORMULAS['momentum_20d']} AS momentum, {FORMULAS['rsi_14']} AS rsi FROM s3),
sig AS (SELECT *, coalesce(momentum > 0.05 AND rsi < 70, false) AS en, coalesce(momentum < -0.05 OR rsi > 70, false) AS ex FROM feat)"""


def features(spark, sf_dir):
    own = panel(spark, sf_dir, ["momentum_20d", "rsi_14"])
    return own.select("ticker", "date", "close", "volume", "amount", F.col("momentum_20d").alias("momentum"), F.col("rsi_14").alias("rsi"))


def signals(spark, sf_dir, **how):
    return bt.momentum_signals(features(spark, sf_dir), trend=None, **how)


@query("signals_momentum", f"WITH {SIG} SELECT ticker, date, en, ex FROM sig")
def signals_momentum(spark, sf_dir):
    return signals(spark, sf_dir).select("ticker", "date", "en", "ex")


def _fold(source, key="ticker", impact=False):
    """The recursion over the bars of each key, and its summary, as SQL."""
    more = lambda order: f" + CASE WHEN amount > 0 AND {order} > 0 AND {order} >= 0.01 * amount THEN 0.1 * sqrt({order} / amount) ELSE 0 END" if impact else ""
    ask, bid = f"(close * (1 + 0.001{more('f.cash')}) * 1.001)", f"(close * (1 - (0.001{more('f.shares * close')})) * 0.999)"
    buy, sell, n = "b.en AND f.shares = 0", "b.ex AND f.shares > 0", f"trunc(f.cash / {ask})"
    on = " AND ".join(f"b.{k} = f.{k}" for k in key.split(", "))
    fk = ", ".join(f"f.{k}" for k in key.split(", "))
    return f"""bar AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i FROM {source} WHERE close IS NOT NULL),
f AS (SELECT {key}, CAST(0 AS BIGINT) AS i, 1000000.0::DOUBLE AS cash, 0.0::DOUBLE AS shares, 0.0::DOUBLE AS paid, NULL::DOUBLE AS pnl, NULL::DOUBLE AS v FROM (SELECT DISTINCT {key} FROM bar)
 UNION ALL SELECT {fk}, b.i,
 CASE WHEN {buy} THEN f.cash - {n} * {ask} WHEN {sell} THEN f.cash + f.shares * {bid} ELSE f.cash END,
 CASE WHEN {buy} THEN {n} WHEN {sell} THEN 0 ELSE f.shares END,
 CASE WHEN {buy} THEN {n} * {ask} ELSE f.paid END,
 CASE WHEN NOT ({buy}) AND {sell} THEN f.shares * {bid} - f.paid END,
 CASE WHEN {buy} THEN f.cash - {n} * {ask} + {n} * close WHEN {sell} THEN f.cash + f.shares * {bid} ELSE f.cash + f.shares * close END
 FROM f JOIN bar b ON {on} AND b.i = f.i + 1),
r AS (SELECT *, v / lag(v) OVER (PARTITION BY {key} ORDER BY i) - 1 AS r, v / max(v) OVER (PARTITION BY {key} ORDER BY i) - 1 AS dd FROM f WHERE i > 0),
done AS (SELECT {key}, last(v ORDER BY i) / 1000000 - 1 AS total_return, CASE WHEN stddev_samp(r) >= 1e-10 THEN avg(r) / stddev_samp(r) * sqrt(252) ELSE 0 END AS sharpe_ratio,
 min(dd) AS max_drawdown, CASE WHEN count(pnl) > 0 THEN count_if(pnl > 0) / count(pnl) ELSE 0 END AS win_rate, count(pnl) AS trade_count FROM r GROUP BY {key})"""


_SHOW = "round(total_return, 6) AS total_return, round(sharpe_ratio, 4) AS sharpe_ratio, round(max_drawdown, 6) AS max_drawdown, round(win_rate, 6) AS win_rate, trade_count FROM done"


def _shown(df, *keys):
    return df.select(*keys, R("total_return").alias("total_return"), R("sharpe_ratio", 4).alias("sharpe_ratio"), R("max_drawdown").alias("max_drawdown"), R("win_rate").alias("win_rate"), "trade_count")


@query("backtest_signal", f"WITH RECURSIVE {SIG}, {_fold('sig')} SELECT ticker, {_SHOW}")
def backtest_signal(spark, sf_dir):
    return _shown(bt.summarise(bt.equity(signals(spark, sf_dir), ["ticker"]), ["ticker"]), "ticker")


REAL = f"""{SIG}, c AS (SELECT *, CASE WHEN coalesce(lag(close) OVER ({W}), 0) = 0 THEN 0 ELSE (close - lag(close) OVER ({W})) / abs(lag(close) OVER ({W})) END AS chg FROM sig),
real_ AS (SELECT ticker, date, close, amount, volume = 0 AS suspended, volume <> 0 AND chg >= 0.1 - 1e-6 AS upper, volume <> 0 AND chg <= -(0.1 - 1e-6) AS lower, en AS en0, ex AS ex0,
 en AND NOT (volume = 0 OR chg >= 0.1 - 1e-6) AS en, ex AND NOT (volume = 0 OR chg <= -(0.1 - 1e-6)) AS ex FROM c)"""


@query("realism_filter", f"WITH {REAL} SELECT ticker, CAST(count_if(en0 AND NOT en) AS BIGINT) AS rejected_entries, CAST(count_if(ex0 AND NOT ex) AS BIGINT) AS rejected_exits, CAST(count_if(suspended) AS BIGINT) AS suspended_days, CAST(count_if(upper) AS BIGINT) AS upper_limit_days, CAST(count_if(lower) AS BIGINT) AS lower_limit_days FROM real_ GROUP BY ticker")
def realism_filter(spark, sf_dir):
    r = bt.realism(signals(spark, sf_dir))
    return r.groupBy("ticker").agg(F.count_if("no_entry").alias("rejected_entries"), F.count_if("no_exit").alias("rejected_exits"), F.count_if("suspended").alias("suspended_days"), F.count_if("upper").alias("upper_limit_days"), F.count_if("lower").alias("lower_limit_days"))


@query("backtest_realism", f"WITH RECURSIVE {REAL}, {_fold('real_', impact=True)} SELECT ticker, {_SHOW}")
def backtest_realism(spark, sf_dir):
    return _shown(bt.summarise(bt.equity(bt.realism(signals(spark, sf_dir)), ["ticker"], impact=True), ["ticker"]), "ticker")


@query("impact_slippage", f"WITH {BARS} SELECT ticker, date, round(CASE WHEN amount > 0 AND 50000 >= 0.01 * amount THEN 0.1 * sqrt(50000 / amount) ELSE 0 END, 6) AS impact FROM bars")
def impact_slippage(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", R(bt.impact_slippage(F.lit(50000.0), F.col("amount"))).alias("impact"))


GRID = [(e, x) for e in (0.02, 0.05, 0.1) for x in (-0.05, -0.1)]


_GRID = f"""{SIG}, grid(entry, exit) AS (VALUES {', '.join(f'({e}::DOUBLE, {x}::DOUBLE)' for e, x in GRID)}),
tried AS (SELECT entry, exit, ticker, date, close, coalesce(momentum > entry AND rsi < 70, false) AS en, coalesce(momentum < exit OR rsi > 70, false) AS ex FROM feat, grid)"""


@query("backtest_grid", f"WITH RECURSIVE {_GRID}, {_fold('tried', 'entry, exit, ticker')} SELECT entry, exit, round(avg(total_return), 6) AS mean_return, round(avg(sharpe_ratio), 4) AS mean_sharpe, CAST(sum(trade_count) AS BIGINT) AS trades FROM done GROUP BY ALL")
def backtest_grid(spark, sf_dir):
    """Every pair of thresholds on every brand, one fold each; best Sharpe first."""
    grid = spark.createDataFrame(GRID, "entry double, exit double")
    f = features(spark, sf_dir).crossJoin(F.broadcast(grid))  # a fixed list of parameters
    en = F.coalesce((F.col("momentum") > F.col("entry")) & (F.col("rsi") < 70), F.lit(False))
    ex = F.coalesce((F.col("momentum") < F.col("exit")) | (F.col("rsi") > 70), F.lit(False))
    keys = ["entry", "exit", "ticker"]
    done = bt.summarise(bt.equity(f.withColumns({"en": en, "ex": ex}), keys), keys)
    g = done.groupBy("entry", "exit").agg(R(F.avg("total_return")).alias("mean_return"), R(F.avg("sharpe_ratio"), 4).alias("mean_sharpe"), F.sum("trade_count").alias("trades"))
    return g.orderBy(F.desc("mean_sharpe"), "entry", "exit")


_WALK = f"""{SIG}, num AS (SELECT *, row_number() OVER ({W}) - 1 AS no, count(*) OVER (PARTITION BY ticker) AS n FROM sig),
walk AS (SELECT ticker, k.period, date, close, en, ex FROM num, (SELECT unnest(range(0, 1000)) AS period) k WHERE no >= k.period * 63 + 252 AND no < k.period * 63 + 252 + 63 AND k.period * 63 + 252 + 63 <= n)"""


@query("walk_forward", f"WITH RECURSIVE {_WALK}, {_fold('walk', 'ticker, period')} SELECT ticker, count(*) AS n_periods, round(avg(CASE WHEN sharpe_ratio > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS stability, round(avg(total_return), 6) AS mean_return, round(avg(sharpe_ratio), 4) AS mean_sharpe FROM done GROUP BY ticker")
def walk_forward(spark, sf_dir, train: int = 252, test: int = 63, step: int = 63):
    """Backtests of the test windows, each after a training window; stability is the share of positive Sharpe ratios."""
    w = series()
    own = signals(spark, sf_dir).withColumn("no", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("ticker")))
    # the windows of a bar are those whose test range holds it
    first = F.ceil((F.col("no") - train - test + 1) / step)
    last = F.floor((F.col("no") - train) / step)
    spread = own.where(F.col("no") >= train).withColumn("period", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).where(F.col("period") * step + train + test <= F.col("n"))
    done = bt.summarise(bt.equity(spread, ["ticker", "period"]), ["ticker", "period"])
    return done.groupBy("ticker").agg(F.count("*").alias("n_periods"), R(F.avg((F.col("sharpe_ratio") > 0).cast("int"))).alias("stability"), R(F.avg("total_return")).alias("mean_return"), R(F.avg("sharpe_ratio"), 4).alias("mean_sharpe"))


RET = f"{BARS}, ret AS (SELECT ticker, date, close, close / NULLIF(lag(close) OVER ({W}), 0) - 1 AS r FROM bars)"


def returns(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("ticker", "date", "close", (sdiv("close", F.lag("close").over(series())) - 1).alias("r"))


@query("risk_parity", f"WITH {RET}, v AS (SELECT ticker, 1 / (stddev_samp(r) + 1e-8) AS v FROM ret GROUP BY ticker) SELECT ticker, round(v / sum(v) OVER (), 8) AS weight FROM v")
def risk_parity(spark, sf_dir):
    return bt.inverse_volatility(returns(spark, sf_dir)).withColumn("weight", R("weight", 8))


PORT = f"""{BARS}, {INDEX}, p AS (SELECT date, -0.3::DOUBLE * coalesce(close / NULLIF(lag(close) OVER (ORDER BY date), 0) - 1, 0) AS r FROM index_bars)"""


def portfolio(spark, sf_dir):
    """Three tenths short of the index: some days lose more than all."""
    return bt.portfolio_returns(index_bars(spark, sf_dir).withColumns({"ticker": F.lit("index"), "weight": F.lit(-0.3)}))


@query("drawdown", f"WITH {PORT}, e AS (SELECT date, product(1 + r) OVER (ORDER BY date) AS equity FROM p) SELECT date, round(equity, 4) AS equity, round(equity / max(equity) OVER (ORDER BY date) - 1, 6) AS drawdown FROM e")
def drawdown(spark, sf_dir):
    return bt.compound(portfolio(spark, sf_dir)).select("date", R("equity", 4).alias("equity"), R("drawdown").alias("drawdown"))


@query("backtest_portfolio", f"WITH {PORT}, e AS (SELECT date, r, product(1 + r) OVER (ORDER BY date) AS equity FROM p), d AS (SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM e) SELECT round(last(equity ORDER BY date) - 1, 6) AS total_return, round(avg(r) / stddev_samp(r) * sqrt(252), 4) AS sharpe_ratio, round(min(dd), 6) AS max_drawdown FROM d")
def backtest_portfolio(spark, sf_dir):
    c = bt.compound(portfolio(spark, sf_dir))
    return c.agg(R(F.max_by("equity", "date") - 1).alias("total_return"), R(sdiv(F.avg("r"), F.stddev_samp("r")) * bt.YEAR, 4).alias("sharpe_ratio"), R(F.min("drawdown")).alias("max_drawdown"))


@query("perf_metrics", f"""WITH {PORT}, e AS (SELECT date, product(1 + r) OVER (ORDER BY date) AS equity FROM p), d AS (SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 AS dd, equity / lag(equity) OVER (ORDER BY date) - 1 AS r FROM e),
m AS (SELECT last(equity ORDER BY date) / first(equity ORDER BY date) - 1 AS tr, datediff('day', min(date), max(date)) AS days, min(dd) AS dd, avg(r) AS mu, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down FROM d)
SELECT round(tr, 6) AS total_return, round(CASE WHEN 1 + tr > 0 THEN pow(1 + tr, 365.0::DOUBLE / greatest(days, 1)) END - 1, 6) AS annual_return, round((mu * 252 - 0.02) / (sd * sqrt(252)), 4) AS sharpe, round((mu * 252 - 0.02) / (down * sqrt(252)), 4) AS sortino, round((CASE WHEN 1 + tr > 0 THEN pow(1 + tr, 365.0::DOUBLE / greatest(days, 1)) END - 1) / abs(dd), 4) AS calmar, round(sd * sqrt(252), 6) AS volatility, round(dd, 6) AS max_drawdown FROM m""")
def perf_metrics(spark, sf_dir):
    c = bt.compound(portfolio(spark, sf_dir)).select("date", "equity", "drawdown")
    c = c.withColumn("r", sdiv("equity", F.lag("equity").over(Window.orderBy("date"))) - 1)
    m = c.agg((F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("tr"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.min("drawdown").alias("dd"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"))
    annual = F.when(1 + F.col("tr") > 0, F.pow(1 + F.col("tr"), F.lit(365.0) / F.greatest("days", F.lit(1)))) - 1
    excess = F.col("mu") * 252 - 0.02
    return m.select(R("tr").alias("total_return"), R(annual).alias("annual_return"), R(sdiv(excess, F.col("sd") * bt.YEAR), 4).alias("sharpe"), R(sdiv(excess, F.col("down") * bt.YEAR), 4).alias("sortino"), R(sdiv(annual, F.abs("dd")), 4).alias("calmar"), R(F.col("sd") * bt.YEAR).alias("volatility"), R("dd").alias("max_drawdown"))


SCENARIOS = [("spring", datetime.date(1996, 3, 1), datetime.date(1996, 5, 31)), ("autumn", datetime.date(1998, 9, 1), datetime.date(1998, 11, 30)), ("late", datetime.date(2001, 9, 1), datetime.date(2001, 12, 31)), ("before", datetime.date(1990, 1, 1), datetime.date(1990, 12, 31))]
_SC = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in SCENARIOS)


@query("stress_windows", f"""WITH {PORT}, s(scenario, a, b) AS (VALUES {_SC}), j AS (SELECT scenario, date, r, date <= b AS inside FROM p JOIN s ON date >= a),
e AS (SELECT *, product(1 + r) OVER (PARTITION BY scenario, inside ORDER BY date) AS eq, row_number() OVER (PARTITION BY scenario, inside ORDER BY date) AS no FROM j),
d AS (SELECT *, eq / max(eq) OVER (PARTITION BY scenario, inside ORDER BY date) - 1 AS dd, max(eq) FILTER (inside) OVER (PARTITION BY scenario) AS hi FROM e),
g AS (SELECT scenario, count_if(inside) AS n, last(eq ORDER BY date) FILTER (inside) AS eq, min(dd) FILTER (inside) AS dd, coalesce(min(no) FILTER (NOT inside AND eq >= hi), -1) AS back FROM d GROUP BY scenario)
SELECT s.scenario, round(CASE WHEN coalesce(n, 0) < 5 THEN 0 ELSE eq - 1 END, 6) AS portfolio_return, round(CASE WHEN coalesce(n, 0) < 5 THEN 0 ELSE dd END, 6) AS max_drawdown, CAST(CASE WHEN coalesce(n, 0) < 5 THEN -2 ELSE back END AS INTEGER) AS recovery_days, CASE WHEN coalesce(n, 0) < 5 THEN true ELSE dd > -0.5 END AS survived FROM s LEFT JOIN g ON g.scenario = s.scenario""")
def stress_windows(spark, sf_dir):
    s = bt.stress(portfolio(spark, sf_dir), SCENARIOS)
    return s.withColumns({"portfolio_return": R("portfolio_return"), "max_drawdown": R("max_drawdown")})


BRIN = f"""nat AS (SELECT s_suppkey, n_regionkey AS reg, s_nationkey AS nat FROM supplier JOIN nation ON n_nationkey = s_nationkey),
sec AS (SELECT CAST(nat AS VARCHAR) AS sector, l_returnflag = 'R' AS side, sum(l_extendedprice) AS v, avg(l_discount) - 0.05 AS ret FROM lineitem JOIN nat ON l_suppkey = s_suppkey WHERE l_returnflag IN ('R', 'N') AND NOT (nat = 3 AND l_returnflag = 'R') GROUP BY ALL),
wt AS (SELECT *, v / sum(v) OVER (PARTITION BY side) AS w FROM sec)"""


@query("brinson", f"WITH {BRIN}, pf AS (SELECT * FROM wt WHERE side), bm AS (SELECT * FROM wt WHERE NOT side), j AS (SELECT coalesce(pf.sector, bm.sector) AS sector, coalesce(pf.w, 0) AS wp, coalesce(bm.w, 0) AS wb, coalesce(pf.ret, 0) AS rp, coalesce(bm.ret, 0) AS rb, (SELECT avg(ret) FROM bm) AS rt FROM pf FULL JOIN bm ON pf.sector = bm.sector) SELECT sector, round((wp - wb) * (rb - rt), 8) AS allocation, round(wb * (rp - rb), 8) AS selection, round((wp - wb) * (rp - rb), 8) AS interaction FROM j")
def brinson(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nat"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag in ('R', 'N')").join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("not (nat = 3 and l_returnflag = 'R')")
    sec = li.groupBy(F.col("nat").cast("string").alias("sector"), (F.col("l_returnflag") == "R").alias("side")).agg(F.sum("l_extendedprice").alias("v"), (F.avg("l_discount") - 0.05).alias("ret"))
    wt = sec.withColumn("weight", F.col("v") / F.sum("v").over(Window.partitionBy("side")))
    b = bt.brinson(wt.where("side"), wt.where("not side"))
    return b.select("sector", *[R(c, 8).alias(c) for c in ("allocation", "selection", "interaction")])


@query("rebalance", f"WITH {RET}, o AS (SELECT ticker, 0.04 AS w FROM (SELECT DISTINCT ticker FROM bars) WHERE ticker <> 'Brand#11'), v AS (SELECT ticker, 1 / (stddev_samp(r) + 1e-8) AS v FROM ret WHERE ticker <> 'Brand#22' GROUP BY ticker), t AS (SELECT ticker, v / sum(v) OVER () AS w FROM v), j AS (SELECT coalesce(o.ticker, t.ticker) AS ticker, coalesce(t.w, 0) - coalesce(o.w, 0) AS change FROM o FULL JOIN t ON o.ticker = t.ticker) SELECT ticker, round(change, 6) AS change, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side FROM j WHERE abs(change) > 0.01")
def rebalance(spark, sf_dir):
    r = returns(spark, sf_dir)
    old = r.where("ticker != 'Brand#11'").select("ticker").distinct().withColumn("weight", F.lit(0.04))
    return bt.rebalance(old, bt.inverse_volatility(r.where("ticker != 'Brand#22'"))).select("ticker", R("change").alias("change"), "side")


@query("concentration", f"WITH {BARS}, w AS (SELECT ticker, sum(amount) AS v FROM bars GROUP BY ticker), s AS (SELECT v / sum(v) OVER () AS w FROM w) SELECT round(sum(w * w), 8) AS hhi, round(max(w), 8) AS max_weight FROM s")
def concentration(spark, sf_dir):
    v = bars(spark, sf_dir).groupBy("ticker").agg(F.sum("amount").alias("v"))
    t = v.crossJoin(F.broadcast(v.agg(F.sum("v").alias("t")))).select((F.col("v") / F.col("t")).alias("w"))
    return t.agg(R(F.sum(F.col("w") * F.col("w")), 8).alias("hhi"), R(F.max("w"), 8).alias("max_weight"))


@query("mark_to_market", f"WITH {BARS}, px AS (SELECT ticker, last(close ORDER BY date) AS px FROM bars WHERE ticker <> 'Brand#33' GROUP BY ticker), pos AS (SELECT DISTINCT ticker, 100 AS qty, 900.0::DOUBLE AS cost FROM bars) SELECT round(500000 + sum(coalesce(px, cost) * qty), 4) AS total_value, round(sum((coalesce(px, cost) - cost) * qty), 4) AS unrealised FROM pos LEFT JOIN px ON px.ticker = pos.ticker")
def mark_to_market(spark, sf_dir):
    b = bars(spark, sf_dir)
    px = b.where("ticker != 'Brand#33'").groupBy("ticker").agg(F.max_by("close", "date").alias("px"))
    pos = b.select("ticker", F.lit(100).alias("qty"), F.lit(900.0).alias("cost")).distinct().join(px, "ticker", "left")
    p = F.coalesce("px", "cost")
    return pos.agg(R(500000 + F.sum(p * F.col("qty")), 4).alias("total_value"), R(F.sum((p - F.col("cost")) * F.col("qty")), 4).alias("unrealised"))


@query("decay_alerts", f"""WITH {RET}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM ret WHERE r IS NOT NULL),
a AS (SELECT ticker, avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) FILTER (b <= 20) AS win, (avg(r) FILTER (b <= 20)) / NULLIF(stddev_samp(r) FILTER (b <= 20), 0) * sqrt(252) AS sharpe, avg(r) FILTER (b <= 5) AS m1, avg(r) FILTER (b BETWEEN 6 AND 10) AS m0 FROM n GROUP BY ticker)
SELECT ticker, coalesce(win < 0.55 AND sharpe < 8, false) AS weak, coalesce(m0 > 0 AND m1 < m0 * 0.5, false) AS fading FROM a""")
def decay_alerts(spark, sf_dir):
    n = returns(spark, sf_dir).where("r is not null").withColumn("b", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    of = lambda c, cond: F.when(cond, c)
    last, new, old = F.col("b") <= 20, F.col("b") <= 5, F.col("b").between(6, 10)
    a = n.groupBy("ticker").agg(F.avg(of((F.col("r") > 0).cast("double"), last)).alias("win"), (sdiv(F.avg(of(F.col("r"), last)), F.stddev_samp(of(F.col("r"), last))) * bt.YEAR).alias("sharpe"), F.avg(of(F.col("r"), new)).alias("m1"), F.avg(of(F.col("r"), old)).alias("m0"))
    return a.select("ticker", F.coalesce((F.col("win") < 0.55) & (F.col("sharpe") < 8), F.lit(False)).alias("weak"), F.coalesce((F.col("m0") > 0) & (F.col("m1") < F.col("m0") * 0.5), F.lit(False)).alias("fading"))


@query("calendar_regime", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CASE WHEN month(o_orderdate) <= 4 THEN 'earnings_season' WHEN month(o_orderdate) IN (7, 8) THEN 'earnings_season' WHEN month(o_orderdate) = 12 AND day(o_orderdate) BETWEEN 10 AND 25 THEN 'policy_window' WHEN month(o_orderdate) = 11 AND day(o_orderdate) BETWEEN 10 AND 20 THEN 'policy_window' END AS regime FROM orders")
def calendar_regime(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    m, day = F.month("d"), F.day("d")
    return d.select("d", F.when(m <= 4, "earnings_season").when(m.isin(7, 8), "earnings_season").when((m == 12) & day.between(10, 25), "policy_window").when((m == 11) & day.between(10, 20), "policy_window").alias("regime"))


@query("volatility_regime", f"WITH {RET}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM ret WHERE r IS NOT NULL), v AS (SELECT ticker, stddev_samp(r) FILTER (b <= 20) / NULLIF(stddev_samp(r) FILTER (b <= 60), 0) AS ratio FROM n GROUP BY ticker) SELECT ticker, round(ratio, 6) AS ratio, CASE WHEN ratio > 2 THEN 'extreme_vol' ELSE 'normal' END AS regime, round(CASE WHEN ratio > 2 THEN least(ratio / 4, 1) ELSE 0 END, 6) AS confidence FROM v")
def volatility_regime(spark, sf_dir):
    n = returns(spark, sf_dir).where("r is not null").withColumn("b", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    v = n.groupBy("ticker").agg(sdiv(F.stddev_samp(F.when(F.col("b") <= 20, F.col("r"))), F.stddev_samp(F.when(F.col("b") <= 60, F.col("r")))).alias("ratio"))
    hot = F.col("ratio") > 2
    return v.select("ticker", R("ratio").alias("ratio"), F.when(hot, "extreme_vol").otherwise("normal").alias("regime"), R(F.when(hot, F.least(F.col("ratio") / 4, F.lit(1.0))).otherwise(0.0)).alias("confidence"))


TYPE_WEIGHTS = {"purchase": 1.0, "signup": 0.8, "click": 0.4, "view": 0.2}


@query("event_signals", "SELECT user_id, round(sum(score * conf) / NULLIF(sum(conf), 0), 6) AS score, count(*) AS n FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS conf, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_WEIGHTS.items()) + " ELSE 0.1 END * greatest(1 - datediff('day', CAST(ts AS DATE), DATE '2024-01-31') / 10.0::DOUBLE, 0.1) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-21') GROUP BY user_id")
def event_signals(spark, sf_dir, now=datetime.date(2024, 1, 31), decay: int = 10):
    weight = F.create_map(*[F.lit(x) for kv in TYPE_WEIGHTS.items() for x in kv])
    e = table(spark, sf_dir, "events").where(F.col("ts") >= F.date_sub(F.lit(now), decay).cast("timestamp_ntz"))
    age = F.greatest(1 - F.datediff(F.lit(now), F.to_date("ts")) / float(decay), F.lit(0.1))
    own = e.select("user_id", (F.from_json("props", "k double")["k"] / 100).alias("conf"), (F.coalesce(F.try_element_at(weight, "event_type"), F.lit(0.1)) * age).alias("score"))
    return own.groupBy("user_id").agg(R(sdiv(F.sum(F.col("score") * F.col("conf")), F.sum("conf"))).alias("score"), F.count("*").alias("n"))


VOTES = "votes AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'buy' WHEN event_type = 'view' THEN 'hold' ELSE 'sell' END AS action, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS conf FROM events)"


@query("committee_consensus", f"WITH {VOTES}, t AS (SELECT user_id, action, sum(conf) AS s FROM votes GROUP BY ALL) SELECT user_id, first(action ORDER BY s DESC, action) AS consensus, round(max(s) / NULLIF(sum(s), 0), 6) AS share FROM t GROUP BY user_id")
def committee_consensus(spark, sf_dir):
    action = F.when(F.col("event_type").isin("purchase", "signup"), "buy").when(F.col("event_type") == "view", "hold").otherwise("sell")
    # figures of k are whole, so that their sums are exact in any order and ties and halves do not hang on partitions
    t = table(spark, sf_dir, "events").groupBy("user_id", action.alias("action")).agg(F.sum(F.from_json("props", "k double")["k"]).alias("s"))
    first = F.array_sort(F.collect_list(F.struct(F.col("s").isNull().alias("none"), (-F.col("s")).alias("s"), "action")))[0]["action"]  # three actions at most
    return t.groupBy("user_id").agg(first.alias("consensus"), R(sdiv(F.max("s"), F.sum("s"))).alias("share"))
