"""Risk checks, regimes, strategies, fusion and committee, as queries over the brands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.rolling import series
from marlstone.functions.safe import sdiv
from marlstone.operators import backtest as bt
from marlstone.operators import committee, regime, risk, strategies
from marlstone.registry import query

from .factors import FORMULAS, STEPS, _full, panel
from .trading import _fold, BRIN, PORT, RET, W, portfolio, returns
from .views import BARS, INDEX, bars, index_bars, table

R = lambda c, n=6: F.round(c, n)
NUMBER = "CAST(substr(ticker, 7) AS INTEGER)"

# Orders, portfolio and risk

HELD = f"""{BARS}, held AS (SELECT ticker, sum(amount) / sum(sum(amount)) OVER () AS weight, 'S' || CAST({NUMBER} % 6 AS VARCHAR) AS sector FROM bars GROUP BY ticker),
placed AS (SELECT ticker, weight * 1.5 AS target_weight FROM held WHERE {NUMBER} % 3 = 0 UNION ALL SELECT 'NEW', 0.3::DOUBLE),
traded AS (SELECT ticker, avg(amount) * 900 AS volume FROM bars GROUP BY ticker)"""


def held(spark, sf_dir):
    """(ticker, weight, sector): what each brand's trade makes of the whole."""
    g = bars(spark, sf_dir).groupBy("ticker").agg(F.sum("amount").alias("v"))
    number = F.substring("ticker", 7, 9).cast("int")
    return g.select("ticker", (F.col("v") / F.sum("v").over(Window.partitionBy())).alias("weight"), F.concat(F.lit("S"), (number % 6).cast("string")).alias("sector"))


def placed(spark, sf_dir):
    own = held(spark, sf_dir).where("cast(substring(ticker, 7, 9) as int) % 3 = 0").select("ticker", (F.col("weight") * 1.5).alias("target_weight"))
    return own.unionByName(spark.createDataFrame([("NEW", 0.3)], "ticker string, target_weight double"))


_VIOLATIONS = f"""{HELD}, sec AS (SELECT sector, abs(weight) AS w FROM held UNION ALL SELECT coalesce(h.sector, p.ticker), abs(target_weight) FROM placed p LEFT JOIN held h ON h.ticker = p.ticker),
found AS (SELECT 'blacklist' AS rule, ticker, abs(target_weight) AS value, 'block' AS severity FROM placed WHERE ticker IN ('Brand#3', 'Brand#9')
 UNION ALL SELECT 'single_name', ticker, abs(target_weight), 'warning' FROM placed WHERE abs(target_weight) > 0.05
 UNION ALL SELECT 'sector_exposure', sector, sum(w), 'warning' FROM sec GROUP BY sector HAVING sum(w) > 0.2
 UNION ALL SELECT 'daily_turnover', 'PORTFOLIO', sum(abs(target_weight)) / 2, 'warning' FROM placed HAVING sum(abs(target_weight)) / 2 > 0.1
 UNION ALL SELECT 'liquidity', p.ticker, volume, 'warning' FROM placed p JOIN traded t ON t.ticker = p.ticker WHERE volume < 5e7)"""


def violations(spark, sf_dir):
    volumes = bars(spark, sf_dir).groupBy("ticker").agg((F.avg("amount") * 900).alias("volume"))
    return risk.order_violations(placed(spark, sf_dir), held(spark, sf_dir), volumes, ["Brand#3", "Brand#9"])


@query("order_risk_checks", f"WITH {_VIOLATIONS} SELECT rule, ticker, round(value, 6) AS value, severity FROM found")
def order_risk_checks(spark, sf_dir):
    return violations(spark, sf_dir).withColumn("value", R("value"))


@query("order_risk_passed", f"WITH {_VIOLATIONS} SELECT count(*) AS n_violations, count_if(severity = 'block') = 0 AS passed FROM found")
def order_risk_passed(spark, sf_dir):
    return risk.passed(violations(spark, sf_dir))


@query("order_sectors", f"WITH {HELD} SELECT p.ticker, coalesce(h.sector, p.ticker) AS sector FROM placed p LEFT JOIN held h ON h.ticker = p.ticker")
def order_sectors(spark, sf_dir):
    return risk.order_sectors(placed(spark, sf_dir), held(spark, sf_dir)).select("ticker", "sector")


CURVE = f"{BARS}, {INDEX}, curve AS (SELECT date, 1000000 * close / first_value(close) OVER (ORDER BY date) AS equity FROM index_bars)"


def curve(spark, sf_dir):
    """What a million in the index has become."""
    w = Window.orderBy("date")  # a row a day
    return index_bars(spark, sf_dir).select("date", (1_000_000 * F.col("close") / F.first("close").over(w)).alias("equity"))


@query("breakers", f"WITH {CURVE}, d AS (SELECT date, equity / max(equity) OVER (ORDER BY date) - 1 AS dd, equity / lag(equity) OVER (ORDER BY date) - 1 AS r FROM curve) SELECT date, round(dd, 6) AS drawdown, round(r, 6) AS daily_return, min(dd) OVER (ORDER BY date) < -0.05 AS drawdown_stop, coalesce(r < -0.02, false) AS daily_stop FROM d")
def breakers(spark, sf_dir):
    return risk.breakers(curve(spark, sf_dir)).withColumns({"drawdown": R("drawdown"), "daily_return": R("daily_return")})


@query("vol_target", f"WITH {RET}, c AS (SELECT a.ticker AS a, b.ticker AS b, covar_samp(a.r, b.r) * 252 AS cov FROM ret a JOIN ret b ON a.date = b.date WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL), n AS (SELECT count(DISTINCT ticker) AS n FROM ret), s AS (SELECT sqrt(greatest(sum(cov), 0)) / (SELECT n FROM n) AS sigma FROM c) SELECT DISTINCT ticker, round(least(0.15 / (sigma + 1e-8), 1) / n, 8) AS weight FROM ret, s, n")
def vol_target(spark, sf_dir):
    return risk.volatility_target(returns(spark, sf_dir)).withColumn("weight", R("weight", 8))


@query("covariance", f"WITH {RET} SELECT a.ticker AS a, b.ticker AS b, round(covar_samp(a.r, b.r) * 252, 4) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.ticker <= b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL")
def covariance(spark, sf_dir):
    return risk.covariance(returns(spark, sf_dir)).withColumn("cov", R("cov", 4))


_QUALITY = f"""{STEPS}, q0 AS (SELECT ticker, date, dc AS r, {FORMULAS['momentum_20d']} AS f, lead(close, 5) OVER ({W}) / NULLIF(close, 0) - 1 AS fwd FROM s3),
q AS (SELECT ticker, date, r, CASE WHEN count(r) OVER w = 20 THEN avg(CASE WHEN r > 0 THEN 1.0::DOUBLE WHEN r <= 0 THEN 0 END) OVER w END AS win_rate, CASE WHEN count(r) OVER w = 20 THEN avg(r) OVER w / NULLIF(stddev_samp(r) OVER w, 0) * sqrt(252) END AS sharpe,
 CASE WHEN count(CASE WHEN f IS NOT NULL AND fwd IS NOT NULL THEN 1 END) OVER w = 20 THEN covar_samp(f, fwd) OVER w / NULLIF(stddev_samp(CASE WHEN fwd IS NOT NULL THEN f END) OVER w * stddev_samp(CASE WHEN f IS NOT NULL THEN fwd END) OVER w, 0) END AS ic FROM q0 WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def quality(spark, sf_dir):
    from marlstone.functions import rolling as r

    w = series()
    own = panel(spark, sf_dir, ["momentum_20d"]).withColumns({"r": sdiv("close", F.lag("close").over(w)) - 1, "fwd": sdiv(F.lead("close", 5).over(w), "close") - 1})
    return risk.rolling_quality(own.withColumn("ic", r.corr("momentum_20d", "fwd", 20, w)).select("ticker", "date", "r", "ic"))


@query("rolling_quality", f"WITH {_QUALITY} SELECT ticker, date, round(win_rate, 6) AS win_rate, round(sharpe, 6) AS sharpe, round(ic, 6) AS ic FROM q")
def rolling_quality(spark, sf_dir):
    return quality(spark, sf_dir).select("ticker", "date", R("win_rate").alias("win_rate"), R("sharpe").alias("sharpe"), R("ic").alias("ic"))


@query(
    "decay_report",
    f"""WITH {_QUALITY}, l AS (SELECT ticker, last(win_rate ORDER BY date) AS w, last(sharpe ORDER BY date) AS s FROM q GROUP BY ticker),
i AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM q WHERE ic IS NOT NULL), ig AS (SELECT ticker, count_if(b <= 20 AND abs(ic) < 0.3) AS low, max(ic) FILTER (b = 1) AS new, max(ic) FILTER (b = 20) AS old FROM i GROUP BY ticker),
m AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM q WHERE r IS NOT NULL), mg AS (SELECT ticker, count(*) AS n, avg(r) FILTER (b <= 5) AS m1, avg(r) FILTER (b BETWEEN 6 AND 10) AS m0 FROM m GROUP BY ticker),
j AS (SELECT l.ticker, coalesce(w < 0.55 AND s < 8, false) AS weak, coalesce(low >= 20, false) AS low_ic, coalesce(old > 0 AND new < 0, false) AS flipped, coalesce(n >= 10 AND m0 > 0 AND m1 < m0 * 0.5, false) AS fading FROM l LEFT JOIN ig ON ig.ticker = l.ticker LEFT JOIN mg ON mg.ticker = l.ticker)
SELECT *, CASE WHEN weak OR flipped THEN 'critical' WHEN low_ic OR fading THEN 'warning' ELSE 'ok' END AS level FROM j""",
)
def decay_report(spark, sf_dir):
    return risk.decay(quality(spark, sf_dir), win=0.55, sharpe=8.0, ic=0.3)


@query("benchmark_excess", f"WITH {PORT}, e AS (SELECT date, 1000000 * product(1 - r / 3) OVER (ORDER BY date) AS equity FROM p WHERE month(date) <> 2), c AS (SELECT date, equity / lag(equity) OVER (ORDER BY date) - 1 AS r FROM e), b AS (SELECT date, r AS b FROM p WHERE day(date) <> 1), j AS (SELECT c.date, c.r, coalesce(b.b, 0) AS b FROM c ASOF LEFT JOIN b ON c.date >= b.date) SELECT round(count_if(r > 0) / NULLIF(count(r), 0), 6) AS win_rate, round(avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)), 6) AS profit_loss_ratio, round(sum(r - b), 6) AS excess_return FROM j")
def benchmark_excess(spark, sf_dir):
    p = portfolio(spark, sf_dir)
    own = bt.compound(p.where(F.month("date") != 2).withColumn("r", -F.col("r") / 3)).select("date", (1_000_000 * F.col("equity")).alias("equity"))
    f = risk.performance(own, p.where(F.dayofmonth("date") != 1))
    return f.select(*[R(c).alias(c) for c in f.columns])


@query("stress_by_ticker", f"""WITH {RET}, s(scenario, a, b) AS (VALUES ('spring', DATE '1996-03-01', DATE '1996-05-31'), ('autumn', DATE '1998-09-01', DATE '1998-11-30')), k AS (SELECT ticker FROM ret GROUP BY ticker HAVING count(r) >= 252),
j AS (SELECT ticker, scenario, date, coalesce(r, 0) / 100 AS r FROM ret SEMI JOIN k USING (ticker) JOIN s ON date BETWEEN a AND b), e AS (SELECT *, product(1 + r) OVER (PARTITION BY ticker, scenario ORDER BY date) AS eq FROM j), d AS (SELECT *, eq / max(eq) OVER (PARTITION BY ticker, scenario ORDER BY date) - 1 AS dd FROM e)
SELECT ticker, scenario, round(last(eq ORDER BY date) - 1, 6) AS period_return, round(min(dd), 6) AS max_drawdown FROM d GROUP BY ALL HAVING count(*) >= 5""")
def stress_by_ticker(spark, sf_dir):
    """A hundredth in each brand with 252 returns or more, through two windows."""
    import datetime

    r = returns(spark, sf_dir).withColumn("n", F.count("r").over(Window.partitionBy("ticker"))).where("n >= 252")
    windows = spark.createDataFrame([("spring", datetime.date(1996, 3, 1), datetime.date(1996, 5, 31)), ("autumn", datetime.date(1998, 9, 1), datetime.date(1998, 11, 30))], "scenario string, a date, b date")
    j = r.join(F.broadcast(windows), F.col("date").between(F.col("a"), F.col("b"))).withColumn("r", F.coalesce("r", F.lit(0.0)) / 100)
    g = bt.compound(j, "r", "ticker", "scenario").groupBy("ticker", "scenario").agg(F.count("*").alias("n"), R(F.max_by("equity", "date") - 1).alias("period_return"), R(F.min("drawdown")).alias("max_drawdown"))
    return g.where("n >= 5").drop("n")


# Regimes and indicators

_ADX = f"""{BARS}, a1 AS (SELECT *, high - lag(high) OVER ({W}) AS up, lag(low) OVER ({W}) - low AS down, lag(close) OVER ({W}) AS prev FROM bars),
a2 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS minus, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM a1),
a3 AS (SELECT *, 100 * ({_full('avg', 'plus', 14)}) / NULLIF({_full('avg', 'tr', 14)}, 0) AS p, 100 * ({_full('avg', 'minus', 14)}) / NULLIF({_full('avg', 'tr', 14)}, 0) AS m FROM a2),
a4 AS (SELECT *, 100 * abs(p - m) / (p + m + 1e-8) AS dx FROM a3), adx AS (SELECT ticker, date, high, low, close, {_full('avg', 'dx', 14)} AS adx FROM a4)"""


@query("adx", f"WITH {_ADX} SELECT ticker, date, round(adx, 6) AS adx FROM adx")
def adx(spark, sf_dir):
    return regime.adx(bars(spark, sf_dir)).select("ticker", "date", R("adx").alias("adx"))


_REGIME = f"""{_ADX}, n0 AS (SELECT *, close / NULLIF(lag(close) OVER ({W}), 0) - 1 AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM adx),
g AS (SELECT ticker, count(*) AS n, count(r) AS nr, stddev_samp(r) FILTER (b <= 20) AS short, stddev_samp(r) FILTER (b <= 60) AS long, max(adx) FILTER (b = 1) AS adx, max(high) FILTER (b <= 20) AS hi, min(low) FILTER (b <= 20) AS lo, max(close) FILTER (b = 1) AS close FROM n0 GROUP BY ticker),
reg AS (SELECT ticker, CASE WHEN n < 60 THEN 'oscillating' WHEN nr >= 60 AND short / NULLIF(long, 0) > 2 THEN 'extreme_volatility' WHEN adx IS NULL THEN 'oscillating' WHEN adx > 25 AND (hi - lo) / close > 0.03 THEN 'trend' ELSE 'oscillating' END AS regime,
 CASE WHEN n < 60 THEN 0.3 WHEN nr >= 60 AND short / NULLIF(long, 0) > 2 THEN least(short / long / 4, 1) WHEN adx IS NULL THEN 0.4 WHEN adx > 25 AND (hi - lo) / close > 0.03 THEN least((adx - 25) / 30 + 0.5, 0.95) ELSE greatest(0.35, 0.7 - adx / 50) END AS confidence FROM g)"""


def regimes_now(spark, sf_dir):
    """Regimes on a day whose date decides nothing."""
    import datetime

    return regime.regimes(bars(spark, sf_dir), F.lit(datetime.date(2001, 10, 5)))


@query("regime", f"WITH {_REGIME} SELECT ticker, regime, round(confidence, 6) AS confidence FROM reg")
def regime_q(spark, sf_dir):
    return regimes_now(spark, sf_dir).withColumn("confidence", R("confidence"))


@query("regime_60", f"WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM bars), g AS (SELECT ticker, count(*) AS n, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS ret FROM n WHERE b <= 60 GROUP BY ticker) SELECT ticker, CASE WHEN n < 60 THEN 'unknown' WHEN ret > 0.05 THEN 'uptrend' WHEN ret < -0.05 THEN 'downtrend' ELSE 'rangebound' END AS regime FROM g")
def regime_60(spark, sf_dir):
    return regime.trend_60(bars(spark, sf_dir))


_SW = "sw(regime, w) AS (VALUES " + ", ".join(f"('{k}', {list(v)}::DOUBLE[])" for k, v in regime.WEIGHTS.items()) + ")"


@query("regime_weights", f"WITH {_REGIME}, {_SW} SELECT ticker, w[1] AS market_data, w[2] AS factor_signals, w[3] AS news_events, w[4] AS wiki, w[5] AS facts FROM reg JOIN sw ON sw.regime = reg.regime")
def regime_weights(spark, sf_dir):
    w = regime.source_weights(F.col("regime"))
    return regimes_now(spark, sf_dir).select("ticker", *[w[i].alias(n) for i, n in enumerate(regime.SOURCES)])


_RSI = f"{_full('avg', 'gain', 14)}", f"{_full('avg', 'loss', 14)}"
_IND = f"""{STEPS}, i1 AS (SELECT *, CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN up END AS gain, CASE WHEN lag(close) OVER ({W}) IS NOT NULL THEN down END AS loss FROM s3),
ind AS (SELECT ticker, date, open, high, low, close, volume, macd AS dif, sig AS dea, 2 * (macd - sig) AS macd_bar, dc AS ret, 100 - 100 / (1 + ({_RSI[0]}) / NULLIF({_RSI[1]}, 0)) AS rsi, ({_full('stddev_samp', 'dc', 20)}) * sqrt(252) AS volatility,
 {_full('avg', 'volume', 20)} AS vol_ma20, {_full('avg', 'volume', 60)} AS vol_ma60, {', '.join(f"{_full('avg', 'close', n)} AS ma{n}" for n in (5, 10, 20, 60, 120))} FROM i1)"""
_SHOWN = ("ma5", "ma20", "ma120", "rsi", "dif", "dea", "macd_bar", "volatility", "vol_ma20", "vol_ma60")


@query("indicators", f"WITH {_IND} SELECT ticker, date, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN)} FROM ind")
def indicators(spark, sf_dir):
    return regime.indicators(bars(spark, sf_dir)).select("ticker", "date", *[R(c).alias(c) for c in _SHOWN])


# Strategies

RULES = {"momentum": ("momentum_20d > 0.05", "momentum_20d < -0.02"), "reversal": ("reversal_20d > 0.05", "reversal_20d < 0.025"), "sentiment": ("momentum_5d > 0.03", "momentum_5d < -0.015"), "regime_switch": ("momentum_20d > 0.03 AND momentum_5d > 0", "momentum_20d < -0.02")}
_FEATURES = ("momentum_20d", "reversal_20d", "momentum_5d", "rsi_14", "volume_ratio_20d", "ma_deviation_20", "ma_deviation_60")
_FEAT = f"{STEPS}, ft AS (SELECT ticker, date, close, amount, " + ", ".join(f"{FORMULAS[n]} AS {n}" for n in _FEATURES) + " FROM s3)"
_ANY = " UNION ALL ".join(f"SELECT '{k}' AS strategy, ticker, CAST(count_if({en}) AS BIGINT) AS entries, CAST(count_if({ex}) AS BIGINT) AS exits FROM ft GROUP BY ticker" for k, (en, ex) in RULES.items())


@query("strategy_signals", f"WITH {_FEAT} {_ANY}")
def strategy_signals(spark, sf_dir):
    own = panel(spark, sf_dir, list(_FEATURES))
    sets = [strategies.signals(own, n).groupBy(F.lit(n).alias("strategy"), "ticker").agg(F.count_if("en").alias("entries"), F.count_if("ex").alias("exits")) for n in strategies.REGISTRY]
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out


_TRIED = " UNION ALL ".join(f"SELECT '{k}' AS strategy, ticker, date, close, coalesce({en}, false) AS en, coalesce({ex}, false) AS ex FROM ft" for k, (en, ex) in RULES.items())
_OUTCOME = "CASE WHEN n_bars < 60 THEN 'too_short' WHEN entries = 0 THEN 'no_entry' ELSE 'run' END"


@query("batch_backtest", f"""WITH RECURSIVE {_FEAT}, tried AS ({_TRIED}), n AS (SELECT strategy, ticker, count(close) AS n_bars, count_if(en) AS entries FROM tried GROUP BY ALL), ok AS (SELECT t.* FROM tried t JOIN n ON n.strategy = t.strategy AND n.ticker = t.ticker WHERE {_OUTCOME} = 'run'),
{_fold('ok', 'strategy, ticker')} SELECT n.strategy, n.ticker, {_OUTCOME} AS outcome, round(ln(1 + total_return), 6) AS log_return, round(sharpe_ratio, 4) AS sharpe_ratio, round(max_drawdown, 6) AS max_drawdown, round(win_rate, 6) AS win_rate, trade_count FROM n LEFT JOIN done d ON d.strategy = n.strategy AND d.ticker = n.ticker""")
def batch_backtest(spark, sf_dir):
    """Every strategy over every brand, and why some are left out."""
    b = bt.batch(panel(spark, sf_dir, list(_FEATURES)), list(strategies.REGISTRY))
    return b.select("strategy", "ticker", "outcome", R(F.ln(1 + F.col("total_return"))).alias("log_return"), R("sharpe_ratio", 4).alias("sharpe_ratio"), R("max_drawdown").alias("max_drawdown"), R("win_rate").alias("win_rate"), "trade_count")


_TREND = "(close / (1 + ma_deviation_20)) / NULLIF(close / (1 + ma_deviation_60), 0) - 1"
_MW = f"""{_FEAT}, mw AS (SELECT ticker, date, momentum_20d AS mo, CASE WHEN momentum_20d > 0.05 AND rsi_14 < 70 AND volume_ratio_20d > 0.8 AND {_TREND} > 0 THEN 1 WHEN momentum_20d < -0.02 OR rsi_14 > 70 THEN 2 ELSE 3 END AS k FROM ft),
mwt AS (SELECT ticker, date, CASE k WHEN 1 THEN least(greatest(mo * 5, 0.3), 1) WHEN 2 THEN -0.3 ELSE 0 END AS weight, CASE k WHEN 1 THEN least(mo * 3 + 0.3, 0.95) WHEN 2 THEN 0.7 ELSE 0.3 END AS confidence FROM mw)"""


def momentum_weights_of(spark, sf_dir):
    own = panel(spark, sf_dir, list(_FEATURES))
    trend = sdiv(F.col("close") / (1 + F.col("ma_deviation_20")), F.col("close") / (1 + F.col("ma_deviation_60"))) - 1
    w = strategies.momentum_weight(F.col("momentum_20d"), F.col("rsi_14"), F.col("volume_ratio_20d"), trend)
    return own.select("ticker", "date", w.alias("w")).select("ticker", "date", "w.weight", "w.confidence")


@query("momentum_weights", f"WITH {_MW} SELECT ticker, date, round(weight, 6) AS weight, round(confidence, 6) AS confidence FROM mwt")
def momentum_weights(spark, sf_dir):
    return momentum_weights_of(spark, sf_dir).withColumns({"weight": R("weight"), "confidence": R("confidence")})


@query("position_sizes", f"WITH {_MW}, l AS (SELECT ticker, last(weight ORDER BY date) AS score FROM mwt GROUP BY ticker), b AS (SELECT * FROM l WHERE score > 0 ORDER BY score DESC, ticker LIMIT 10) SELECT ticker, round(least(least(1.0::DOUBLE / count(*) OVER (), 0.05) * score / 0.6, 0.05), 6) AS weight FROM b")
def position_sizes(spark, sf_dir):
    last = momentum_weights_of(spark, sf_dir).groupBy("ticker").agg(F.max_by("weight", "date").alias("score"))
    return strategies.position_sizes(last).withColumn("weight", R("weight"))


@query("target_weights", f"WITH {_MW}, l AS (SELECT ticker, last(weight ORDER BY date) AS w FROM mwt GROUP BY ticker) SELECT ticker, CASE WHEN w > 0.1 THEN 'long' WHEN w < -0.1 THEN 'short' ELSE 'flat' END AS direction, round(coalesce(greatest(w, 0) / NULLIF(sum(greatest(w, 0)) OVER (), 0), 0), 6) AS weight, round(1.0::DOUBLE / count(*) OVER (), 6) AS equal FROM l")
def target_weights(spark, sf_dir):
    last = momentum_weights_of(spark, sf_dir).groupBy("ticker").agg(F.max_by("weight", "date").alias("weight"))
    own = last.withColumns({"direction": risk.direction(F.col("weight")), "equal": R(F.lit(1.0) / F.count("*").over(Window.partitionBy()))})
    return risk.long_only(own).withColumn("weight", R("weight"))


@query("cash_deployment", "SELECT c_custkey, CASE WHEN r < 0.05 THEN 'hold' WHEN r > 0.3 THEN 'repo' ELSE 'mmf' END AS action, CASE WHEN r < 0.05 THEN r * 0.0::DOUBLE WHEN r > 0.3 THEN r * 0.8::DOUBLE ELSE r * 0.5::DOUBLE END AS ratio FROM (SELECT c_custkey, greatest(c_acctbal, 0) / 10000 AS r FROM customer)")
def cash_deployment(spark, sf_dir):
    act = risk.deployment(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10000)
    return table(spark, sf_dir, "customer").select("c_custkey", act.alias("a")).select("c_custkey", "a.action", "a.ratio")


_READ = "rd AS (SELECT CASE event_type WHEN 'view' THEN 'other' WHEN 'click' THEN 'news' ELSE 'social' END AS source, CASE event_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS sentiment, CAST(json_extract(props, '$.k') AS DOUBLE) / 100 AS confidence, (event_id % 11) / 10.0::DOUBLE AS bull_ratio, (event_id % 7) / 7.0::DOUBLE AS bear_ratio, CASE WHEN user_id % 5 > 0 THEN ['T' || CAST(user_id % 20 AS VARCHAR), 'T' || CAST(user_id % 7 AS VARCHAR)] ELSE [] END AS tickers FROM events)"


@query("sentiment_signals", f"""WITH {_READ}, w AS (SELECT *, CASE source WHEN 'social' THEN 0.6 ELSE 0.4 END AS w FROM rd WHERE source <> 'other' AND confidence >= 0.3),
f AS (SELECT *, (sentiment = 'bullish' AND bull_ratio > 0.8) OR (sentiment = 'bearish' AND bear_ratio > 0.8) AS flips, CASE sentiment WHEN 'bullish' THEN bull_ratio * w WHEN 'bearish' THEN -bear_ratio * w ELSE 0 END AS plain FROM w),
s AS (SELECT greatest(least(CASE WHEN flips AND sentiment = 'bullish' THEN -abs(plain) * 0.5 WHEN flips THEN abs(plain) * 0.5 ELSE plain END, 0.6), -0.6) AS score, confidence * CASE WHEN flips THEN 0.7 ELSE 1 END AS confidence, unnest(CASE WHEN len(tickers) > 0 THEN tickers ELSE ['000300'] END) AS ticker FROM f),
g AS (SELECT ticker, avg(score) AS score, avg(confidence) AS confidence FROM s GROUP BY ticker)
SELECT ticker, round(score, 6) AS score, round(confidence, 6) AS confidence, CASE WHEN score > 0.05 THEN 'long' WHEN score < -0.05 THEN 'short' ELSE 'flat' END AS direction, CASE WHEN abs(score) > 0.2 THEN 'moderate' ELSE 'weak' END AS strength FROM g""")
def sentiment_signals(spark, sf_dir):
    id_, user = F.col("event_id"), F.col("user_id")
    name = lambda k: F.concat(F.lit("T"), (user % k).cast("string"))
    own = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "view", "other").when(F.col("event_type") == "click", "news").otherwise("social").alias("source"),
        F.when(id_ % 3 == 0, "bullish").when(id_ % 3 == 1, "bearish").otherwise("neutral").alias("sentiment"), (F.from_json("props", "k double")["k"] / 100).alias("confidence"),
        ((id_ % 11) / 10.0).alias("bull_ratio"), ((id_ % 7) / 7.0).alias("bear_ratio"), F.when(user % 5 > 0, F.array(name(20), name(7))).otherwise(F.array().cast("array<string>")).alias("tickers"),
    )
    return strategies.sentiment_signals(own, {"social": 0.6, "news": 0.4}).withColumns({"score": R("score"), "confidence": R("confidence")})


# Fusion and committee: what is known of each brand at its last bar

_TAIL = _REGIME.removeprefix(BARS)
_SNAP = f"""{_FEAT}{_TAIL}, lastf AS (SELECT ticker, {', '.join(f'last({c} ORDER BY date) AS {c}' for c in _FEATURES)}, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS pct FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM ft) WHERE b <= 2 GROUP BY ticker),
nws AS (SELECT user_id % 25 + 1 AS no, count(*) AS n, count_if(event_type IN ('purchase', 'signup')) AS pos, count_if(event_type = 'click') AS neg FROM events GROUP BY 1),
dcs AS (SELECT o_custkey % 25 + 1 AS no, count(*) AS n, count_if(o_orderstatus = 'F') AS ok, count_if(o_orderdate >= DATE '2001-07-15') AS facts FROM orders GROUP BY 1),
snap AS (SELECT l.ticker, reg.regime, pct AS pct_change, CASE WHEN momentum_20d IS NOT NULL THEN [momentum_5d, momentum_20d] END AS momenta, [rsi_14] AS rsis, {' + '.join(f'CAST({c} IS NOT NULL AS INTEGER)' for c in _FEATURES)} AS n_factors,
 nws.n AS n_news, pos AS n_positive, neg AS n_negative, CASE WHEN {NUMBER} % 7 <> 0 THEN ({NUMBER} % 10) / 10.0::DOUBLE END AS wiki_score, facts AS n_facts, CASE WHEN {NUMBER} % 11 <> 0 THEN [round(momentum_20d / 10, 2), ({NUMBER} % 4) / 4.0::DOUBLE - 0.3] END AS weights,
 -({NUMBER} % 8) / 100.0::DOUBLE AS drawdown, CASE WHEN {NUMBER} % 5 <> 0 THEN dcs.n END AS n_decisions, CASE WHEN {NUMBER} % 5 <> 0 THEN ok END AS n_correct
 FROM (SELECT *, ticker FROM lastf) l JOIN reg ON reg.ticker = l.ticker LEFT JOIN nws ON nws.no = CAST(substr(l.ticker, 7) AS INTEGER) LEFT JOIN dcs ON dcs.no = CAST(substr(l.ticker, 7) AS INTEGER))""".replace(f"CASE WHEN {NUMBER}", "CASE WHEN CAST(substr(l.ticker, 7) AS INTEGER)").replace(f"({NUMBER}", "(CAST(substr(l.ticker, 7) AS INTEGER)")


def snapshots(spark, sf_dir):
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    own = panel(spark, sf_dir, list(_FEATURES)).withColumn("b", F.row_number().over(back)).where("b <= 2")
    last = own.groupBy("ticker").agg(*[F.max_by(c, "date").alias(c) for c in _FEATURES], (sdiv(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("pct_change"))
    no = F.substring("ticker", 7, 9).cast("int")
    kind = F.col("event_type")
    news = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 25 + 1).alias("no")).agg(F.count("*").alias("n_news"), F.count_if(kind.isin("purchase", "signup")).alias("n_positive"), F.count_if(kind == "click").alias("n_negative"))
    day = F.col("o_orderdate") >= F.lit("2001-07-15").cast("date")
    done = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 25 + 1).alias("no")).agg(F.count("*").alias("n_decisions"), F.count_if(F.col("o_orderstatus") == "F").alias("n_correct"), F.count_if(day).alias("n_facts"))
    j = last.withColumn("no", no.cast("long")).join(regimes_now(spark, sf_dir).select("ticker", "regime"), "ticker").join(news, "no", "left").join(done, "no", "left")
    known = sum((F.col(c).isNotNull().cast("int") for c in _FEATURES[1:]), F.col(_FEATURES[0]).isNotNull().cast("int"))
    unless = lambda k, c: F.when(F.col("no") % k != 0, c)
    return j.select(
        "ticker", "regime", "pct_change", F.when(F.col("momentum_20d").isNotNull(), F.array("momentum_5d", "momentum_20d")).alias("momenta"), F.array("rsi_14").alias("rsis"), known.alias("n_factors"), "n_news", "n_positive", "n_negative",
        unless(7, F.col("no") % 10 / 10.0).alias("wiki_score"), "n_facts", unless(11, F.array(F.round(F.col("momentum_20d") / 10, 2), F.col("no") % 4 / 4.0 - 0.3)).alias("weights"),
        (-(F.col("no") % 8) / 100.0).alias("drawdown"), unless(5, F.col("n_decisions")).alias("n_decisions"), unless(5, F.col("n_correct")).alias("n_correct"),
    )


_LEAN = "CASE WHEN {0} > {1} THEN 'bullish' WHEN {0} < {2} THEN 'bearish' ELSE 'neutral' END"
_FUSED = f"""{_SNAP}, {_SW},
f1 AS (SELECT s.*, coalesce(w, {list(committee.BASE)}::DOUBLE[]) AS bw, CASE WHEN pct_change IS NOT NULL THEN 0.9 ELSE 0 END AS q0, CASE WHEN momenta IS NOT NULL THEN least(n_factors / 15.0::DOUBLE, 1) ELSE 0 END AS q1, CASE WHEN n_news > 0 THEN least(n_news / 5.0::DOUBLE, 1) ELSE 0 END AS q2, coalesce(wiki_score, 0) AS q3, CASE WHEN n_facts > 0 THEN least(n_facts / 10.0::DOUBLE, 1) ELSE 0 END AS q4 FROM snap s LEFT JOIN sw ON sw.regime = s.regime),
f2 AS (SELECT *, bw[1] * q0 AS a0, bw[2] * q1 AS a1, bw[3] * q2 AS a2, bw[4] * q3 AS a3, bw[5] * q4 AS a4 FROM f1),
f3 AS (SELECT *, {', '.join(f'a{i} / NULLIF(a0 + a1 + a2 + a3 + a4, 0) AS b{i}' for i in range(5))}, coalesce(abs(pct_change) > 0.095, false) AS wild FROM f2),
f4 AS (SELECT *, b0 + CASE WHEN wild THEN b1 * 0.1 + b2 * 0.5 ELSE b1 + b2 END + b3 + b4 AS tot FROM f3),
f5 AS (SELECT *, CASE WHEN wild THEN b0 / tot ELSE b0 END AS w_price, CASE WHEN wild THEN b1 * 0.1 / tot ELSE b1 END AS w_factors, CASE WHEN wild THEN b2 * 0.5 / tot ELSE b2 END AS w_news, CASE WHEN wild THEN b3 / tot ELSE b3 END AS w_wiki, CASE WHEN wild THEN b4 / tot ELSE b4 END AS w_facts,
 {_LEAN.format('pct_change', 0.01, -0.01)} AS dp, {_LEAN.format('(len(list_filter(momenta, lambda x: x > 0.02)) + len(list_filter(rsis, lambda x: x > 30)) - len(list_filter(momenta, lambda x: x < -0.02)))', 0, 0)} AS df, {_LEAN.format('(n_positive - n_negative)', 0, 0)} AS dn,
 {_LEAN.format('pct_change', 0.02, -0.02)} AS sp, CASE WHEN n_positive / n_news > 0.5 THEN 'bullish' WHEN n_negative / n_news > 0.5 THEN 'bearish' ELSE 'neutral' END AS sn, list_avg(momenta) AS mm FROM f4),
f6 AS (SELECT *, list_filter([CASE WHEN momenta IS NOT NULL AND dp <> df AND dp <> 'neutral' AND df <> 'neutral' THEN 'price_against_factors' END, CASE WHEN n_news > 0 AND momenta IS NOT NULL AND dn <> df AND dn <> 'neutral' AND df <> 'neutral' THEN 'news_against_factors' END], lambda x: x IS NOT NULL) AS conflicts,
 {', '.join(f"CASE WHEN sp = '{d}' THEN w_price ELSE 0 END + CASE WHEN n_news > 0 AND sn = '{d}' THEN w_news ELSE 0 END + CASE WHEN momenta IS NULL THEN 0 ELSE w_factors * CASE WHEN mm > 0.03 THEN {int(d == 'bullish')} WHEN mm < -0.03 THEN {int(d == 'bearish')} ELSE " + ("0.5" if d == 'neutral' else f"CASE WHEN (mm > 0) = {'true' if d == 'bullish' else 'false'} THEN 0.5 ELSE 0 END") + f" END END AS s_{d}" for d in committee.SIDES)} FROM f5),
f7 AS (SELECT *, s_bullish + s_bearish + s_neutral AS ts, greatest(s_bullish, s_bearish, s_neutral) AS ms FROM f6),
fused AS (SELECT *, CASE WHEN ts > 0 THEN CASE WHEN s_bullish = ms THEN 'bullish' WHEN s_bearish = ms THEN 'bearish' ELSE 'neutral' END ELSE 'neutral' END AS direction, CASE WHEN ts > 0 THEN ms / ts ELSE 0.3 END AS raw FROM f7)"""


@query("fusion_snapshot", f"WITH {_FUSED} SELECT ticker, regime, round(w_price, 6) AS w_price, round(w_factors, 6) AS w_factors, round(w_news, 6) AS w_news, round(w_wiki, 6) AS w_wiki, round(w_facts, 6) AS w_facts, direction, round(least(raw, 0.95), 6) AS confidence, CASE WHEN ts > 0 AND raw > 0.7 THEN 'strong' WHEN raw > 0.4 THEN 'moderate' ELSE 'weak' END AS strength, array_to_string(conflicts, ',') AS conflicts, wild AS near_limit FROM fused")
def fusion_snapshot(spark, sf_dir):
    f = committee.fuse(snapshots(spark, sf_dir))
    return f.select("ticker", "regime", *[R(c).alias(c) for c in ("w_price", "w_factors", "w_news", "w_wiki", "w_facts")], "direction", R("confidence").alias("confidence"), "strength", F.array_join("conflicts", ",").alias("conflicts"), F.array_contains("warnings", "near_limit").alias("near_limit"))


@query("fusion_intelligence", f"WITH {_FUSED}, x AS (SELECT *, CASE WHEN CAST(substr(ticker, 7) AS INTEGER) % 2 = 0 THEN 'bullish' ELSE 'bearish' END AS idir, CAST(substr(ticker, 7) AS INTEGER) % 9 = 0 AS ext FROM fused) SELECT ticker, direction, round(CASE WHEN NOT ext AND idir = direction THEN least(least(raw, 0.95) + 0.08, 0.95) ELSE least(raw, 0.95) END, 6) AS confidence, CASE WHEN ext THEN 'extreme_intelligence' WHEN direction <> 'neutral' AND idir <> direction THEN 'intelligence_against' ELSE '' END AS note FROM x")
def fusion_intelligence(spark, sf_dir):
    no = F.substring("ticker", 7, 9).cast("int")
    f = committee.fuse(snapshots(spark, sf_dir)).withColumns({"intel_direction": F.when(no % 2 == 0, "bullish").otherwise("bearish"), "intel_confidence": F.lit(0.8), "intel_tags": F.when(no % 9 == 0, F.array(F.lit("black_swan"))).otherwise(F.array().cast("array<string>"))})
    w = committee.with_intelligence(f)
    note = F.filter("warnings", lambda x: x.contains("intelligence"))
    return w.select("ticker", "direction", R("confidence").alias("confidence"), F.array_join(note, ",").alias("note"))


_TW = "list_sum(ww)"
_VOTES = f"""{_FUSED}, v0 AS (SELECT *, coalesce(weights, []::DOUBLE[]) AS ww, CAST(pct_change IS NOT NULL AS INTEGER) + CAST(momenta IS NOT NULL AS INTEGER) + CAST(coalesce(n_news > 0, false) AS INTEGER) + CAST(wiki_score IS NOT NULL AS INTEGER) + CAST(coalesce(n_facts > 0, false) AS INTEGER) AS there FROM fused),
v1 AS (SELECT *, list_filter([CASE WHEN pct_change IS NULL THEN 'no_price' END, CASE WHEN abs(pct_change) > 0.095 THEN 'abnormal_move' END, CASE WHEN momenta IS NULL THEN 'no_factors' END], lambda x: x IS NOT NULL) AS di,
 len(list_filter(ww, lambda x: x > 0.1)) AS longs, len(list_filter(ww, lambda x: x < -0.1)) AS shorts, len(list_filter(ww, lambda x: abs(x) <= 0.1)) AS flats, CASE WHEN {_TW} > 0.1 THEN 'bullish' WHEN {_TW} < -0.1 THEN 'bearish' ELSE 'neutral' END AS side, n_correct / n_decisions AS acc FROM v0),
v2 AS (SELECT *, list_filter([CASE WHEN shorts > 0 THEN 'short_signals' END, CASE WHEN side <> 'neutral' AND direction <> 'neutral' AND side <> direction THEN 'signals_against_fusion' END], lambda x: x IS NOT NULL) AS si,
 list_concat(list_filter([CASE WHEN list_max(list_transform(ww, lambda x: abs(x))) > 0.5 THEN 'single_weight' END, CASE WHEN list_sum(list_transform(ww, lambda x: abs(x))) > 1 THEN 'exposure' END, CASE WHEN drawdown < -0.05 THEN 'drawdown' END, CASE WHEN regime = 'extreme_volatility' THEN 'extreme_volatility' END], lambda x: x IS NOT NULL), conflicts) AS ri FROM v1),
v3 AS (SELECT *, CASE WHEN there >= 4 AND len(di) = 0 THEN ('bullish', 0.9) WHEN there >= 2 THEN ('hold', 0.5) ELSE ('caution', 0.3) END AS d, CASE WHEN there >= 4 AND len(di) = 0 THEN [] ELSE di END AS dfl,
 CASE WHEN len(ww) = 0 THEN ('hold', 0.3) WHEN longs > flats AND len(si) = 0 THEN ('bullish', 0.7) WHEN longs > 0 THEN ('bullish', 0.5) ELSE ('hold', 0.4) END AS s, CASE WHEN len(ww) = 0 THEN [] ELSE si END AS sfl,
 CASE WHEN len(ri) >= 3 THEN ('caution', 0.8) WHEN len(ri) > 0 THEN ('hold', 0.6) ELSE ('bullish', 0.8) END AS r,
 CASE WHEN len(ww) = 0 THEN ('hold', 0.5) WHEN n_decisions IS NULL THEN ('hold', 0.4) WHEN n_decisions < 5 THEN ('hold', 0.4) WHEN acc >= 0.6 THEN (CASE WHEN side = 'neutral' THEN 'hold' ELSE side END, least(0.5 + (acc - 0.5), 0.85)) WHEN acc <= 0.4 THEN ('caution', 0.6) ELSE ('hold', 0.5) END AS m,
 CASE WHEN len(ww) = 0 THEN [] WHEN n_decisions IS NULL THEN ['no_memory'] WHEN n_decisions >= 5 AND acc <= 0.4 THEN ['low_accuracy'] ELSE [] END AS mfl FROM v2),
v4 AS (SELECT *, CAST(d[2] AS DOUBLE) + CAST(s[2] AS DOUBLE) + CAST(r[2] AS DOUBLE) + CAST(m[2] AS DOUBLE) AS total, list_sort(list_distinct(list_concat(list_concat(dfl, sfl), list_concat(ri, mfl)))) AS flags,
 {', '.join("(" + " + ".join(f"CASE WHEN {v}[1] = '{a}' THEN CAST({v}[2] AS DOUBLE) ELSE 0 END" for v in "dsrm") + f") AS c_{a}" for a in committee.ACTIONS)} FROM v3),
v5 AS (SELECT *, greatest(c_bullish, c_bearish, c_hold, c_caution) AS top, len(list_filter(flags, lambda x: x IN ('extreme_volatility', 'drawdown'))) AS crit FROM v4),
review AS (SELECT ticker, d[1] AS data, s[1] AS strategy, r[1] AS risk, m[1] AS memory, CASE WHEN c_caution / total > 0.3 THEN 'caution' WHEN c_bullish = top THEN 'bullish' WHEN c_bearish = top THEN 'bearish' WHEN c_hold = top THEN 'hold' ELSE 'caution' END AS action, least(top / total, 0.95) AS sure, array_to_string(flags, ',') AS risk_flags,
 CASE WHEN crit >= 2 OR len(flags) >= 5 THEN 'critical' WHEN crit >= 1 OR len(flags) >= 3 THEN 'high' WHEN len(flags) >= 1 THEN 'medium' ELSE 'low' END AS risk_level, len(flags) AS n FROM v5)"""


@query("committee_review", f"WITH {_VOTES} SELECT ticker, data, strategy, risk, memory, action, round(sure, 6) AS sure, risk_flags, risk_level, risk_level IN ('high', 'critical') OR action = 'caution' OR n >= 3 AS human_review FROM review")
def committee_review(spark, sf_dir):
    c = committee.consensus(committee.votes(committee.fuse(snapshots(spark, sf_dir))))
    each = [F.col("votes")[i]["action"].alias(n) for i, n in enumerate(("data", "strategy", "risk", "memory"))]
    return c.select("ticker", *each, "action", R("sure").alias("sure"), F.array_join("risk_flags", ",").alias("risk_flags"), "risk_level", "human_review")


_VAL = f"""{_SNAP}, x AS (SELECT *, coalesce(weights, []::DOUBLE[]) AS ww, CASE WHEN CAST(substr(ticker, 7) AS INTEGER) % 2 = 0 THEN 'momentum' ELSE 'reversal' END AS source, n_correct / n_decisions AS wr FROM snap),
y AS (SELECT *, list_avg(ww) AS mean, CASE WHEN list_avg(ww) > 0.1 THEN 1 WHEN list_avg(ww) < -0.1 THEN -1 ELSE 0 END AS side, list_transform(ww, lambda z: abs(z)) AS aw FROM x),
z AS (SELECT *, NOT coalesce(n_decisions >= 5 AND wr < 0.35, false) AS won,
 side = 0 OR len(list_filter(momenta, lambda q: NOT (q * side > 0) AND abs(q) > 0.01)) + len(list_filter(rsis, lambda q: NOT CASE WHEN side = 1 THEN q < 70 ELSE q > 30 END)) <= len(list_filter(momenta, lambda q: q * side > 0)) + len(list_filter(rsis, lambda q: CASE WHEN side = 1 THEN q < 70 ELSE q > 30 END)) AS fits,
 NOT ((source = 'momentum' AND regime = 'oscillating') OR (source = 'reversal' AND regime = 'trend') OR (regime = 'extreme_volatility' AND abs(mean) > 0.5)) AS matched,
 len(ww) <= 1 OR (list_max(aw) <= 0.5 AND NOT coalesce(list_sum(list_transform(ww, lambda q: q * q)) / NULLIF(list_sum(aw) * list_sum(aw), 0) > 0.5, false)) AS spread, len(ww) = 0 OR list_max(aw) < 1e-6 AS idle FROM y),
k AS (SELECT *, CASE WHEN won THEN 1 ELSE 0.7 END * CASE WHEN fits THEN 1 ELSE 0.8 END * CASE WHEN matched THEN 1 ELSE 0.85 END * CASE WHEN spread THEN 1 ELSE 0.9 END AS mult, won AND fits AND matched AND spread AS ok FROM z)"""


@query("signal_validation", f"WITH {_VAL} SELECT ticker, CAST(CASE WHEN idle THEN 1 ELSE round(mult, 3) END AS DOUBLE) AS multiplier, idle OR ok AS passed, CASE WHEN idle THEN 'hold' WHEN ok AND mult > 0.9 THEN 'proceed' WHEN ok AND mult > 0.6 THEN 'proceed_with_caution' ELSE 'review' END AS recommendation FROM k")
def signal_validation(spark, sf_dir):
    no = F.substring("ticker", 7, 9).cast("int")
    own = snapshots(spark, sf_dir).withColumns({"source": F.when(no % 2 == 0, "momentum").otherwise("reversal"), "n_history": F.col("n_decisions"), "win_rate": sdiv("n_correct", "n_decisions")})
    return strategies.validate(own).select("ticker", "multiplier", "passed", "recommendation")
