"""Evaluation scores, orders and fills, hypotheses, reports, knowledge and catalogue queries."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.rolling import series
from marlstone.functions.safe import conform, number, sdiv
from marlstone.operators import broker, evaluate, factors, knowledge, retrieval, strategies
from marlstone.registry import query
from marlstone.sources.scratch import shared_path, written

from .cleaning import W
from .desk import _IND, curve, held
from .factors import LONG, long, panel
from .reports import DECISIONS, RUNS, backfill_returns, counted, decisions, returns_by_day, runs, where_all
from .research import BUCKETS, PAIRS, RANKED, pairs
from .views import BARS, FUNDAMENTALS, INDEX, SBARS, XSEC, bars, closes, fundamentals, sbars, table, xsec

R = lambda c, n=6: F.round(c, n)

# Evaluation

_IC = "i AS (SELECT ticker, CASE WHEN count(*) OVER w = 60 THEN covar_samp(rx, ry) OVER w / NULLIF(stddev_samp(rx) OVER w * stddev_samp(ry) OVER w, 0) END AS ic FROM v WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), ig AS (SELECT ticker, avg(ic) / (stddev_samp(ic) + 1e-8) AS icir FROM i GROUP BY ticker)"
_SCORE = f"""{RANKED}, {_IC}, {BUCKETS.replace(PAIRS + ', ', '').replace('v AS (', 'vv AS (').replace('FROM v GROUP', 'FROM vv GROUP').replace('FROM v JOIN', 'FROM vv v JOIN')},
ls AS (SELECT ticker, last(m ORDER BY bucket) - first(m ORDER BY bucket) AS long_short, coalesce(min(step) > 0 OR max(step) < 0, true) AS monotonic FROM st GROUP BY ticker),
sc AS (SELECT ig.ticker, least(coalesce(least(abs(icir) / 2, 3), 0) + coalesce(least(abs(long_short) * 20, 3), 0) + CASE WHEN monotonic THEN 2 ELSE 0 END, 10) AS score FROM ig JOIN ls ON ls.ticker = ig.ticker)"""


@query("factor_score", f"WITH {_SCORE} SELECT ticker, round(score, 6) AS score, CASE WHEN score >= 7 THEN 'A' WHEN score >= 5 THEN 'B' WHEN score >= 3 THEN 'C' ELSE 'D' END AS grade FROM sc")
def factor_score(spark, sf_dir):
    """Score and grade of the 20-day momentum of each brand, by ICIR, long-short return and order of the groups."""
    own = pairs(spark, sf_dir)
    ic = evaluate.rolling_ic(own).select("ticker", "icir")
    groups = evaluate.quantile_groups(own).select("ticker", "long_short", "monotonic").distinct()
    score = knowledge.factor_score(F.col("icir"), F.col("long_short"), F.col("monotonic"))
    return ic.join(groups, "ticker").select("ticker", R(score).alias("score"), knowledge.grade(score).alias("grade"))


_FB = f"""{BUCKETS}, c AS (SELECT ticker, covar_samp(factor, fwd) / NULLIF(stddev_samp(factor) * stddev_samp(fwd), 0) AS ic FROM v GROUP BY ticker),
rl AS (SELECT ticker, CASE WHEN count(CASE WHEN factor IS NOT NULL AND fwd IS NOT NULL THEN 1 END) OVER w = 20 THEN covar_samp(factor, fwd) OVER w / NULLIF(stddev_samp(CASE WHEN fwd IS NOT NULL THEN factor END) OVER w * stddev_samp(CASE WHEN factor IS NOT NULL THEN fwd END) OVER w, 0) END AS ic FROM fr WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
rg AS (SELECT ticker, avg(ic) / (stddev_samp(ic) + 1e-8) AS icir FROM rl GROUP BY ticker), lg AS (SELECT ticker, last(m ORDER BY bucket) - first(m ORDER BY bucket) AS long_short FROM g GROUP BY ticker)"""


@query("factor_backtest", f"WITH {_FB} SELECT c.ticker, round(ic, 6) AS ic, round(icir, 6) AS icir, round(long_short, 6) AS long_short FROM c JOIN rg ON rg.ticker = c.ticker JOIN lg ON lg.ticker = c.ticker")
def factor_backtest(spark, sf_dir):
    from marlstone.functions import rolling as r

    own = pairs(spark, sf_dir)
    ic = own.groupBy("ticker").agg(evaluate.safe_corr("factor", "fwd").alias("ic"))
    rolled = own.withColumn("c", r.corr("factor", "fwd", 20, series())).groupBy("ticker").agg((F.avg("c") / (F.stddev_samp("c") + 1e-8)).alias("icir"))
    known = own.where("factor is not null and fwd is not null").withColumn("bucket", evaluate.bucket("factor", 5, "ticker"))
    means = known.groupBy("ticker", "bucket").agg(F.avg("fwd").alias("m")).groupBy("ticker").agg((F.max_by("m", "bucket") - F.min_by("m", "bucket")).alias("long_short"))
    return ic.join(rolled, "ticker").join(means, "ticker").select("ticker", R("ic").alias("ic"), R("icir").alias("icir"), R("long_short").alias("long_short"))


@query("ic_statistics", f"WITH {RANKED}, t AS (SELECT ticker, covar_samp(rx, ry) / NULLIF(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM v GROUP BY ticker) SELECT 'momentum_20d' AS factor_name, round(avg(ic), 6) AS ic, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / (stddev_samp(ic) + 1e-8), 6) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ic_positive_ratio, count(ic) AS n_periods, abs(avg(ic)) < 0.02 AS is_decaying FROM t")
def ic_statistics(spark, sf_dir):
    v = pairs(spark, sf_dir).where("factor is not null and fwd is not null").withColumns({"rx": evaluate.avg_rank("factor", "ticker"), "ry": evaluate.avg_rank("fwd", "ticker")})
    t = v.groupBy("ticker").agg(evaluate.safe_corr("rx", "ry").alias("ic"))
    return t.agg(F.lit("momentum_20d").alias("factor_name"), R(F.avg("ic")).alias("ic"), R(F.stddev_samp("ic")).alias("ic_std"), R(F.avg("ic") / (F.stddev_samp("ic") + 1e-8)).alias("icir"), R(F.avg((F.col("ic") > 0).cast("double"))).alias("ic_positive_ratio"), F.count("ic").alias("n_periods"), (F.abs(F.avg("ic")) < 0.02).alias("is_decaying"))


_ALL_IC = f"""{LONG}, fw AS (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / NULLIF(close, 0) - 1 AS fwd FROM bars),
lf AS (SELECT l.*, fwd FROM long l JOIN fw ON fw.ticker = l.ticker AND fw.date = l.date WHERE fwd IS NOT NULL),
rk AS (SELECT factor_name, ticker, rank() OVER (PARTITION BY factor_name, ticker ORDER BY factor_value) + (count(*) OVER (PARTITION BY factor_name, ticker, factor_value) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY factor_name, ticker ORDER BY fwd) + (count(*) OVER (PARTITION BY factor_name, ticker, fwd) - 1) / 2.0::DOUBLE AS ry FROM lf),
tk AS (SELECT factor_name, ticker, covar_samp(rx, ry) / NULLIF(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM rk GROUP BY ALL)"""


@query("ic_statistics_all", f"WITH {_ALL_IC} SELECT factor_name, round(avg(ic), 6) AS ic, round(stddev_samp(ic), 6) AS ic_std, round(avg(ic) / (stddev_samp(ic) + 1e-8), 4) AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0::DOUBLE WHEN ic <= 0 THEN 0 END), 6) AS ic_positive_ratio, count(ic) AS n_tickers FROM tk GROUP BY factor_name")
def ic_statistics_all(spark, sf_dir):
    """Rank correlations of all factors with the returns of five bars, over all brands."""
    names = factors.list_factors()
    own = panel(spark, sf_dir).withColumn("fwd", evaluate.forward_return(5)).where("fwd is not null")
    rows = own.unpivot(["ticker", "date", "fwd"], names, "factor_name", "factor_value").where("factor_value is not null")
    ranked = rows.withColumns({"rx": evaluate.avg_rank("factor_value", "factor_name", "ticker"), "ry": evaluate.avg_rank("fwd", "factor_name", "ticker")})
    t = ranked.groupBy("factor_name", "ticker").agg(evaluate.safe_corr("rx", "ry").alias("ic"))
    mean, std = F.avg("ic"), F.stddev_samp("ic")
    return t.groupBy("factor_name").agg(R(mean).alias("ic"), R(std).alias("ic_std"), R(mean / (std + 1e-8), 4).alias("icir"), R(F.avg((F.col("ic") > 0).cast("double"))).alias("ic_positive_ratio"), F.count("ic").alias("n_tickers"))


for _period, _days, _most in (("weekly", 7, 10), ("monthly", 30, 15)):

    @query(f"{_period}_factor_ranking", f"WITH {LONG} SELECT factor_name, count(*) AS cnt, round(avg(factor_value), 4) AS avg_val, round(stddev_samp(factor_value), 4) AS std_val FROM long WHERE date >= (SELECT max(date) FROM long) - {_days} GROUP BY factor_name ORDER BY cnt DESC, factor_name LIMIT {_most}")
    def _ranking(spark, sf_dir, days=_days, most=_most):
        """The factors with the most values of the period, with their mean and spread."""
        own = long(spark, sf_dir)
        last = F.broadcast(own.agg(F.max("date").alias("last")))  # one row
        g = own.join(last, F.col("date") >= F.date_sub("last", days)).groupBy("factor_name")
        return g.agg(F.count("*").alias("cnt"), R(F.avg("factor_value"), 4).alias("avg_val"), R(F.stddev_samp("factor_value"), 4).alias("std_val")).orderBy(F.desc("cnt"), "factor_name").limit(most)


_PIVOT = ("momentum_5d", "rsi_14", "atr_14")


@query("factor_pivot", f"WITH {LONG} SELECT ticker, date, " + ", ".join(f"round(avg(factor_value) FILTER (factor_name = '{n}'), 6) AS {n}" for n in _PIVOT) + f" FROM long WHERE factor_name IN {_PIVOT} GROUP BY ticker, date")
def factor_pivot(spark, sf_dir):
    wide = long(spark, sf_dir, list(_PIVOT)).groupBy("ticker", "date").pivot("factor_name", list(_PIVOT)).agg(F.avg("factor_value"))
    return wide.select("ticker", "date", *[R(n).alias(n) for n in _PIVOT])


@query("factor_scan", f"WITH {LONG} SELECT ticker, date, factor_name, round(factor_value, 6) AS factor_value FROM long WHERE factor_name = 'rsi_14' AND ticker IN ('Brand#11', 'Brand#12') AND date >= DATE '1997-01-01' ORDER BY date, ticker")
def factor_scan(spark, sf_dir):
    own = where_all(long(spark, sf_dir, ["rsi_14"]), factor_name="rsi_14", ticker=["Brand#11", "Brand#12"], start=datetime.date(1997, 1, 1), end=None)
    return own.withColumn("factor_value", R("factor_value")).orderBy("date", "ticker")


_NEUT = f"{SBARS}, sx AS (SELECT ticker, date_trunc('quarter', date) AS q, s_nationkey AS industry, avg(close) AS f, sum(amount) AS cap FROM sbars JOIN supplier ON CAST(s_suppkey AS VARCHAR) = ticker GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM sx), d AS (SELECT *, f - avg(f) OVER (PARTITION BY q, industry) AS y FROM n)"


@query("neutralize_by_date", f"WITH {_NEUT}, z AS (SELECT *, (ln(cap) - avg(ln(cap)) OVER (PARTITION BY q)) / (stddev_pop(ln(cap)) OVER (PARTITION BY q) + 1e-8) AS z0 FROM d), x AS (SELECT *, z0 - avg(z0) OVER (PARTITION BY q, industry) AS z FROM z) SELECT ticker, CAST(q AS DATE) AS date, round(CASE WHEN n < 30 THEN f ELSE y - coalesce(sum(z * y) OVER (PARTITION BY q) / NULLIF(sum(z * z) OVER (PARTITION BY q), 0), 0) * z END, 4) AS f FROM x")
def neutralize_by_date(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_nationkey").alias("industry"))
    own = sbars(spark, sf_dir).join(s, "ticker").groupBy("ticker", F.to_date(F.date_trunc("quarter", "date")).alias("date"), "industry").agg(F.avg("close").alias("f"), F.sum("amount").alias("cap"))
    return evaluate.neutralise(own, ["f"], cap="cap", by=["date"]).select("ticker", "date", R("f", 4).alias("f"))


# Orders

_POS = f"{BARS}, px AS (SELECT ticker, last(close ORDER BY date) AS price FROM bars GROUP BY ticker), pos AS (SELECT ticker, CAST(CAST(substr(ticker, 7) AS INTEGER) * 10 AS BIGINT) AS quantity FROM px WHERE CAST(substr(ticker, 7) AS INTEGER) % 3 <> 0), tgt AS (SELECT ticker, (CAST(substr(ticker, 7) AS INTEGER) % 5 - 1) / 20.0::DOUBLE AS weight FROM px)"


def _brand_orders(spark, sf_dir):
    px = bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    no = F.substring("ticker", 7, 9).cast("int")
    pos = px.where(no % 3 != 0).select("ticker", (no * 10).cast("long").alias("quantity"))
    return px, pos, px.select("ticker", ((no % 5 - 1) / 20.0).alias("weight"))


@query("weights_to_orders", f"WITH {_POS}, c AS (SELECT 50000000.0::DOUBLE + sum(quantity * price) AS capital FROM pos JOIN px ON px.ticker = pos.ticker), o AS (SELECT t.ticker, price, weight, coalesce(quantity, 0) AS held, CAST(floor(abs(weight) * capital / price / 100) * 100 AS BIGINT) AS want FROM tgt t JOIN px ON px.ticker = t.ticker LEFT JOIN pos ON pos.ticker = t.ticker, c), d AS (SELECT *, CASE WHEN weight >= 0 THEN want - held ELSE -greatest(held, 0) END AS change FROM o) SELECT ticker, CASE WHEN change > 0 THEN 'buy' ELSE 'sell' END AS side, abs(change) AS quantity, round(price, 6) AS price FROM d WHERE change <> 0")
def weights_to_orders(spark, sf_dir):
    px, pos, target = _brand_orders(spark, sf_dir)
    return broker.orders_from_weights(target, pos, px, 50_000_000.0).withColumn("price", R("price"))


def paper_orders(spark, sf_dir):
    """Every customer's orders as trades of brands, in order of their keys."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    side = F.when(F.col("o_orderkey") % 3 == 0, "sell").otherwise("buy")
    return o.select(
        F.col("o_custkey").alias("account"), F.row_number().over(w).cast("long").alias("seq"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 3 + 1).cast("string")).alias("ticker"),
        side.alias("side"), ((F.col("o_orderkey") % 9 + 1) * 100).cast("long").alias("quantity"), F.round(F.col("o_totalprice") / 1000, 2).alias("price"),
    )


@query("paper_fills")
def paper_fills(spark, sf_dir):
    """Fills of all accounts. A fold over maps has no SQL twin; a test replays it order by order."""
    f = broker.fill(paper_orders(spark, sf_dir))
    return f.select("account", "seq", "ticker", "status", "quantity", "price", R("commission", 4).alias("commission"), R("tax", 4).alias("tax"), R("cash", 4).alias("cash"), "held", R("avg_cost", 4).alias("avg_cost"))


@query("paper_positions")
def paper_positions(spark, sf_dir):
    return broker.positions_after(broker.fill(paper_orders(spark, sf_dir))).withColumn("avg_cost", R("avg_cost", 4))


_ST = "CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'P' THEN 'accepted' ELSE 'filled' END"


@query("open_orders", f"SELECT o_orderkey AS order_id, {_ST} AS status FROM orders WHERE o_orderstatus IN ('O', 'P')")
def open_orders(spark, sf_dir):
    return broker.open_orders(_statuses(spark, sf_dir))


def _statuses(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(s == "O", "submitted").when(s == "P", "accepted").otherwise("filled").alias("status"))


@query("cancel_orders", f"SELECT o_orderkey AS order_id, CASE WHEN o_totalprice > 200000 AND o_orderstatus IN ('O', 'P') THEN 'cancelled' ELSE {_ST} END AS status FROM orders")
def cancel_orders(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("order_id"))
    return broker.cancel(_statuses(spark, sf_dir), ids)


@query("order_validation", "SELECT o_orderkey, CASE WHEN q <= 0 THEN 'quantity' WHEN q % 100 <> 0 THEN 'lot' WHEN q * o_totalprice > 50000000 THEN 'cash' END AS refused FROM (SELECT *, (o_orderkey % 7) * 50 AS q FROM orders)")
def order_validation(spark, sf_dir):
    q = F.col("o_orderkey") % 7 * 50
    return table(spark, sf_dir, "orders").select("o_orderkey", broker.accepted(q, F.lit("buy"), F.col("o_totalprice"), F.lit(5e7)).alias("refused"))


@query("convert_orders", "SELECT o_orderkey AS order_id, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CASE WHEN o_shippriority > 0 THEN 'sell' ELSE 'buy' END AS side, CASE o_orderstatus WHEN 'O' THEN 'submitted' WHEN 'P' THEN 'partial' WHEN 'F' THEN 'filled' ELSE 'unknown' END AS status, CAST(o_orderdate AS DATE) AS created FROM orders".replace("CASE WHEN o_shippriority > 0 THEN 'sell' ELSE 'buy' END", "CASE WHEN o_orderkey % 2 = 0 THEN 'sell' ELSE 'buy' END"))
def convert_orders(spark, sf_dir):
    """External order records as internal ones, their status by a table of names."""
    names = F.create_map(*[F.lit(x) for kv in (("O", "submitted"), ("P", "partial"), ("F", "filled")) for x in kv])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("ticker"), F.when(F.col("o_orderkey") % 2 == 0, "sell").otherwise("buy").alias("side"), F.coalesce(F.try_element_at(names, "o_orderstatus"), F.lit("unknown")).alias("status"), F.to_date("o_orderdate").alias("created"))


_LIMITS = "SELECT * FROM (VALUES " + ", ".join(f"('{s.name}', {s.holding[0]}, {s.holding[1]}, {s.holding[2]}, {s.kill['max_drawdown']}::DOUBLE, {s.kill['daily_loss_limit']}::DOUBLE, {s.kill['consecutive_losses']}, {s.kill['volatility_spike']}::DOUBLE)" for s in strategies.REGISTRY.values()) + ") t(strategy, min_days, max_days, typical_days, max_drawdown, daily_loss_limit, consecutive_losses, volatility_spike)"


@query("strategy_limits", _LIMITS)
def strategy_limits(spark, sf_dir):
    return strategies.limits(spark)


@query("regime_switches")
def regime_switches(spark, sf_dir):
    """Each user's regime by day, after the cooldown. The state machine is tested against a loop."""
    e = table(spark, sf_dir, "events")
    day = e.groupBy(F.col("user_id").alias("key"), F.to_date("ts").alias("day")).agg(F.max("event_type").alias("regime"), (F.max("value") / 100).alias("confidence"))
    return strategies.settle(day, {"purchase": ("momentum", 0.8), "signup": ("sentiment", 0.5), "view": ("reversal", 0.3)})


@query("sector_peers", f"WITH {SBARS}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM sbars), r AS (SELECT ticker, last(close ORDER BY date) / first(close ORDER BY date) - 1 AS ret FROM b WHERE b <= 20 GROUP BY ticker), n AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_nationkey AS industry FROM supplier), p AS (SELECT a.ticker, c.ticker AS peer, row_number() OVER (PARTITION BY a.ticker ORDER BY c.ticker) AS k FROM n a JOIN n c ON a.industry = c.industry AND a.ticker <> c.ticker) SELECT p.ticker, peer, round(ret, 6) AS ret FROM p LEFT JOIN r ON r.ticker = peer WHERE k <= 3")
def sector_peers(spark, sf_dir):
    back = Window.partitionBy("ticker").orderBy(F.desc("date"))
    last = sbars(spark, sf_dir).withColumn("b", F.row_number().over(back)).where("b <= 20")
    ret = last.groupBy("ticker").agg((sdiv(F.max_by("close", "date"), F.min_by("close", "date")) - 1).alias("ret"))
    industries = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_nationkey").alias("industry"))
    return strategies.peers(ret, industries).withColumn("ret", R("ret"))


# Single instruments

_LAST = f"{_IND}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS b FROM ind), c AS (SELECT ticker, max(high) FILTER (b <= 60) AS recent_high, min(low) FILTER (b <= 60) AS recent_low, last(close ORDER BY date) / NULLIF(first(close ORDER BY date) FILTER (year(date) = 2001), 0) - 1 AS ytd FROM k GROUP BY ticker), l AS (SELECT k.*, recent_high, recent_low, ytd FROM k JOIN c ON c.ticker = k.ticker WHERE b = 1)"


@query("stock_analysis", f"WITH {_LAST}, s AS (SELECT *, (close / ma20 - 1) * 100 AS d20, vol_ma20 / NULLIF(vol_ma60, 0) AS vr FROM l) SELECT ticker, date, round(close, 8) AS close, round(recent_high, 8) AS recent_high, round(recent_low, 8) AS recent_low, round(ytd * 100, 4) AS ytd_return, round(vr, 4) AS volume_ratio, CAST(round(close / 10) * 10 AS BIGINT) AS round_level, CAST(ma20 > ma60 AS INTEGER) + CAST(d20 > 0 AS INTEGER) + CAST(close > ma60 AS INTEGER) + CAST(rsi < 30 OR (rsi > 50 AND rsi <= 70) AS INTEGER) + CAST(macd_bar > 0 AS INTEGER) + CAST(dif > dea AS INTEGER) AS bulls, CAST(ma20 < ma60 AS INTEGER) + CAST(abs(d20) > 1 AS INTEGER) + CAST(rsi > 70 OR (rsi >= 30 AND rsi <= 50) AS INTEGER) + CAST(macd_bar < -0.5 AS INTEGER) + CAST(dif <= dea AS INTEGER) + CAST(vr < 0.6 AS INTEGER) AS bears, CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_state, CASE WHEN vr > 1.2 THEN 'rising' WHEN vr < 0.8 THEN 'falling' ELSE 'even' END AS volume_state FROM s")
def stock_analysis(spark, sf_dir):
    """Levels, state and the numbers of factors for and against each brand at its last bar."""
    from marlstone.operators.regime import indicators

    own = indicators(bars(spark, sf_dir)).withColumn("b", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))))
    last60 = F.col("b") <= 60
    in_year = F.year("date") == 2001
    ytd = sdiv(F.max_by("close", "date"), F.min_by(F.when(in_year, F.col("close")), F.when(in_year, F.col("date")))) - 1
    c = own.groupBy("ticker").agg(F.max(F.when(last60, F.col("high"))).alias("recent_high"), F.min(F.when(last60, F.col("low"))).alias("recent_low"), ytd.alias("ytd"))
    s = own.where("b = 1").join(c, "ticker").withColumns({"d20": (F.col("close") / F.col("ma20") - 1) * 100, "vr": sdiv("vol_ma20", "vol_ma60")})
    rsi, vr = F.col("rsi"), F.col("vr")
    total = lambda *tests: sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    bulls = total(F.col("ma20") > F.col("ma60"), F.col("d20") > 0, F.col("close") > F.col("ma60"), (rsi < 30) | ((rsi > 50) & (rsi <= 70)), F.col("macd_bar") > 0, F.col("dif") > F.col("dea"))
    bears = total(F.col("ma20") < F.col("ma60"), F.abs("d20") > 1, (rsi > 70) | rsi.between(30, 50), F.col("macd_bar") < -0.5, F.col("dif") <= F.col("dea"), vr < 0.6)
    return s.select(
        "ticker", "date", R("close", 8).alias("close"), R("recent_high", 8).alias("recent_high"), R("recent_low", 8).alias("recent_low"), R(F.col("ytd") * 100, 4).alias("ytd_return"), R("vr", 4).alias("volume_ratio"),
        (F.round(F.col("close") / 10) * 10).cast("long").alias("round_level"), bulls.alias("bulls"), bears.alias("bears"),
        F.when(rsi > 70, "overbought").when(rsi < 30, "oversold").otherwise("neutral").alias("rsi_state"), F.when(vr > 1.2, "rising").when(vr < 0.8, "falling").otherwise("even").alias("volume_state"),
    )


@query("candle_patterns", f"WITH {BARS}, p AS (SELECT *, lag(close, 1) OVER ({W}) AS c2, lag(close, 2) OVER ({W}) AS c3 FROM bars), q AS (SELECT *, coalesce(CAST(close > c2 AS INTEGER), 0) AS up FROM p) SELECT ticker, date, coalesce(c2 / c3 > 1.095 AND close < open AND close < c2 * 0.98, false) AS after_limit, coalesce(high - greatest(close, open) > (high - low) * 0.6 AND high - low > 0, false) AS long_shadow, CAST(sum(up) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS rises FROM q")
def candle_patterns(spark, sf_dir):
    return knowledge.candles(bars(spark, sf_dir)).select("ticker", "date", "after_limit", "long_shadow", "rises")


# Hypotheses, alerts and reports

@query("factor_hypotheses", f"WITH {RANKED}, t AS (SELECT ticker, covar_samp(rx, ry) / NULLIF(stddev_samp(rx) * stddev_samp(ry), 0) AS ic FROM v GROUP BY ticker) SELECT 'momentum_20d' AS factor_name, ticker, round(ic, 6) AS ic, CASE WHEN ic > 0.05 THEN 'positive' ELSE 'negative' END AS direction, 'draft' AS status FROM t WHERE abs(ic) > 0.05")
def factor_hypotheses(spark, sf_dir):
    v = pairs(spark, sf_dir).where("factor is not null and fwd is not null").withColumns({"rx": evaluate.avg_rank("factor", "ticker"), "ry": evaluate.avg_rank("fwd", "ticker")})
    ics = v.groupBy(F.lit("momentum_20d").alias("factor_name"), "ticker").agg(evaluate.safe_corr("rx", "ry").alias("ic"))
    return knowledge.factor_hypotheses(ics).withColumn("ic", R("ic"))


@query("run_hypotheses", f"WITH {RUNS} SELECT run_id, strategy, round(annual_return, 6) AS annual_return, 'uptrend' AS market_regime, 'draft' AS status FROM runs WHERE annual_return > 0.15")
def run_hypotheses(spark, sf_dir):
    return knowledge.run_hypotheses(runs(spark, sf_dir), F.lit("uptrend")).withColumn("annual_return", R("annual_return"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, bs in knowledge.HYPOTHESIS.items() for b in bs)
_STATES = "CASE o_orderkey % 6 WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'verified' WHEN 3 THEN 'invalidated' WHEN 4 THEN 'rejected' ELSE 'obsolete' END"
_WANTED = "CASE o_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'verified' WHEN 2 THEN 'obsolete' WHEN 3 THEN 'rejected' END"


@query("hypothesis_lifecycle", f"WITH ok(a, b) AS (VALUES {_PAIRS}), r AS (SELECT o_orderkey AS id, {_STATES} AS status FROM orders), ch AS (SELECT CASE WHEN o_orderkey % 50 = 7 THEN -o_orderkey ELSE o_orderkey END AS id, {_WANTED} AS new_status FROM orders WHERE o_custkey % 5 <> 4) SELECT coalesce(r.id, ch.id) AS id, CASE WHEN ok.a IS NOT NULL THEN new_status ELSE status END AS status, CASE WHEN status IS NULL THEN 'unknown' WHEN new_status IS NOT NULL AND ok.a IS NULL THEN 'not_allowed' END AS error FROM r FULL JOIN ch ON ch.id = r.id LEFT JOIN ok ON ok.a = status AND ok.b = new_status")
def hypothesis_lifecycle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pick = lambda c, names: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    records = o.select(F.col("o_orderkey").alias("id"), pick(F.col("o_orderkey") % 6, list(knowledge.HYPOTHESIS)[:1] + ["active", "verified", "invalidated", "rejected", "obsolete"]).alias("status"))
    id_ = F.when(F.col("o_orderkey") % 50 == 7, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    changes = o.where("o_custkey % 5 <> 4").select(id_.alias("id"), pick(F.col("o_custkey") % 5, ["active", "verified", "obsolete", "rejected"]).alias("new_status"))
    return knowledge.transition(records, changes)


@query("alerts_open", "SELECT event_id AS alert_id, CASE WHEN value > 90 THEN 'critical' ELSE 'warning' END AS level FROM events WHERE value > 75 AND event_id % 4 <> 0")
def alerts_open(spark, sf_dir):
    from marlstone.sources.sinks import acknowledge

    e = table(spark, sf_dir, "events")
    alerts = e.where("value > 75").select(F.col("event_id").alias("alert_id"), F.when(F.col("value") > 90, "critical").otherwise("warning").alias("level"), F.lit(False).alias("acknowledged"))
    seen = e.where("event_id % 4 = 0").select(F.col("event_id").alias("alert_id"))
    return acknowledge(alerts, seen).where("not acknowledged").select("alert_id", "level")


@query("lessons", "SELECT o_orderkey AS lesson_id, o_orderpriority AS category, round(o_totalprice / 500000, 6) AS confidence FROM orders WHERE o_totalprice / 500000 >= 0.5 AND o_orderpriority = '1-URGENT' ORDER BY confidence DESC, lesson_id")
def lessons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("lesson_id"), F.col("o_orderpriority").alias("category"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return where_all(o, category="1-URGENT").where("confidence >= 0.5").withColumn("confidence", R("confidence")).orderBy(F.desc("confidence"), "lesson_id")


@query("facts", "SELECT event_id AS fact_id, CAST(ts AS DATE) AS day, event_type AS fact_type, value, value > 50 AS verified, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'click' AND value > 50 AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts, event_id LIMIT 200")
def facts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.col("value") > 50) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    return e.orderBy("ts", "event_id").limit(200).select(F.col("event_id").alias("fact_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("fact_type"), "value", (F.col("value") > 50).alias("verified"), F.from_json("props", "k long")["k"].alias("k"))


@query("financials_latest", f"WITH {FUNDAMENTALS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC) AS b FROM fundamentals) SELECT ticker, report_date, round(revenue, 4) AS revenue, round(eps, 6) AS eps FROM r WHERE b = 1")
def financials_latest(spark, sf_dir):
    last = fundamentals(spark, sf_dir).groupBy("ticker").agg(F.max_by(F.struct("report_date", "revenue", "eps"), "report_date").alias("r"))
    return last.select("ticker", "r.report_date", R("r.revenue", 4).alias("revenue"), R("r.eps").alias("eps"))


_FIGURE = "CAST(CAST({0} AS DECIMAL(18, 4)) AS {1})"
_SHAPES = "CASE month(report_date) WHEN 3 THEN '--' WHEN 6 THEN '-' || {0} WHEN 9 THEN '  ' || {0} || ' ' ELSE CASE WHEN ticker LIKE 'Brand#1%' THEN {0} || ' units' ELSE {0} END END"


@query("financials_parsed", f"WITH {FUNDAMENTALS}, t AS (SELECT ticker, report_date, {_SHAPES.format(_FIGURE.format('revenue', 'VARCHAR'))} AS revenue FROM fundamentals) SELECT ticker, report_date, TRY_CAST(trim(revenue) AS DOUBLE) AS revenue FROM t")
def financials_parsed(spark, sf_dir):
    """Figures that arrive as text with decimals, signs and spaces, one row a report; what is no number is null."""
    t = fundamentals(spark, sf_dir).select("ticker", "report_date", F.expr(_SHAPES.format(_FIGURE.format("revenue", "STRING"))).alias("revenue"))
    return t.select("ticker", "report_date", number(F.trim("revenue")).alias("revenue"))


@query("events_top", "SELECT event_type, event_id % 3 AS sentiment, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type, sentiment LIMIT 10")
def events_top(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 3).alias("sentiment")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type", "sentiment").limit(10)


_LASTN = " UNION ALL ".join(f"SELECT '{p}' AS period, ticker, count(*) AS n, round(avg(close), 6) AS avg_close, round(stddev_samp(close), 6) AS std_close FROM bars WHERE date IN (SELECT date FROM cal LIMIT {n}) GROUP BY ticker" for p, n in (("week", 5), ("month", 20), ("quarter", 60)))


@query("period_factor_stats", f"WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars ORDER BY date DESC) {_LASTN}")
def period_factor_stats(spark, sf_dir):
    b = bars(spark, sf_dir)
    out = None
    for name, n in (("week", 5), ("month", 20), ("quarter", 60)):
        g = b.join(F.broadcast(knowledge.last_days(b, n)), "date", "left_semi").groupBy(F.lit(name).alias("period"), "ticker").agg(F.count("*").alias("n"), R(F.avg("close")).alias("avg_close"), R(F.stddev_samp("close")).alias("std_close"))
        out = g if out is None else out.unionByName(g)
    return out


@query("report_gate", f"WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars), n AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM cal) SELECT date, concat_ws(',', CASE WHEN dayofweek(date) = 5 THEN 'weekly' END, CASE WHEN coalesce(date_trunc('month', date) <> date_trunc('month', nxt), true) THEN 'monthly' END, CASE WHEN coalesce(date_trunc('quarter', date) <> date_trunc('quarter', nxt), true) THEN 'quarterly' END) AS due FROM n")
def report_gate(spark, sf_dir):
    """Which reports are due on each trading day."""
    cal = bars(spark, sf_dir).select("date").distinct().withColumn("nxt", F.lead("date").over(Window.orderBy("date")))
    ends = lambda unit: F.coalesce(F.trunc("date", unit) != F.trunc("nxt", unit), F.lit(True))
    return cal.select("date", F.concat_ws(",", F.when(F.dayofweek("date") == 6, "weekly"), F.when(ends("month"), "monthly"), F.when(ends("quarter"), "quarterly")).alias("due"))


for _unit, _below in (("month", "week"), ("quarter", "month")):
    _part = f"CAST(date_trunc('{_below}', o_orderdate) AS DATE)"

    @query(f"report_{_below}s_of_{_unit}", f"WITH p AS (SELECT DISTINCT {_part} AS part FROM orders) SELECT CAST(date_trunc('{_unit}', part) AS DATE) AS period, count(*) AS n, string_agg(strftime(part, '%Y-%m-%d'), ',' ORDER BY part) AS parts FROM p GROUP BY 1")
    def _rolled(spark, sf_dir, unit=_unit, below=_below):
        return knowledge.roll_up(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")), unit, below)


_ENTRY = "e AS (SELECT item_id AS id, text[:60] AS title, [split_part(text, ' ', 2), split_part(text, ' ', 5)] AS keywords, [split_part(text, ' ', 3)] AS tags, text AS content, CASE WHEN item_id % 2 = 0 THEN 'scenario' ELSE 'entity' END AS type, CASE WHEN item_id % 3 = 0 THEN ['trend', 'extreme_volatility'] ELSE ['oscillating'] END AS market_regime, CASE WHEN item_id % 4 = 0 THEN ['all'] ELSE ['daily'] END AS timeframe FROM benchmark)"
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> ''))"
_Q = "['the', 'thatnd', 'in', 'heed']"
_HIT = lambda c: f"len(list_intersect({_Q}, {_TOK.format(c)}))"
_ENTRY_SCORE = f"{_ENTRY}, s AS (SELECT id, title, 0.35 * least({_HIT('title')} / 4.0::DOUBLE, 1) + 0.25 * least({_HIT('array_to_string(keywords, chr(32))')} / 4.0::DOUBLE, 1) + 0.15 * least(greatest({_HIT('array_to_string(tags, chr(32))')}, {_HIT('content[:200]')} * 0.5) / 4.0::DOUBLE, 1) + CASE WHEN list_contains(market_regime, 'trend') THEN 0.15 ELSE 0 END + CASE WHEN list_contains(timeframe, 'daily') OR list_contains(timeframe, 'all') THEN 0.1 ELSE 0 END AS s FROM e WHERE type = 'scenario')"

_STATE = "CASE WHEN {0} > 0.005 THEN 'trend' WHEN {0} < -0.005 THEN 'weak' ELSE 'sideways' END"
_DAILY = f"""WITH {LONG}, {INDEX}, {DECISIONS.removeprefix(BARS + ', ')}, {_ENTRY_SCORE},
ix AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS r, close / max(close) OVER (ORDER BY date) - 1 AS dd FROM index_bars), ld AS (SELECT * FROM ix ORDER BY date DESC LIMIT 1),
ch AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars), td AS (SELECT count(*) AS n, count_if(r > 0) AS up, count_if(r < 0) AS down FROM ch WHERE date = (SELECT date FROM ld)),
mo AS (SELECT ticker, factor_value AS v FROM long WHERE factor_name = 'momentum_20d' AND date = (SELECT date FROM ld)),
ev AS (SELECT event_type, count(*) AS n, avg(value) AS v FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1),
sc AS (SELECT id, title, CASE WHEN s > 0 THEN s ELSE 0.02 END AS score FROM s ORDER BY score DESC, id LIMIT 3),
ac AS (SELECT count_if(return_5d > 0) AS w, count(return_5d) AS n FROM filled WHERE decision_date > (SELECT date FROM ld) - 120)
SELECT '---' || chr(10) || 'report_id: rpt_' || strftime(date, '%Y%m%d') || '_market' || chr(10) || 'date: ' || strftime(date, '%Y-%m-%d') || chr(10) || '---' || chr(10) || '# Daily report ' || strftime(date, '%Y-%m-%d')
 || chr(10) || chr(10) || '## 1. Market state' || chr(10) || {_STATE.format('r')} || printf(' (index %+.2f%%)', r * 100)
 || chr(10) || chr(10) || '## 2. Snapshot' || chr(10) || printf('index %.2f', close) || chr(10) || n || ' traded, ' || up || ' up, ' || down || ' down'
 || chr(10) || chr(10) || '## 3. Factor signals' || chr(10) || (SELECT string_agg('- ' || ticker || ': ' || printf('%.4f', v), chr(10) ORDER BY -v, ticker) FROM (SELECT * FROM mo ORDER BY -v, ticker LIMIT 3))
 || chr(10) || chr(10) || '## 4. Risk checks' || chr(10) || printf('drawdown %.2f%%', dd * 100) || CASE WHEN r < -0.02 THEN ', daily stop' ELSE '' END
 || chr(10) || chr(10) || '## 5. Events' || chr(10) || (SELECT string_agg('- [' || event_type || '] ' || n, chr(10) ORDER BY -n, event_type) FROM ev)
 || chr(10) || chr(10) || '## 6. Sentiment' || chr(10) || (SELECT string_agg('- ' || event_type || printf(': %.2f', v), chr(10) ORDER BY event_type) FROM ev)
 || chr(10) || chr(10) || '## 7. Method' || chr(10) || (SELECT string_agg('- ' || title, chr(10) ORDER BY -score, id) FROM sc)
 || chr(10) || chr(10) || '## 8. Prediction' || chr(10) || (SELECT CASE WHEN avg(v) > 0.02 THEN 'bullish' WHEN avg(v) < -0.02 THEN 'bearish' ELSE 'neutral' END FROM mo) || ', ' || (SELECT coalesce(w, 0) || ' of ' || n FROM ac) || ' recent decisions right' AS report FROM ld, td"""


@query("daily_report", _DAILY)
def daily_report(spark, sf_dir):
    """The last day in eight sections: index, brands, the highest momentum, drawdown, events and what fits them."""
    from marlstone.operators import report

    own = closes(spark, sf_dir)
    ix = own.groupBy("date").agg(F.avg("close").alias("close"))
    w = Window.orderBy("date")  # a row a day
    last = ix.withColumns({"r": F.col("close") / F.lag("close").over(w) - 1, "dd": F.col("close") / F.max("close").over(w) - 1}).orderBy(F.desc("date")).limit(1)
    day = F.broadcast(last.select("date"))  # one row
    changes = own.withColumn("r", F.col("close") / F.lag("close").over(series()) - 1).join(day, "date")
    traded = changes.agg(F.format_string("%d traded, %d up, %d down", F.count("*"), F.count_if(F.col("r") > 0), F.count_if(F.col("r") < 0)).alias("t"))
    momentum = own.withColumn("v", factors.REGISTRY["momentum_20d"].build(series(), **factors.resolve("momentum_20d"))).where("v is not null").join(day, "date").select("ticker", "v")
    e = table(spark, sf_dir, "events")
    newest = F.broadcast(e.agg(F.to_date(F.max("ts")).alias("day")))
    kinds = e.join(newest, F.to_date("ts") == F.col("day")).groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    recent = returns_by_day(decisions(spark, sf_dir).join(day, F.col("decision_date") > F.date_sub("date", 120)), own)
    right = recent.agg(F.format_string(", %d of %d recent decisions right", counted(F.col("return_5d") > 0), counted(F.col("return_5d").isNotNull())).alias("t"))
    mean = F.avg("v")
    side = momentum.agg(F.when(mean > 0.02, "bullish").when(mean < -0.02, "bearish").otherwise("neutral").alias("s"))
    return report.compose(last, [
        last.select(report.market_state(F.col("r")).alias("text")),
        last.crossJoin(F.broadcast(traded)).select(F.concat(F.format_string("index %.2f", "close"), F.lit("\n"), "t").alias("text")),
        report.listed(momentum, F.format_string("- %s: %.4f", "ticker", "v"), [(-F.col("v")).alias("v"), F.col("ticker")], 3, "none"),
        last.select(F.concat(F.format_string("drawdown %.2f%%", F.col("dd") * 100), F.when(F.col("r") < -0.02, ", daily stop").otherwise("")).alias("text")),
        report.listed(kinds, F.format_string("- [%s] %d", "event_type", "n"), [(-F.col("n")).alias("n"), F.col("event_type")], 10, "none"),
        report.listed(kinds, F.format_string("- %s: %.2f", "event_type", "v"), [F.col("event_type")], 10, "none"),
        report.listed(_best(spark, sf_dir), F.concat(F.lit("- "), "title"), [(-F.col("score")).alias("score"), F.col("id")], 3, "none"),
        side.crossJoin(F.broadcast(right)).select(F.concat("s", "t").alias("text")),
    ])


@query("recent_decisions", f"WITH {DECISIONS} SELECT decision_id, ticker, decision_date, return_5d FROM filled WHERE ticker = 'Brand#12' ORDER BY decision_date DESC, decision_id DESC LIMIT 20")
def recent_decisions(spark, sf_dir):
    """The newest decisions on a brand; bars are made of the days that these look up alone."""
    newest = [F.desc("decision_date"), F.desc("decision_id")]
    own = written(where_all(decisions(spark, sf_dir), ticker="Brand#12").orderBy(*newest).limit(20), "recent")
    first, last = own.agg(F.min("decision_date"), F.date_add(F.max("decision_date"), 15)).first()
    d = backfill_returns(own, where_all(bars(spark, sf_dir), ticker="Brand#12", start=first, end=last))
    return d.orderBy(*newest).select("decision_id", "ticker", "decision_date", "return_5d")


@query("equity_scan", f"WITH {BARS}, {INDEX}, curve AS (SELECT date, 1000000 * close / first_value(close) OVER (ORDER BY date) AS equity FROM index_bars) SELECT date, round(equity, 4) AS equity FROM curve WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' ORDER BY date")
def equity_scan(spark, sf_dir):
    c = where_all(curve(spark, sf_dir), start=datetime.date(1997, 1, 1), end=datetime.date(1997, 12, 31))
    return c.withColumn("equity", R("equity", 4)).orderBy("date")


@query("health_checks", f"WITH {BARS}, n AS (SELECT count(DISTINCT ticker) AS n, max(date) AS d FROM bars), c AS (SELECT 'coverage' AS item, CASE WHEN n >= 300 THEN 'ok' WHEN n >= 20 THEN 'warning' ELSE 'error' END AS status FROM n UNION ALL SELECT 'factors', 'ok' UNION ALL SELECT 'freshness', CASE WHEN datediff('day', d, DATE '2001-11-05') <= 3 THEN 'ok' WHEN datediff('day', d, DATE '2001-11-05') <= 7 THEN 'warning' ELSE 'error' END FROM n) SELECT * FROM c UNION ALL SELECT 'all', CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'warning') THEN 'warning' ELSE 'ok' END FROM c")
def health_checks(spark, sf_dir):
    """Coverage, number of factors and freshness, and the worst of them."""
    from marlstone.operators.factors import list_factors

    band = lambda v, ok, warn: F.when(v >= ok, "ok").when(v >= warn, "warning").otherwise("error")
    g = bars(spark, sf_dir).agg(F.countDistinct("ticker").alias("n"), F.max("date").alias("d"))
    age = F.datediff(F.lit(datetime.date(2001, 11, 5)), F.col("d"))
    items = {"coverage": band(F.col("n"), 300, 20), "factors": band(F.lit(len(list_factors())), 20, 10), "freshness": F.when(age <= 3, "ok").when(age <= 7, "warning").otherwise("error")}
    each = g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), v.alias("status")) for k, v in items.items()])).alias("i")).select("i.*")
    worst = each.agg(F.lit("all").alias("item"), F.when(F.bool_or(F.col("status") == "error"), "error").when(F.bool_or(F.col("status") == "warning"), "warning").otherwise("ok").alias("status"))
    return each.unionByName(worst)


# Knowledge base and catalogue

def entries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    id_ = F.col("item_id")
    of = lambda *names: F.array(*map(F.lit, names))
    return b.select(
        id_.alias("id"), F.substring("text", 1, 60).alias("title"), F.array(word(2), word(5)).alias("keywords"), F.array(word(3)).alias("tags"), F.col("text").alias("content"), F.when(id_ % 2 == 0, "scenario").otherwise("entity").alias("type"),
        F.when(id_ % 3 == 0, of("trend", "extreme_volatility")).otherwise(of("oscillating")).alias("market_regime"), F.when(id_ % 4 == 0, of("all")).otherwise(of("daily")).alias("timeframe"),
    )


def _best(spark, sf_dir):
    return knowledge.score_entries(entries(spark, sf_dir), "the thatnd in heed", regime="trend", timeframe="daily", kind="scenario")


@query("entry_search", f"WITH {_ENTRY_SCORE} SELECT id, round(CASE WHEN s > 0 THEN s ELSE 0.02 END, 6) AS score FROM s ORDER BY score DESC, id LIMIT 5")
def entry_search(spark, sf_dir):
    return _best(spark, sf_dir).select("id", R("score").alias("score"))


@query("entry_search_indexed", f"WITH {_ENTRY_SCORE} SELECT id, round(CASE WHEN s > 0 THEN s ELSE 0.02 END, 6) AS score FROM s ORDER BY score DESC, id LIMIT 5")
def entry_search_indexed(spark, sf_dir):
    """entry_search() from an index, which is built first."""
    path = shared_path(spark, "index")
    retrieval.build_index(entries(spark, sf_dir), path)
    return retrieval.search(spark, path, "the thatnd in heed", regime="trend", timeframe="daily", kind="scenario").select("id", R("score").alias("score"))


@query("entry_by_title", f"WITH {_ENTRY} SELECT id, title, type FROM e WHERE lower(title) = (SELECT lower(title) FROM e ORDER BY id DESC LIMIT 1)")
def entry_by_title(spark, sf_dir):
    """The entries of one title, whatever its case: here that of the last one."""
    own = entries(spark, sf_dir)
    last = own.orderBy(F.desc("id")).limit(1).select(F.lower("title").alias("t"))
    return own.join(F.broadcast(last), F.lower("title") == F.col("t")).select("id", "title", "type")


@query("entry_prompt", f"WITH {_ENTRY_SCORE}, b AS (SELECT id, title, CASE WHEN s > 0 THEN s ELSE 0.02 END AS score FROM s ORDER BY score DESC, id LIMIT 5) SELECT string_agg('- ' || title || ' (' || printf('%.3f', score) || ')', chr(10) ORDER BY score DESC, id) AS prompt FROM b")
def entry_prompt(spark, sf_dir):
    return knowledge.prompt(_best(spark, sf_dir))


@query("entry_list", f"WITH {_ENTRY} SELECT type, count(*) AS n, min(title) AS first_title FROM e GROUP BY type")
def entry_list(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@query("store_stats", "SELECT 'documents' AS store, source AS part, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY event_type")
def store_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.lit("documents").alias("store"), F.col("source").alias("part")).agg(F.count("*").alias("n"))
    return d.unionByName(table(spark, sf_dir, "events").groupBy(F.lit("events").alias("store"), F.col("event_type").alias("part")).agg(F.count("*").alias("n")))


@query("rating_scores", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 WHEN 3 THEN -0.5 WHEN 4 THEN -1.0 ELSE 0.0 END::DOUBLE AS score FROM orders")
def rating_scores(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, [*strategies.RATINGS, "None"])), (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", strategies.rating_score(name).alias("score"))


@query("event_filters", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'click') AND CAST(json_extract(props, '$.k') AS DOUBLE) / 100 >= 0.6 AND user_id = 7")
def event_filters(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("confidence", F.from_json("props", "k double")["k"] / 100)
    return where_all(e, event_type=["purchase", "click"], user_id=7).where("confidence >= 0.6").select("event_id")


@query("tuple_in", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50) GROUP BY ALL")
def tuple_in(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.join(li.where("l_quantity = 50").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"], "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("outer_align", f"WITH {BARS}, a AS (SELECT date, close FROM bars WHERE ticker = 'Brand#11'), b AS (SELECT date, close FROM bars WHERE ticker = 'Brand#12') SELECT coalesce(a.date, b.date) AS date, round(a.close, 8) AS left_close, round(b.close, 8) AS right_close FROM a FULL JOIN b ON a.date = b.date")
def outer_align(spark, sf_dir):
    own = bars(spark, sf_dir)
    side = lambda t, c: own.where(F.col("ticker") == t).select("date", R("close", 8).alias(c))
    return side("Brand#11", "left_close").join(side("Brand#12", "right_close"), "date", "full")


@query("conformed", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(NULL AS DOUBLE) AS pct_change, o_totalprice, CAST(NULL AS DATE) AS closed FROM orders")
def conformed(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("o_orderkey", T.StringType()), T.StructField("pct_change", T.DoubleType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("closed", T.DateType())])
    return conform(table(spark, sf_dir, "orders"), schema)


@query("quarter_names", "SELECT o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders".replace("year(o_orderdate)", "(year(o_orderdate) + 10)"))
def quarter_names(spark, sf_dir):
    """Quarters read from texts of three kinds."""
    y, q = (F.year("o_orderdate") + 10).cast("string"), F.quarter("o_orderdate").cast("string")
    word = F.get(F.array(*map(F.lit, ("first", "second", "third", "fourth"))), F.quarter("o_orderdate") - 1)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Results "), y, F.lit(" Q"), q)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("q"), q, F.lit(" "), y, F.lit(" report"))).otherwise(F.concat(F.lit("In the "), word, F.lit(" quarter of "), y))
    return table(spark, sf_dir, "orders").select("o_orderkey", knowledge.quarter_of(text).alias("quarter"))


@query("to_json_like", "SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS payload FROM events WHERE props LIKE '%\"k\"%: 1%' OR props LIKE '%\"k\":1%'")
def to_json_like(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("props").like('%"k"%: 1%') | F.col("props").like('%"k":1%'))
    return e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("payload"))


@query("news_collected", "WITH a AS (SELECT doc_id AS id, text[:80] AS title, doc_id % 365 AS t FROM documents WHERE doc_id % 2 = 0), b AS (SELECT doc_id AS id, text[:80] AS title, doc_id % 365 AS t FROM documents WHERE doc_id % 2 = 1), n AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT *, row_number() OVER (PARTITION BY trim(title)[:40] ORDER BY id) AS k FROM n) SELECT id, t FROM f WHERE k = 1 ORDER BY t DESC, id LIMIT 50")
def news_collected(spark, sf_dir):
    """Two feeds together, one row a title, the newest first."""
    from marlstone.operators.text import dedup_prefix

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), (F.col("doc_id") % 365).alias("t"))
    both = d.where("id % 2 = 0").unionByName(d.where("id % 2 = 1"))
    return dedup_prefix(both).orderBy(F.desc("t"), "id").limit(50).select("id", "t")


@query("news_events", "SELECT 'evt_' || md5(text[:80])[:8] AS event_id, count(*) AS n FROM documents WHERE trim(text[:80]) <> '' GROUP BY 1")
def news_events(spark, sf_dir):
    """Event rows made of news, those of equal titles under one id; blank titles give none."""
    title = F.substring("text", 1, 80)
    d = table(spark, sf_dir, "documents").where(F.trim(title) != "")
    return d.groupBy(F.concat(F.lit("evt_"), F.substring(F.md5(title.cast("binary")), 1, 8)).alias("event_id")).agg(F.count("*").alias("n"))
