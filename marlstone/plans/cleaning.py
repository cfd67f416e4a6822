"""Cleaning and alignment queries, on bars with planted gaps and errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import align, clean
from marlstone.registry import query

from .views import BARS, SBARS, XSEC, bars, sbars, table, xsec

R = lambda c, n=6: F.round(c, n)

# Every seventh close is missing, every 11th open is negative, every 13th high and low are swapped, by day number.
DIRTY = f"""{BARS}, dirty AS (SELECT ticker, date, CASE WHEN k % 11 = 0 THEN -open ELSE open END AS open, CASE WHEN k % 13 = 0 THEN low - 1 ELSE high END AS high,
 CASE WHEN k % 13 = 0 THEN high ELSE low END AS low, CASE WHEN k % 7 <> 0 THEN close END AS close, CASE WHEN k % 17 = 0 THEN -volume ELSE volume END AS volume
 FROM (SELECT *, datediff('day', DATE '1990-01-01', date) AS k FROM bars))"""


def dirty(spark, sf_dir):
    k = F.datediff("date", F.lit("1990-01-01").cast("date"))
    b = bars(spark, sf_dir).withColumn("k", k)
    return b.select(
        "ticker", "date", F.when(F.col("k") % 11 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(F.col("k") % 13 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.when(F.col("k") % 13 == 0, F.col("high")).otherwise(F.col("low")).alias("low"), F.when(F.col("k") % 7 != 0, F.col("close")).alias("close"), F.when(F.col("k") % 17 == 0, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
    )


@query("clean_ohlcv", f"WITH {DIRTY} SELECT ticker, date, round(CASE WHEN open > 0 THEN open END, 8) AS open, round(CASE WHEN high > 0 AND (low <= 0 OR high >= low) THEN high END, 8) AS high, round(CASE WHEN low > 0 AND (high <= 0 OR high >= low) THEN low END, 8) AS low, round(close, 8) AS close, greatest(volume, 0) AS volume FROM dirty WHERE close IS NOT NULL")
def clean_ohlcv(spark, sf_dir):
    return clean.clean_ohlcv(dirty(spark, sf_dir)).select("ticker", "date", *[R(c, 8).alias(c) for c in clean.PRICES], "volume")


W = "PARTITION BY ticker ORDER BY date"


@query("ffill_limit", f"WITH {DIRTY} SELECT ticker, date, round(last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 8) AS close FROM dirty")
def ffill_limit(spark, sf_dir):
    return align.ffill(dirty(spark, sf_dir), ["close"], 5).select("ticker", "date", R("close", 8).alias("close"))


@query("bfill_limit", f"WITH {DIRTY} SELECT ticker, date, round(first_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 8) AS close FROM dirty")
def bfill_limit(spark, sf_dir):
    return align.bfill(dirty(spark, sf_dir), ["close"], 2).select("ticker", "date", R("close", 8).alias("close"))


@query("interpolate_time", f"""WITH {DIRTY}, n AS (SELECT *, row_number() OVER ({W}) AS n FROM dirty), k AS (SELECT ticker, date, n, close FROM n WHERE close IS NOT NULL),
j AS (SELECT n.ticker, n.date, n.n, n.close, p.close AS v0, p.date AS d0, p.n AS n0, q.close AS v1, q.date AS d1 FROM n ASOF LEFT JOIN k p ON p.ticker = n.ticker AND n.date >= p.date ASOF LEFT JOIN k q ON q.ticker = n.ticker AND n.date <= q.date)
SELECT ticker, date, round(CASE WHEN close IS NOT NULL THEN close WHEN n - n0 <= 5 THEN CASE WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * datediff('day', d0, date)::DOUBLE / datediff('day', d0, d1) END END, 8) AS close FROM j""")
def interpolate_time(spark, sf_dir):
    return align.interpolate(dirty(spark, sf_dir), "close", 5).select("ticker", "date", R("close", 8).alias("close"))


@query("impute_median", f"WITH {DIRTY}, m AS (SELECT ticker, quantile_cont(close, 0.5) AS med FROM dirty GROUP BY ticker) SELECT d.ticker, date, round(coalesce(close, med), 8) AS close FROM dirty d JOIN m ON m.ticker = d.ticker")
def impute_median(spark, sf_dir):
    return clean.fill_missing(dirty(spark, sf_dir).select("ticker", "date", "close"), ["close"], by=["ticker"]).select("ticker", "date", R("close", 8).alias("close"))


@query("winsorize", f"WITH {BARS}, q AS (SELECT ticker, quantile_cont(close, 0.02) AS lo, quantile_cont(close, 0.98) AS hi FROM bars GROUP BY ticker) SELECT b.ticker, date, round(least(greatest(close, lo), hi), 8) AS close FROM bars b JOIN q ON q.ticker = b.ticker")
def winsorize(spark, sf_dir):
    return clean.winsorize(bars(spark, sf_dir).select("ticker", "date", "close"), ["close"], 0.02, 0.98, by=["ticker"]).select("ticker", "date", R("close", 8).alias("close"))


@query("outliers_z", f"WITH {BARS}, s AS (SELECT ticker, avg(amount) AS m, stddev_samp(amount) AS sd FROM bars GROUP BY ticker) SELECT b.ticker, date, coalesce(abs((amount - m) / NULLIF(sd, 0)) > 2, false) AS is_outlier FROM bars b JOIN s ON s.ticker = b.ticker")
def outliers_z(spark, sf_dir):
    return clean.outliers(bars(spark, sf_dir), "amount", threshold=2.0, by=["ticker"]).select("ticker", "date", "is_outlier")


@query("outliers_iqr", f"WITH {BARS}, q AS (SELECT ticker, quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM bars GROUP BY ticker) SELECT x.ticker, date, amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a) AS is_outlier FROM bars x JOIN q ON q.ticker = x.ticker")
def outliers_iqr(spark, sf_dir):
    return clean.outliers(bars(spark, sf_dir), "amount", "iqr", 1.5, by=["ticker"]).select("ticker", "date", "is_outlier")


@query("split_adjust", f"WITH {BARS} SELECT ticker, date, round(CASE WHEN date < DATE '1997-01-01' THEN close * 2 ELSE close END, 8) AS close, round(CASE WHEN date < DATE '1997-01-01' THEN volume / 2 ELSE volume END, 8) AS volume FROM bars")
def split_adjust(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("split_ratio", F.when(F.col("date") < F.lit("1997-01-01").cast("date"), 2.0))
    return clean.adjust_for_splits(b).select("ticker", "date", R("close", 8).alias("close"), R("volume", 8).alias("volume"))


@query("pe_repair", f"WITH {XSEC}, p AS (SELECT entity, cap / 10 - 120 AS pe FROM xsec), m AS (SELECT quantile_cont(pe, 0.5) AS med FROM p WHERE pe > 0) SELECT entity, round(least(greatest(CASE WHEN pe < 0 THEN coalesce(med, pe) ELSE pe END, 0), 200), 6) AS pe FROM p, m")
def pe_repair(spark, sf_dir):
    p = xsec(spark, sf_dir).select("entity", (F.col("cap") / 10 - 120).alias("pe"))
    return clean.repair_pe(p, "pe").select("entity", R("pe").alias("pe"))


@query("clean_factor_recipe", f"WITH {XSEC}, p AS (SELECT entity, f_revenue AS f FROM xsec WHERE entity % 9 <> 0 AND entity % 10 <> 0), q AS (SELECT quantile_cont(f, 0.01) AS lo, quantile_cont(f, 0.99) AS hi FROM p) SELECT entity, round(least(greatest(f, lo), hi), 6) AS f FROM p, q")
def clean_factor_recipe(spark, sf_dir):
    planted = F.when(F.col("entity") % 10 == 0, F.lit(float("inf"))).when(F.col("entity") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("f_revenue"))
    p = xsec(spark, sf_dir).select("entity", planted.alias("f"))
    return clean.clean_factors(p, ["f"]).select("entity", R("f").alias("f"))


_DAILY = f"""{DIRTY}, extra AS (SELECT *, CASE WHEN datediff('day', DATE '1990-01-01', date) % 19 <> 0 THEN (datediff('day', DATE '1990-01-01', date) % 97 - 48)::DOUBLE END AS pct_change, (datediff('day', DATE '1990-01-01', date) % 61)::DOUBLE AS turnover FROM dirty),
kept AS (SELECT ticker, date, CASE WHEN open > 0 THEN open END AS open, CASE WHEN high > 0 AND (low <= 0 OR high >= low) THEN high END AS high, CASE WHEN low > 0 AND (high <= 0 OR high >= low) THEN low END AS low, close, greatest(volume, 0) AS volume, pct_change, turnover FROM extra WHERE close IS NOT NULL),
med AS (SELECT ticker, quantile_cont(open, 0.5) AS o, quantile_cont(high, 0.5) AS h, quantile_cont(low, 0.5) AS l, quantile_cont(pct_change, 0.5) AS p FROM kept GROUP BY ticker)"""


@query("clean_daily", f"WITH {_DAILY} SELECT k.ticker, date, round(coalesce(open, o), 8) AS open, round(coalesce(high, h), 8) AS high, round(coalesce(low, l), 8) AS low, round(close, 8) AS close, volume, least(greatest(coalesce(pct_change, p), -20), 20) AS pct_change, least(turnover, 50) AS turnover FROM kept k JOIN med m ON m.ticker = k.ticker")
def clean_daily(spark, sf_dir):
    k = F.datediff("date", F.lit("1990-01-01").cast("date"))
    d = dirty(spark, sf_dir).withColumns({"pct_change": F.when(k % 19 == 0, F.lit(float("inf"))).otherwise((k % 97 - 48).cast("double")), "turnover": (k % 61).cast("double")})
    own = clean.clean_daily(d, by=["ticker"])
    return own.select("ticker", "date", *[R(c, 8).alias(c) for c in clean.PRICES], "volume", "pct_change", "turnover")


@query("clean_valuation", f"""WITH {XSEC}, v AS (SELECT entity, CASE WHEN entity % 13 <> 0 AND entity % 17 <> 0 THEN cap / 10 - 120 END AS pe, CASE WHEN entity % 11 <> 0 THEN f_revenue / 100000 END AS pb FROM xsec), u AS (SELECT * FROM v WHERE pe IS NOT NULL OR pb IS NOT NULL),
pm AS (SELECT quantile_cont(pe, 0.5) AS m FROM u WHERE pe > 0), r AS (SELECT entity, CASE WHEN pe IS NOT NULL THEN least(greatest(CASE WHEN pe < 0 THEN coalesce(m, pe) ELSE pe END, 0), 200) END AS pe, pb FROM u, pm), md AS (SELECT quantile_cont(pe, 0.5) AS a, quantile_cont(pb, 0.5) AS b FROM r),
f AS (SELECT entity, coalesce(pe, a) AS pe, coalesce(pb, b) AS pb FROM r, md), q AS (SELECT quantile_cont(pe, 0.02) AS p0, quantile_cont(pe, 0.98) AS p1, quantile_cont(pb, 0.02) AS b0, quantile_cont(pb, 0.98) AS b1 FROM f)
SELECT entity, round(least(greatest(least(greatest(pe, p0), p1), 0), 200), 8) AS pe, round(least(greatest(least(greatest(pb, b0), b1), 0), 30), 8) AS pb FROM f, q""")
def clean_valuation(spark, sf_dir):
    """Ratios with gaps, infinities and negative values."""
    e = F.col("entity")
    pe = F.when(e % 13 == 0, F.lit(float("nan"))).when(e % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("cap") / 10 - 120)
    v = xsec(spark, sf_dir).select("entity", pe.alias("pe"), F.when(e % 11 != 0, F.col("f_revenue") / 100000).alias("pb"))
    return clean.clean_valuation(v, "pe", {"pb": (0, 30)}).select("entity", R("pe", 8).alias("pe"), R("pb", 8).alias("pb"))


@query("clean_macro", f"WITH {XSEC}, p AS (SELECT entity, CASE WHEN entity % 7 <> 0 THEN f_discount END AS f, CASE WHEN entity % 5 = 0 THEN cap END AS rate FROM xsec), m AS (SELECT quantile_cont(f, 0.5) AS a, quantile_cont(rate, 0.5) AS b FROM p), g AS (SELECT entity, coalesce(f, a) AS f, coalesce(rate, b) AS rate FROM p, m WHERE f IS NOT NULL OR rate IS NOT NULL), q AS (SELECT quantile_cont(f, 0.01) AS f0, quantile_cont(f, 0.99) AS f1, quantile_cont(rate, 0.01) AS r0, quantile_cont(rate, 0.99) AS r1 FROM g) SELECT entity, round(least(greatest(f, f0), f1), 6) AS f, round(least(greatest(rate, r0), r1), 4) AS rate, 0.0::DOUBLE AS missing FROM g, q")
def clean_macro(spark, sf_dir):
    """A factor with macro columns: one with gaps, which takes its median, and one that is never known, which is zero."""
    e = F.col("entity")
    p = xsec(spark, sf_dir).select("entity", F.when(e % 7 != 0, F.col("f_discount")).alias("f"), F.when(e % 5 == 0, F.col("cap")).alias("rate"), F.lit(None).cast("double").alias("missing"))
    own = clean.clean_factors(p, ["f", "rate", "missing"], macro=["rate", "missing"])
    return own.select("entity", R("f").alias("f"), R("rate", 4).alias("rate"), "missing")


@query("clip_range", "SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_discount * 100, 2), 8), 6) AS pct, greatest(l_quantity, 10) AS quantity FROM lineitem")
def clip_range(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_discount") * 100).alias("pct"), F.col("l_quantity").alias("quantity"))
    return clean.clip_by_range(li, {"pct": (2, 8), "quantity": (10, None), "absent": (0, 1)}).withColumn("pct", R("pct"))


ALIGN = f"{BARS}, a AS (SELECT date, close FROM bars WHERE ticker = 'Brand#11'), b AS (SELECT date, close FROM bars WHERE ticker = 'Brand#22'), c AS (SELECT date FROM a INTERSECT SELECT date FROM b)"


@query("align_multi_source", f"WITH {ALIGN} SELECT 'a' AS src, date, round(close, 8) AS close FROM a WHERE date IN (FROM c) UNION ALL SELECT 'b', date, round(close, 8) FROM b WHERE date IN (FROM c)")
def align_multi_source(spark, sf_dir):
    own = bars(spark, sf_dir)
    a, b = align.common_dates([own.where(F.col("ticker") == t).select("date", "close") for t in ("Brand#11", "Brand#22")])
    return a.select(F.lit("a").alias("src"), "date", R("close", 8).alias("close")).unionByName(b.select(F.lit("b").alias("src"), "date", R("close", 8).alias("close")))


@query("align_calendar", f"WITH {SBARS}, cal AS (SELECT DISTINCT date FROM sbars), t AS (SELECT DISTINCT ticker FROM sbars), x AS (SELECT t.ticker, cal.date FROM t, cal) SELECT x.ticker, x.date, round(s.close, 8) AS close, s.volume FROM x ASOF LEFT JOIN sbars s ON s.ticker = x.ticker AND x.date >= s.date")
def align_calendar(spark, sf_dir):
    s = sbars(spark, sf_dir).select("ticker", "date", "close", "volume")
    cal = s.select(F.col("date").alias("trade_date")).distinct()
    return align.on_calendar(s, cal).select("ticker", "date", R("close", 8).alias("close"), "volume")


EVENTS = "ev AS (SELECT 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS score FROM orders GROUP BY ALL)"


def events(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ticker = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    return o.groupBy(ticker.alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("score"))


@query("event_ffill_decay", f"WITH {BARS}, {EVENTS} SELECT b.ticker, b.date, last_value(score IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS score FROM bars b LEFT JOIN ev ON ev.ticker = b.ticker AND ev.date = b.date")
def event_ffill_decay(spark, sf_dir):
    return align.decay_events(bars(spark, sf_dir).select("ticker", "date"), events(spark, sf_dir), "score").select("ticker", "date", "score")
