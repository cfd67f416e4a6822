"""Scans, filters, aggregates and reports over the logical tables."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.rolling import series
from marlstone.functions.safe import number, sdiv
from marlstone.registry import query

from .views import BARS, INDEX, SBARS, bars, closes, index_bars, sbars, table

AS_OF = datetime.date(2001, 11, 4)


def where_all(df: DataFrame, **conditions) -> DataFrame:
    """Rows that meet every condition given; None leaves one out. start and end bound ``date``; a list is a choice."""
    tests = []
    for name, value in conditions.items():
        if value is None:
            continue
        if name in ("start", "end"):
            tests.append(F.col("date") >= F.lit(value) if name == "start" else F.col("date") <= F.lit(value))
        elif isinstance(value, (list, tuple)):
            tests.append(F.col(name).isin(list(value)))
        else:
            tests.append(F.col(name) == F.lit(value))
    return df.where(reduce(and_, tests, F.lit(True)))


R = lambda c, n=6: F.round(c, n)


@query("bars_daily", f"WITH {BARS} SELECT ticker, date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume, round(amount, 4) AS amount FROM bars")
def bars_daily(spark, sf_dir):
    return bars(spark, sf_dir).select("ticker", "date", *[R(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume", R("amount", 4).alias("amount"))


@query("scan_ticker_range", f"WITH {BARS} SELECT ticker, date, round(close, 6) AS close FROM bars WHERE ticker = 'Brand#12' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' ORDER BY date")
def scan_ticker_range(spark, sf_dir):
    return where_all(bars(spark, sf_dir), ticker="Brand#12", start=datetime.date(1996, 1, 1), end=datetime.date(1996, 12, 31)).select("ticker", "date", R("close").alias("close")).orderBy("date")


@query("index_scan", f"WITH {BARS}, {INDEX} SELECT date, round(open, 6) AS open, round(close, 6) AS close, volume FROM index_bars WHERE date >= DATE '1998-01-01'")
def index_scan(spark, sf_dir):
    return where_all(index_bars(spark, sf_dir), start=datetime.date(1998, 1, 1)).select("date", R("open").alias("open"), R("close").alias("close"), "volume")


@query("scan_in_list", f"WITH {BARS} SELECT ticker, count(*) AS n_days FROM bars WHERE ticker IN ('Brand#11', 'Brand#23', 'Brand#35') GROUP BY ticker")
def scan_in_list(spark, sf_dir):
    return where_all(bars(spark, sf_dir), ticker=["Brand#11", "Brand#23", "Brand#35"]).groupBy("ticker").agg(F.count("*").alias("n_days"))


@query("events_topn", "SELECT event_id, ts, event_type, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 100")
def events_topn(spark, sf_dir):
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    return e.select("event_id", "ts", "event_type", "value").orderBy(F.desc("ts"), "event_id").limit(100)


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, round(CAST(json_extract(props, '$.k') AS DOUBLE) / 100, 4) AS confidence FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), R(k / 100, 4).alias("confidence"))


@query("numbers_coerced", "SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS DOUBLE) AS priority, TRY_CAST(o_orderstatus AS DOUBLE) AS status FROM orders")
def numbers_coerced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", number(F.substring("o_orderpriority", 1, 1)).alias("priority"), number(F.col("o_orderstatus")).alias("status"))


MARKET = f"""{BARS}, chg AS (SELECT *, (close / NULLIF(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1) * 100 AS pct FROM bars)"""


def changes(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.withColumn("pct", (sdiv("close", F.lag("close").over(series())) - 1) * 100)


@query("market_summary", f"WITH {MARKET} SELECT date, count(DISTINCT ticker) AS n_tickers, round(avg(pct), 6) AS avg_pct, round(stddev_samp(pct), 6) AS std_pct, sum(volume) AS volume FROM chg GROUP BY date")
def market_summary(spark, sf_dir):
    return changes(spark, sf_dir).groupBy("date").agg(F.countDistinct("ticker").alias("n_tickers"), R(F.avg("pct")).alias("avg_pct"), R(F.stddev_samp("pct")).alias("std_pct"), F.sum("volume").alias("volume"))


RUNS = """runs AS (SELECT o_orderkey AS run_id, o_orderpriority AS strategy, CAST(o_orderdate AS DATE) AS created, o_totalprice / 100000 - 2 AS sharpe, -(o_totalprice / 1000000) AS max_drawdown, CAST(o_custkey % 20 AS BIGINT) AS trade_count, o_totalprice / 250000 - 1 AS annual_return FROM orders)"""


def runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("strategy"), F.to_date("o_orderdate").alias("created"), (F.col("o_totalprice") / 100000 - 2).alias("sharpe"), (-(F.col("o_totalprice") / 1000000)).alias("max_drawdown"), (F.col("o_custkey") % 20).alias("trade_count"), (F.col("o_totalprice") / 250000 - 1).alias("annual_return"))


@query("backtest_comparison", f"WITH {RUNS} SELECT strategy, max(created) AS last_run, round(avg(sharpe), 6) AS avg_sharpe, round(min(max_drawdown), 6) AS best_drawdown, count(*) AS n_runs FROM runs GROUP BY strategy")
def backtest_comparison(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("strategy").agg(F.max("created").alias("last_run"), R(F.avg("sharpe")).alias("avg_sharpe"), R(F.min("max_drawdown")).alias("best_drawdown"), F.count("*").alias("n_runs"))


@query("batch_summary", f"WITH {RUNS} SELECT strategy, count(*) AS n, round(avg(annual_return), 6) AS mean_return, round(avg(sharpe), 6) AS mean_sharpe, round(avg(max_drawdown), 6) AS mean_drawdown, CAST(sum(trade_count) AS BIGINT) AS trades FROM runs GROUP BY strategy")
def batch_summary(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), R(F.avg("annual_return")).alias("mean_return"), R(F.avg("sharpe")).alias("mean_sharpe"), R(F.avg("max_drawdown")).alias("mean_drawdown"), F.sum("trade_count").alias("trades"))


@query("best_run", f"WITH {RUNS} SELECT strategy, arg_max(run_id, (sharpe, -run_id)) AS run_id, round(max(sharpe), 6) AS sharpe FROM runs GROUP BY strategy".replace("arg_max(run_id, (sharpe, -run_id))", "first(run_id ORDER BY sharpe DESC, run_id)"))
def best_run(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("strategy").agg(F.max_by("run_id", F.struct("sharpe", -F.col("run_id"))).alias("run_id"), R(F.max("sharpe")).alias("sharpe"))


@query("run_scan", f"WITH {RUNS} SELECT run_id, strategy, created, round(sharpe, 6) AS sharpe FROM runs WHERE strategy = '1-URGENT' ORDER BY created DESC, run_id LIMIT 10")
def run_scan(spark, sf_dir):
    return where_all(runs(spark, sf_dir), strategy="1-URGENT").orderBy(F.desc("created"), "run_id").limit(10).select("run_id", "strategy", "created", R("sharpe").alias("sharpe"))


@query("prediction_accuracy", "SELECT count(*) AS total, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(CASE WHEN count(*) > 0 THEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / count(*) ELSE 0 END, 6) AS accuracy FROM orders WHERE o_orderdate >= DATE '2001-08-01' - INTERVAL 90 DAY")
def prediction_accuracy(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.date_sub(F.lit(datetime.date(2001, 8, 1)), 90))
    hit = F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))
    return o.agg(F.count("*").alias("total"), F.coalesce(hit, F.lit(0)).alias("correct"), R(F.coalesce(sdiv(hit, F.count("*")), F.lit(0.0))).alias("accuracy"))


DECISIONS = f"""{BARS}, dec AS (SELECT o_orderkey AS decision_id, CAST(o_orderdate AS DATE) AS decision_date, 'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS ticker, o_orderpriority AS signal_type FROM orders),
fwd AS (SELECT d.decision_id, b.close, row_number() OVER (PARTITION BY d.decision_id ORDER BY b.date) AS rn FROM dec d JOIN bars b ON b.ticker = d.ticker AND b.date BETWEEN d.decision_date AND d.decision_date + 15),
filled AS (SELECT d.decision_id, d.ticker, d.decision_date, d.signal_type,
 {', '.join(f"round(max(CASE WHEN rn = {k + 1} THEN close END) / NULLIF(max(CASE WHEN rn = 1 THEN close END), 0) - 1, 6) AS return_{k}d" for k in (1, 3, 5, 10))}
 FROM dec d LEFT JOIN fwd f ON f.decision_id = d.decision_id GROUP BY ALL)"""


def decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ticker = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    return o.select(F.col("o_orderkey").alias("decision_id"), F.to_date("o_orderdate").alias("decision_date"), ticker.alias("ticker"), F.col("o_orderpriority").alias("signal_type"))


def backfill_returns(decisions: DataFrame, prices: DataFrame, horizons=(1, 3, 5, 10), reach: int = 15) -> DataFrame:
    """Returns of each decision after so many bars, from the first bar on; null with fewer bars in ``reach`` days.

    The bars of a decision are ranked by a lead over the series instead of a join of ranges: each bar knows its
    followers. The different days of decisions look up their first bar through an as-of window that runs backwards, as
    a frame that ends with the series is summed anew for every row; decisions then join their day, of any number a day.
    """
    w = series()
    ahead = {f"_c{k}": F.lead("close", k).over(w) for k in horizons} | {f"_d{k}": F.lead("date", k).over(w) for k in horizons}
    bars_ = prices.select("ticker", "date", "close").withColumns(ahead)
    days = decisions.select("ticker", F.col("decision_date").alias("date")).where("ticker is not null and date is not null").distinct()
    both = bars_.select("ticker", "date", F.struct("date", "close", *ahead).alias("_bar")).unionByName(days, allowMissingColumns=True)
    back = Window.partitionBy("ticker").orderBy(F.desc("date"), F.col("_bar").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    first = both.select("ticker", F.col("date").alias("decision_date"), F.last("_bar", ignorenulls=True).over(back).alias("_first"), F.col("_bar").isNull().alias("_day"))
    found = decisions.join(first.where("_day").select("ticker", "decision_date", F.col("_first").alias("_bar")), ["ticker", "decision_date"], "left")
    limit = F.date_add("decision_date", reach)
    out = [F.when((F.col("_bar.date") <= limit) & (F.col(f"_bar._d{k}") <= limit), F.round(sdiv(F.col(f"_bar._c{k}"), F.col("_bar.close")) - 1, 6)).alias(f"return_{k}d") for k in horizons]
    return found.select(*decisions.columns, *out)


def returns_by_day(decisions: DataFrame, prices: DataFrame, *also: str) -> DataFrame:
    """backfill_returns() of all decisions of a ticker, a day and other columns together, which have the same; n: how many."""
    return backfill_returns(decisions.groupBy("ticker", "decision_date", *also).agg(F.count("*").alias("n")), prices)


def counted(test) -> Column:
    """Decisions of returns_by_day() that meet a test."""
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))


@query("decision_backfill", f"WITH {DECISIONS} SELECT * FROM filled")
def decision_backfill(spark, sf_dir):
    return backfill_returns(decisions(spark, sf_dir), bars(spark, sf_dir))


@query("decision_accuracy", f"WITH {DECISIONS} SELECT signal_type, count(*) AS total, count(return_5d) AS done, count(*) FILTER (WHERE return_5d > 0) AS wins, round(count(*) FILTER (WHERE return_5d > 0) / NULLIF(count(return_5d), 0), 6) AS accuracy, round(avg(return_5d), 6) AS avg_return FROM filled GROUP BY ROLLUP (signal_type)")
def decision_accuracy(spark, sf_dir):
    d = returns_by_day(decisions(spark, sf_dir), closes(spark, sf_dir), "signal_type")
    done, wins = counted(F.col("return_5d").isNotNull()), counted(F.col("return_5d") > 0)
    return d.rollup("signal_type").agg(F.sum("n").alias("total"), done.alias("done"), wins.alias("wins"), R(sdiv(wins, done)).alias("accuracy"), R(sdiv(F.sum(F.col("return_5d") * F.col("n")), done)).alias("avg_return"))


@query("win_rate_last_n", f"WITH {DECISIONS} SELECT ticker, round(avg(CAST(return_5d > 0 AS INTEGER)), 6) AS win_rate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY decision_date DESC, decision_id DESC) AS rn FROM filled WHERE return_5d IS NOT NULL) WHERE rn <= 20 GROUP BY ticker")
def win_rate_last_n(spark, sf_dir):
    """Decisions of one day won or lost together, so the last 20 are days counted back until they are full."""
    w = Window.partitionBy("ticker").orderBy(F.desc("decision_date")).rowsBetween(Window.unboundedPreceding, 0)
    d = returns_by_day(decisions(spark, sf_dir), closes(spark, sf_dir)).where("return_5d is not null")
    last = d.withColumn("n", F.least("n", 20 - (F.sum("n").over(w) - F.col("n")))).where("n > 0")
    return last.groupBy("ticker").agg(R(counted(F.col("return_5d") > 0) / F.sum("n")).alias("win_rate"), F.sum("n").alias("n"))


_LATER = DECISIONS.replace("CAST(o_orderdate AS DATE) AS decision_date", "CAST(o_orderdate AS DATE) + 110 AS decision_date")


@query("pending_decisions", f"WITH {_LATER} SELECT decision_id, ticker, decision_date FROM filled WHERE return_1d IS NULL AND return_3d IS NULL AND return_5d IS NULL AND return_10d IS NULL")
def pending_decisions(spark, sf_dir):
    """Decisions, here taken 110 days later so that some come after the last bars, that no return is known of yet."""
    later = decisions(spark, sf_dir).withColumn("decision_date", F.date_add("decision_date", 110))
    d = backfill_returns(later, closes(spark, sf_dir)).where(" and ".join(f"return_{k}d is null" for k in (1, 3, 5, 10)))
    return d.select("decision_id", "ticker", "decision_date")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("table_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_stats(spark, sf_dir):
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows")) for t in TABLES])


@query("latest_dates", "SELECT 'lineitem' AS table_name, CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem UNION ALL SELECT 'orders', CAST(max(o_orderdate) AS DATE) FROM orders UNION ALL SELECT 'events', CAST(max(ts) AS DATE) FROM events")
def latest_dates(spark, sf_dir):
    each = (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.to_date(F.max(c)).alias("last_date")) for t, c in each])


FRESH = f"""{BARS}, cal AS (SELECT DISTINCT date AS trade_date FROM bars), last_ AS (SELECT ticker, max(date) AS last_date FROM bars GROUP BY ticker)"""


def freshness(last: DataFrame, calendar: DataFrame, as_of, limit: int) -> DataFrame:
    """Trading days missed up to as_of: within the limit fresh, within twice the limit stale, else outdated.

    Days are numbered once, so that each lag is a difference; the calendar has a row a day.
    """
    numbered = calendar.where(F.col("trade_date") <= F.lit(as_of)).select("trade_date", F.row_number().over(Window.orderBy("trade_date")).alias("no"))
    total = numbered.agg(F.max("no").alias("total"))
    seen = last.join(F.broadcast(numbered), F.col("last_date") == F.col("trade_date"), "left").crossJoin(F.broadcast(total))
    lag = (F.col("total") - F.col("no")).cast("long")
    status = F.when(lag <= limit, "fresh").when(lag <= 2 * limit, "stale").otherwise("outdated")
    return seen.select("ticker", "last_date", lag.alias("lag_days"), status.alias("status"))


@query("freshness", f"WITH {FRESH} SELECT ticker, last_date, count(trade_date) AS lag_days, CASE WHEN count(trade_date) <= 1 THEN 'fresh' WHEN count(trade_date) <= 2 THEN 'stale' ELSE 'outdated' END AS status FROM last_ LEFT JOIN cal ON trade_date > last_date AND trade_date <= DATE '2001-11-04' GROUP BY ticker, last_date")
def freshness_q(spark, sf_dir):
    b = bars(spark, sf_dir)
    return freshness(b.groupBy("ticker").agg(F.max("date").alias("last_date")), b.select(F.col("date").alias("trade_date")).distinct(), AS_OF, 1)


@query("universe", f"WITH {BARS} SELECT ticker, count(*) AS n_days FROM bars GROUP BY ticker ORDER BY n_days DESC, ticker")
def universe(spark, sf_dir):
    return bars(spark, sf_dir).groupBy("ticker").agg(F.count("*").alias("n_days")).orderBy(F.desc("n_days"), "ticker")


@query("ticker_search", "SELECT DISTINCT p_name FROM part WHERE p_name LIKE '%ring%' ORDER BY p_name LIMIT 20")
def ticker_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").contains("ring")).select("p_name").distinct().orderBy("p_name").limit(20)


@query("board_search", "SELECT n_name FROM nation WHERE contains(lower(n_name), lower('Tion_1'))")
def board_search(spark, sf_dir):
    return table(spark, sf_dir, "nation").where(F.lower("n_name").contains("Tion_1".lower())).select("n_name")


@query("calendar_year", f"WITH {BARS} SELECT DISTINCT date AS trade_date FROM bars WHERE year(date) = 1997")
def calendar_year(spark, sf_dir):
    return bars(spark, sf_dir).where(F.year("date") == 1997).select(F.col("date").alias("trade_date")).distinct()


@query("facts_by_type", "SELECT event_type, count(*) AS n, CAST(count_if(value > 50) AS BIGINT) AS verified FROM events GROUP BY event_type")
def facts_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("verified"))


@query("events_by_type_and_day", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (CAST(ts AS DATE)))")
def events_by_type_and_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    return e.groupingSets([["event_type"], ["day"]], "event_type", "day").agg(F.count("*").alias("n"))


@query("status_rollup", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def status_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("board_index", f"WITH {SBARS}, idx AS (SELECT s_nationkey AS board, date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume, count(close) AS n FROM sbars JOIN supplier ON ticker = CAST(s_suppkey AS VARCHAR) GROUP BY ALL) SELECT board, date, round(open, 8) AS open, round(close, 8) AS close, volume, n, round((close / NULLIF(lag(close) OVER (PARTITION BY board ORDER BY date), 0) - 1) * 100, 6) AS pct_change FROM idx")
def board_index(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("s_nationkey").alias("board"))
    idx = sbars(spark, sf_dir).join(s, "ticker").groupBy("board", "date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"), F.count("close").alias("n"))
    w = Window.partitionBy("board").orderBy("date")
    return idx.select("board", "date", R("open", 8).alias("open"), R("close", 8).alias("close"), "volume", "n", R((sdiv("close", F.lag("close").over(w)) - 1) * 100).alias("pct_change"))


@query("latest_quote", f"WITH {BARS} SELECT ticker, max(date) AS date, round(last(close ORDER BY date), 6) AS close, round(last(close ORDER BY date) / NULLIF(last(prev ORDER BY date), 0) - 1, 6) AS change FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars) GROUP BY ticker")
def latest_quote(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("prev", F.lag("close").over(series()))
    last = b.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "prev"), "date").alias("r"))
    return last.select("ticker", "r.date", R("r.close").alias("close"), R(sdiv("r.close", "r.prev") - 1).alias("change"))


@query("trading_day_neighbors", f"WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars WHERE ticker = 'Brand#11'), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d, bool_or(date = d) AS is_trading_day, max(CASE WHEN date <= d THEN date END) AS last_day, min(CASE WHEN date > d THEN date END) AS next_day FROM days, cal GROUP BY d")
def trading_day_neighbors(spark, sf_dir):
    cal = bars(spark, sf_dir).where(F.col("ticker") == "Brand#11").select("date").distinct()
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    both = days.select("d", F.lit(True).alias("asked")).join(cal.select(F.col("date").alias("d"), F.lit(True).alias("open")), "d", "full")
    day = F.when(F.col("open"), F.col("d"))
    w = Window.orderBy("d")  # a row a calendar day
    seen = both.withColumns({"last_day": F.last(day, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next_day": F.first(day, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    return seen.where("asked").select("d", F.coalesce("open", F.lit(False)).alias("is_trading_day"), "last_day", "next_day")


@query("month_end_trading_days", f"WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars), n AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM cal) SELECT date, coalesce(date_trunc('month', date) <> date_trunc('month', nxt), true) AS month_end, coalesce(date_trunc('quarter', date) <> date_trunc('quarter', nxt), true) AS quarter_end, dayofweek(date) = 5 AS friday FROM n")
def month_end_trading_days(spark, sf_dir):
    cal = bars(spark, sf_dir).select("date").distinct().withColumn("nxt", F.lead("date").over(Window.orderBy("date")))
    ends = lambda unit: F.coalesce(F.trunc("date", unit) != F.trunc("nxt", unit), F.lit(True))
    return cal.select("date", ends("month").alias("month_end"), ends("quarter").alias("quarter_end"), (F.dayofweek("date") == 6).alias("friday"))


@query("weekday_calendar", "SELECT CAST(d AS DATE) AS trade_date FROM range(DATE '1998-01-01', DATE '1999-01-01', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND CAST(d AS DATE) NOT IN (DATE '1998-01-01', DATE '1998-05-01', DATE '1998-10-01')")
def weekday_calendar(spark, sf_dir):
    days = spark.sql("SELECT explode(sequence(DATE '1998-01-01', DATE '1998-12-31')) AS trade_date")
    holidays = spark.sql("SELECT explode(array(DATE '1998-01-01', DATE '1998-05-01', DATE '1998-10-01')) AS trade_date")
    return days.where(F.dayofweek("trade_date").between(2, 6)).join(holidays, "trade_date", "left_anti")


@query("key_metrics", f"WITH {BARS} SELECT count(DISTINCT ticker) AS n_tickers, max(date) AS last_date, count(*) AS n_bars, CASE WHEN count(DISTINCT ticker) >= 300 THEN 'ok' WHEN count(DISTINCT ticker) >= 20 THEN 'warning' ELSE 'error' END AS coverage FROM bars")
def key_metrics(spark, sf_dir):
    n = F.countDistinct("ticker")
    return bars(spark, sf_dir).agg(n.alias("n_tickers"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"), F.when(n >= 300, "ok").when(n >= 20, "warning").otherwise("error").alias("coverage"))


@query("active_users", "SELECT count(DISTINCT user_id) AS n_users FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def active_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 24 HOUR")).agg(F.countDistinct("user_id").alias("n_users"))


for _name, _window, _from, _to in (
    ("window_tumbling", lambda: F.window("ts", "1 hour"), "time_bucket(INTERVAL 1 HOUR, ts)", "INTERVAL 1 HOUR"),
    ("window_sliding", lambda: F.window("ts", "2 hours", "1 hour"), "unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR])", "INTERVAL 2 HOUR"),
):
    _sql = f"SELECT start, start + {_to} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT {_from} AS start, event_type, value FROM events) GROUP BY ALL"

    @query(_name, _sql)
    def _windowed(spark, sf_dir, window=_window):
        g = table(spark, sf_dir, "events").groupBy(window().alias("w"), "event_type").agg(F.count("*").alias("n"), R(F.sum("value"), 4).alias("total"))
        return g.select("w.start", "w.end", "event_type", "n", "total")


@query("window_session", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def window_session(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", "w.start", "w.end", "n")


@query("weekly_factor_stats", f"WITH {BARS}, cal AS (SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 5) SELECT ticker, count(*) AS n, round(avg(close), 6) AS avg_close, round(stddev_samp(close), 6) AS std_close FROM bars WHERE date IN (SELECT date FROM cal) GROUP BY ticker ORDER BY n DESC, ticker LIMIT 10")
def weekly_factor_stats(spark, sf_dir):
    b = bars(spark, sf_dir)
    last = b.select("date").distinct().orderBy(F.desc("date")).limit(5)
    g = b.join(F.broadcast(last), "date", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"), R(F.avg("close")).alias("avg_close"), R(F.stddev_samp("close")).alias("std_close"))
    return g.orderBy(F.desc("n"), "ticker").limit(10)


@query("quarter_report", f"WITH {BARS}, {INDEX} SELECT CAST(date_trunc('quarter', date) AS DATE) AS quarter, round(last(close ORDER BY date) / first(close ORDER BY date) - 1, 6) AS total_return, round(max(high), 6) AS high, round(min(low), 6) AS low, sum(volume) AS volume FROM index_bars GROUP BY 1")
def quarter_report(spark, sf_dir):
    q = F.to_date(F.date_trunc("quarter", "date"))
    return index_bars(spark, sf_dir).groupBy(q.alias("quarter")).agg(R(F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total_return"), R(F.max("high")).alias("high"), R(F.min("low")).alias("low"), F.sum("volume").alias("volume"))


@query("report_rollup", "SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n_days, string_agg(DISTINCT strftime(o_orderdate, '%Y-%m-%d'), ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d')) AS days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) GROUP BY 1")
def report_rollup(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.groupBy(F.to_date(F.date_trunc("week", "d")).alias("week")).agg(F.count("*").alias("n_days"), F.array_join(F.sort_array(F.collect_list(F.date_format("d", "yyyy-MM-dd"))), ",").alias("days"))


@query("set_difference", "SELECT DISTINCT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).subtract(table(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_custkey"))


@query("semi_anti", "SELECT c_mktsegment AS segment, CAST(count_if(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)) AS BIGINT) AS big, count(*) AS n FROM customer GROUP BY 1")
def semi_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    big = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").withColumn("big", F.lit(1))
    rest = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").withColumn("big", F.lit(0))
    return big.unionByName(rest).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("big").alias("big"), F.count("*").alias("n"))


@query("ticker_normalised", "SELECT p_partkey, CASE WHEN length(t) < 6 THEN lpad(t, 6, '0') ELSE t END AS ticker FROM (SELECT p_partkey, regexp_replace(upper(trim(' ' || CAST(p_partkey AS VARCHAR) || '.sz ')), '\\.(SZ|SH|BJ)$', '') AS t FROM part)")
def ticker_normalised(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".sz "))
    t = F.regexp_replace(F.upper(F.trim(raw)), r"\.(SZ|SH|BJ)$", "")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t).alias("ticker"))
