"""Logical tables derived from the shared ones, as DataFrames and as the SQL that the queries are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.scratch import dropped, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def _bars(trades: DataFrame) -> DataFrame:
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct(*_ORDER)
    return trades.groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(px, order).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"), F.max_by(px, order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
    )


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the brands: their line items are trades."""
    return _bars(_trades(spark, sf_dir))


#: Bars of up to so many are sent to all executors.
SENT = 1_000_000


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and closes of bars(), written.

    A largest tuple takes a sort of all trades, a largest number none. So bars first look up their last order; only its
    line items are compared as bars() does.
    """
    order = F.coalesce("l_orderkey", F.lit(-(1 << 63)))  # unknown is least, as in bars()
    last = written(_trades(spark, sf_dir).groupBy("ticker", F.to_date("l_shipdate").alias("date")).agg(F.max(order).alias("order")), "last")
    items = table(spark, sf_dir, "lineitem").select("l_shipdate", *_ORDER)
    of_last = items.join(F.broadcast(last) if last.count() <= SENT else last, (order == F.col("order")) & F.to_date("l_shipdate").eqNullSafe(F.col("date")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    trades = of_last.join(part, (F.col("l_partkey") == F.col("p_partkey")) & F.col("ticker").eqNullSafe(F.col("p_brand")))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    out = written(trades.groupBy("ticker", "date").agg(F.max_by(px, F.struct(*_ORDER)).alias("close")), "closes")
    dropped(last)
    return out


def sbars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the suppliers."""
    return _bars(table(spark, sf_dir, "lineitem").withColumn("ticker", F.col("l_suppkey").cast("string")))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return b.groupBy("date").agg(*[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.sum("volume").alias("volume"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly figures of the brands, known from the last day of the quarter on."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker")), F.col("l_partkey") == F.col("p_partkey"))
    start = F.to_date(F.date_trunc("quarter", F.col("l_shipdate")))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    q = items.groupBy("ticker", start.alias("q")).agg(revenue.alias("revenue"), F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("net_profit"), F.sum("l_quantity").alias("equity"))
    return q.select("ticker", F.date_sub(F.add_months("q", 3), 1).alias("report_date"), "revenue", "net_profit", "equity", (F.col("net_profit") / F.col("equity")).alias("eps"), (F.col("net_profit") / F.col("revenue")).alias("roe"))


def xsec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a part: industry, size and two factors."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("f_revenue"), F.avg("l_discount").alias("f_discount"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_type").alias("industry"), F.col("p_retailprice").alias("cap"))
    return part.join(items, F.col("entity") == F.col("l_partkey")).drop("l_partkey")


_TRADE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def _bars_sql(name: str, ticker: str, source: str) -> str:
    return f"""{name} AS (SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS date,
  first(l_extendedprice / l_quantity ORDER BY {_TRADE}) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, last(l_extendedprice / l_quantity ORDER BY {_TRADE}) AS close,
  sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM {source} GROUP BY ALL)"""


BARS = _bars_sql("bars", "p_brand", "lineitem JOIN part ON l_partkey = p_partkey")
SBARS = _bars_sql("sbars", "CAST(l_suppkey AS VARCHAR)", "lineitem")
INDEX = "index_bars AS (SELECT date, avg(open) AS open, avg(high) AS high, avg(low) AS low, avg(close) AS close, sum(volume) AS volume FROM bars GROUP BY date)"
FUNDAMENTALS = """quarters AS (SELECT p_brand AS ticker, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q,
  sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (l_discount - l_tax)) AS net_profit, sum(l_quantity) AS equity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
fundamentals AS (SELECT ticker, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS report_date, revenue, net_profit, equity,
  net_profit / equity AS eps, net_profit / revenue AS roe FROM quarters)"""
XSEC = """xsec AS (SELECT p_partkey AS entity, p_type AS industry, p_retailprice AS cap, sum(l_extendedprice) AS f_revenue, avg(l_discount) AS f_discount
  FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL)"""
