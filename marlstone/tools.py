"""Tools by name: SQL table functions over the stored tables, and a few jobs that write or need an operator.

A table function has typed, named and defaulted parameters and is part of the plan of the query that calls it, so that
its filters reach the scans: ``SELECT * FROM get_history('Brand#12', days => 5)`` once register() has made them. A
parameter that a tool does not have, or one too many, is an error in either kind.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import registry


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    #: A table function's parameters, columns and query; or what runs the tool.
    parameters: str = ""
    columns: str = ""
    query: str = ""
    views: tuple[str, ...] = ()
    run: Callable[..., DataFrame] | None = None
    read_only: bool = True
    skill: str = "data"


TOOLS: dict[str, Tool] = {}


def _add(tool: Tool) -> None:
    if tool.name in TOOLS:
        raise ValueError(f"tool {tool.name} is registered twice")
    TOOLS[tool.name] = tool


def tool(name: str, description: str, skill: str = "data", read_only: bool = True):
    """Register a function (spark, sf_dir, its own parameters) as a tool."""

    def add(fn):
        _add(Tool(name, description, run=fn, read_only=read_only, skill=skill))
        return fn

    return add


def sql_tool(name: str, parameters: str, columns: str, views: str, query: str, description: str, skill: str = "data") -> None:
    _add(Tool(name, description, parameters, columns, query, tuple(views.split()), skill=skill))


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make the table functions (all without names) and the views that they read, for this session and these tables."""
    wanted = [TOOLS[n] for n in names or TOOLS if not TOOLS[n].run]
    for view in sorted({v for t in wanted for v in t.views}):
        VIEWS[view](spark, sf_dir).createOrReplaceTempView(f"tool_{view}")
    for t in wanted:
        text = t.description.replace("'", "''")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {t.name}({t.parameters}) RETURNS TABLE({t.columns}) COMMENT '{text}' RETURN {t.query}")


def call(name: str, spark: SparkSession, sf_dir: str, **params) -> DataFrame:
    if name not in TOOLS:
        raise KeyError(f"no tool {name}")
    if TOOLS[name].run:
        return TOOLS[name].run(spark, sf_dir, **params)
    register(spark, sf_dir, name)
    if "ticker" in params:
        params["ticker"] = resolve_ticker(params["ticker"])
    return spark.sql(f"SELECT * FROM {name}({', '.join(f'{p} => :{p}' for p in params)})", args=params)


def listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.description, t.parameters, t.read_only, t.skill) for t in TOOLS.values()], "name string, description string, parameters string, read_only boolean, skill string")


def resolve_ticker(ticker: str) -> str:
    """Trimmed, upper case without an exchange, digits to six places; other names as they are."""
    t = ticker.strip()
    for end in (".SZ", ".SH", ".BJ"):
        t = t[: -len(end)] if t.upper().endswith(end) else t
    return t.zfill(6) if t.isdigit() else t


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(name: str):
    return lambda spark, sf_dir: registry.queries()[name](spark, sf_dir)


def _bars(spark, sf_dir):
    from marlstone.plans.reports import changes

    return changes(spark, sf_dir)


def _index(spark, sf_dir):
    from marlstone.plans.views import index_bars

    return index_bars(spark, sf_dir).withColumn("index_code", F.lit("index"))


def _fundamentals(spark, sf_dir):
    from marlstone.plans.views import fundamentals

    return fundamentals(spark, sf_dir)


def _factors(spark, sf_dir):
    from marlstone.plans.factors import long

    return long(spark, sf_dir)


def _pairs(spark, sf_dir):
    from marlstone.operators import factors as fac
    from marlstone.operators.evaluate import forward_return
    from marlstone.plans.factors import panel

    own = panel(spark, sf_dir).withColumn("fwd", forward_return(5))
    return own.unpivot(["ticker", "date", "fwd"], fac.list_factors(), "factor_name", "factor_value").where("factor_value is not null and fwd is not null")


def _sectors(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    s = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(read("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    kinds = F.explode(F.array(F.struct(F.lit("nation").alias("sector_type"), F.col("n_name").alias("sector_name")), F.struct(F.lit("region").alias("sector_type"), F.col("r_name").alias("sector_name"))))
    return s.select(F.col("s_suppkey").cast("string").alias("ticker"), kinds.alias("k")).select("ticker", "k.*")


def _sbars(spark, sf_dir):
    from marlstone.plans.views import sbars

    return sbars(spark, sf_dir)


def _decisions(spark, sf_dir):
    from marlstone.plans.reports import decision_backfill

    return decision_backfill(spark, sf_dir)


def _runs(spark, sf_dir):
    from marlstone.plans.reports import runs

    return runs(spark, sf_dir)


def _entries(spark, sf_dir):
    from marlstone.plans.library import entries

    return entries(spark, sf_dir)


def _strategies(spark, sf_dir):
    from marlstone.operators import strategies

    rows = [(n, k, str(v)) for n, s in strategies.REGISTRY.items() for k, v in vars(s).items() if isinstance(v, (int, float, str))]
    return spark.createDataFrame(rows, "strategy string, name string, value string")


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bars": _bars, "index": _index, "fundamentals": _fundamentals, "factors": _factors, "pairs": _pairs, "sectors": _sectors, "sbars": _sbars, "decisions": _decisions, "runs": _runs,
    "entries": _entries, "strategies": _strategies, "events": _table("events"), "orders": _table("orders"), "freshness": _q("freshness"), "stats": _q("table_stats"), "store": _q("store_stats"),
    "health": _q("health_checks"), "stress": _q("stress_by_ticker"), "decay": _q("decay_report"), "sentiment": _q("sentiment_signals"), "hypotheses": _q("factor_hypotheses"), "review": _q("committee_review"),
    "validation": _q("signal_validation"), "regimes": _q("regime"), "daily": _q("daily_report"),
}

_BAR = "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, pct DOUBLE"
_NEWEST = "row_number() OVER (ORDER BY date DESC)"

sql_tool("get_quote", "ticker STRING", "ticker STRING, date DATE, close DOUBLE, pct DOUBLE", "bars", f"SELECT b.ticker, date, close, pct FROM (SELECT *, {_NEWEST} AS k FROM tool_bars b0 WHERE b0.ticker = get_quote.ticker) b WHERE k = 1", "last close and change in per cent")
sql_tool("get_history", "ticker STRING, days INT DEFAULT 60", _BAR, "bars", f"SELECT date, open, high, low, close, volume, pct FROM (SELECT *, {_NEWEST} AS k FROM tool_bars b WHERE b.ticker = get_history.ticker) WHERE k <= get_history.days", "the last bars of an instrument with their change in per cent")
sql_tool("get_factors", "ticker STRING DEFAULT '', factor_name STRING DEFAULT ''", "ticker STRING, factor_name STRING, date DATE, factor_value DOUBLE", "factors",
    "SELECT f.ticker, f.factor_name, f.date, f.factor_value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, factor_name ORDER BY date DESC) AS k FROM tool_factors) f WHERE k = 1 AND (get_factors.ticker = '' OR f.ticker = get_factors.ticker) AND (get_factors.factor_name = '' OR f.factor_name = get_factors.factor_name)", "the newest values of factors, of one instrument or factor if given")
sql_tool("get_index_data", "index_code STRING DEFAULT 'index', days INT DEFAULT 30", "date DATE, close DOUBLE, volume DOUBLE", "index", f"SELECT date, close, volume FROM (SELECT *, {_NEWEST} AS k FROM tool_index i WHERE i.index_code = get_index_data.index_code) WHERE k <= get_index_data.days", "the last bars of the index")
sql_tool("get_universe", "", "ticker STRING, n_days BIGINT", "bars", "SELECT ticker, count(*) FROM tool_bars GROUP BY ticker", "instruments and their days")
sql_tool("get_market_overview", "", "date DATE, n_tickers BIGINT, up BIGINT, down BIGINT, avg_pct DOUBLE", "bars", "SELECT date, count(*), count_if(pct > 0), count_if(pct < 0), avg(pct) FROM tool_bars WHERE date = (SELECT max(date) FROM tool_bars) GROUP BY date", "the market on its last day")
sql_tool("search_tickers", "query STRING", "ticker STRING", "bars", "SELECT ticker FROM (SELECT ticker, row_number() OVER (ORDER BY ticker) AS k FROM (SELECT DISTINCT ticker FROM tool_bars) t WHERE contains(lower(ticker), lower(search_tickers.query))) WHERE k <= 20", "up to twenty instruments whose name holds a word")
sql_tool("get_calendar", "year INT DEFAULT 0", "trade_date DATE", "bars", "SELECT DISTINCT date FROM tool_bars WHERE year(date) = CASE WHEN get_calendar.year = 0 THEN (SELECT year(max(date)) FROM tool_bars) ELSE get_calendar.year END", "trading days of a year, the last one without")
sql_tool("run_factor_evaluation", "ticker STRING, factor_name STRING DEFAULT 'momentum_20d'", "n BIGINT, ic DOUBLE, grade STRING", "pairs",
    "SELECT n, ic, CASE WHEN abs(ic) > 0.05 THEN 'A' WHEN abs(ic) > 0.03 THEN 'B' WHEN abs(ic) > 0.01 THEN 'C' ELSE 'D' END FROM (SELECT count(*) AS n, corr(x, y) AS ic FROM (SELECT rank() OVER (ORDER BY factor_value) + (count(*) OVER (PARTITION BY factor_value) - 1) / 2 AS x, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1) / 2 AS y FROM tool_pairs p WHERE p.ticker = run_factor_evaluation.ticker AND p.factor_name = run_factor_evaluation.factor_name))", "rank correlation of a factor with the returns of five bars", "research")
sql_tool("get_sector_list", "sector_type STRING DEFAULT 'nation'", "sector_name STRING, n_members BIGINT", "sectors", "SELECT sector_name, count(ticker) FROM tool_sectors s WHERE s.sector_type = get_sector_list.sector_type GROUP BY sector_name", "sectors of a type (nation, region) and their members")
sql_tool("get_sector_stocks", "sector_name STRING, sector_type STRING DEFAULT 'nation'", "ticker STRING, sector_name STRING", "sectors",
    "SELECT ticker, sector_name FROM (SELECT *, dense_rank() OVER (ORDER BY other, sector_name) AS k FROM (SELECT s.ticker, s.sector_name, lower(s.sector_name) <> lower(get_sector_stocks.sector_name) AS other FROM tool_sectors s WHERE s.sector_type = get_sector_stocks.sector_type AND contains(lower(s.sector_name), lower(get_sector_stocks.sector_name)))) WHERE k = 1 AND ticker IS NOT NULL", "members of a sector: of that name, else of the first whose name holds it")
sql_tool("get_sector_index", "sector_name STRING, sector_type STRING DEFAULT 'nation', days INT DEFAULT 60", "date DATE, close DOUBLE, volume DOUBLE, n BIGINT", "sectors sbars",
    f"SELECT date, close, volume, n FROM (SELECT *, {_NEWEST} AS k FROM (SELECT date, avg(close) AS close, sum(volume) AS volume, count(*) AS n FROM tool_sbars b JOIN tool_sectors s ON s.ticker = b.ticker WHERE s.sector_type = get_sector_index.sector_type AND lower(s.sector_name) = lower(get_sector_index.sector_name) GROUP BY date)) WHERE k <= get_sector_index.days", "the last bars of a sector, means of its members")
_ITEMS = "stack(5, 'income', 'revenue', revenue, 'income', 'net_profit', net_profit, 'balance', 'equity', equity, 'ratio', 'eps', eps, 'ratio', 'roe', roe) AS (kind, item, value)"
sql_tool("get_financials", "ticker STRING, report_type STRING DEFAULT 'all'", "report_date DATE, item STRING, value DOUBLE", "fundamentals", f"SELECT report_date, item, value FROM (SELECT report_date, {_ITEMS} FROM tool_fundamentals f WHERE f.ticker = get_financials.ticker) WHERE get_financials.report_type IN ('all', kind)", "reported figures: all, income, balance or ratio")
sql_tool("get_latest_financials", "ticker STRING", "report_date DATE, revenue DOUBLE, net_profit DOUBLE, equity DOUBLE, eps DOUBLE, roe DOUBLE", "fundamentals", "SELECT report_date, revenue, net_profit, equity, eps, roe FROM (SELECT *, row_number() OVER (ORDER BY report_date DESC) AS k FROM tool_fundamentals f WHERE f.ticker = get_latest_financials.ticker) WHERE k = 1", "the last reported figures")
sql_tool("check_data_freshness", "", "ticker STRING, last_date DATE, lag_days BIGINT, status STRING", "freshness", "SELECT ticker, last_date, lag_days, status FROM tool_freshness", "trading days missed")
sql_tool("get_factor_collinearity", "threshold DOUBLE DEFAULT 0.7, tickers STRING DEFAULT '', days INT DEFAULT 90", "factor_a STRING, factor_b STRING, corr DOUBLE", "factors",
    """SELECT a, b, c FROM (SELECT x.factor_name AS a, y.factor_name AS b, corr(x.factor_value, y.factor_value) AS c FROM tool_factors x JOIN tool_factors y ON x.ticker = y.ticker AND x.date = y.date AND x.factor_name < y.factor_name
 WHERE (get_factor_collinearity.tickers = '' OR array_contains(split(get_factor_collinearity.tickers, ','), x.ticker)) AND x.date > date_sub((SELECT max(date) FROM tool_factors), get_factor_collinearity.days) GROUP BY x.factor_name, y.factor_name) WHERE abs(c) >= get_factor_collinearity.threshold""", "factors that say the same over the last days", "research")  # fmt: skip
sql_tool("get_daily_report", "report_date STRING DEFAULT ''", "report STRING", "daily", "SELECT report FROM tool_daily WHERE get_daily_report.report_date = '' OR contains(report, concat('date: ', get_daily_report.report_date))", "the day's report", "knowledge")
sql_tool("search_events", "ticker STRING DEFAULT '', event_type STRING DEFAULT '', days INT DEFAULT 7", "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE", "events",
    "SELECT event_id, CAST(ts AS TIMESTAMP), user_id, e.event_type, value FROM tool_events e WHERE (search_events.ticker = '' OR CAST(user_id AS STRING) = search_events.ticker) AND (search_events.event_type = '' OR e.event_type = search_events.event_type) AND ts > (SELECT max(ts) FROM tool_events) - make_dt_interval(search_events.days)", "events of the last days, of a user or kind if given", "knowledge")
_TOKENS = "filter(split(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}_]+'), t -> t <> '')"
_SHARE = lambda c: f"least(size(array_intersect(words, {_TOKENS.format(c)})) / size(words), 1)"
sql_tool("wiki_search", "query STRING, top_k INT DEFAULT 3", "id BIGINT, title STRING, score DOUBLE", "entries",
    f"""SELECT id, title, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k FROM (SELECT id, title, CASE WHEN s > 0 THEN s ELSE 0.02 END AS score FROM (SELECT id, title, 0.35 * {_SHARE('title')} + 0.25 * {_SHARE("array_join(keywords, ' ')")} + 0.15 * greatest({_SHARE("array_join(tags, ' ')")}, 0.5 * {_SHARE('substring(content, 1, 200)')}) AS s
 FROM (SELECT *, array_distinct({_TOKENS.format('wiki_search.query')}) AS words FROM tool_entries)))) WHERE k <= wiki_search.top_k""", "entries that fit a question", "knowledge")  # fmt: skip
sql_tool("get_knowledge_stats", "", "store STRING, part STRING, n BIGINT", "store", "SELECT store, part, n FROM tool_store", "sizes of the stores", "knowledge")
sql_tool("get_recent_events", "most INT DEFAULT 20", "event_id BIGINT, ts TIMESTAMP, event_type STRING, value DOUBLE", "events", "SELECT event_id, CAST(ts AS TIMESTAMP), event_type, value FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS k FROM tool_events) WHERE k <= get_recent_events.most", "the newest events", "knowledge")
sql_tool("get_decision_accuracy", "signal_type STRING DEFAULT '', days INT DEFAULT 90", "signal_type STRING, total BIGINT, done BIGINT, wins BIGINT, accuracy DOUBLE", "decisions",
    "SELECT d.signal_type, count(*), count(return_5d), count_if(return_5d > 0), try_divide(count_if(return_5d > 0), count(return_5d)) FROM tool_decisions d WHERE (get_decision_accuracy.signal_type = '' OR d.signal_type = get_decision_accuracy.signal_type) AND decision_date > date_sub((SELECT max(decision_date) FROM tool_decisions), get_decision_accuracy.days) GROUP BY d.signal_type", "how often the decisions of the last days were right", "knowledge")
sql_tool("get_recent_decisions", "most INT DEFAULT 20", "decision_id BIGINT, ticker STRING, decision_date DATE, return_5d DOUBLE", "decisions", "SELECT decision_id, ticker, decision_date, return_5d FROM (SELECT *, row_number() OVER (ORDER BY decision_date DESC, decision_id DESC) AS k FROM tool_decisions) WHERE k <= get_recent_decisions.most", "the newest decisions", "knowledge")
sql_tool("get_prediction_accuracy", "days INT DEFAULT 30", "total BIGINT, correct BIGINT, accuracy DOUBLE", "orders", "SELECT count(*), count_if(o_orderstatus = 'F'), try_divide(count_if(o_orderstatus = 'F'), count(*)) FROM tool_orders WHERE o_orderdate > date_sub((SELECT CAST(max(o_orderdate) AS DATE) FROM tool_orders), get_prediction_accuracy.days)", "how often the predictions of the last days were right", "knowledge")
sql_tool("get_db_stats", "", "table_name STRING, n_rows BIGINT", "stats", "SELECT table_name, n_rows FROM tool_stats", "rows of all tables", "ops")
sql_tool("get_social_sentiment", "days INT DEFAULT 1", "event_type STRING, n BIGINT, mean_value DOUBLE", "events", "SELECT event_type, count(*), avg(value) FROM tool_events WHERE ts > (SELECT max(ts) FROM tool_events) - make_dt_interval(get_social_sentiment.days) GROUP BY event_type", "what is said in the last days", "knowledge")
sql_tool("search_hypotheses", "most INT DEFAULT 20", "factor_name STRING, ticker STRING, ic DOUBLE, direction STRING, status STRING", "hypotheses", "SELECT factor_name, ticker, ic, direction, status FROM (SELECT *, row_number() OVER (ORDER BY abs(ic) DESC, ticker, factor_name) AS k FROM tool_hypotheses) WHERE k <= search_hypotheses.most", "the strongest hypotheses on factors", "knowledge")
_PERIOD = "CASE {0}.report_type WHEN 'weekly' THEN 5 WHEN 'monthly' THEN 20 ELSE 60 END"
sql_tool("get_higher_order_report", "report_type STRING DEFAULT 'weekly', report_date DATE DEFAULT NULL", "factor_name STRING, n BIGINT, mean DOUBLE, std DOUBLE", "factors",
    f"SELECT factor_name, count(*), avg(factor_value), stddev_samp(factor_value) FROM tool_factors f JOIN (SELECT date AS d, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM tool_factors WHERE get_higher_order_report.report_date IS NULL OR date <= get_higher_order_report.report_date)) ON d = f.date WHERE k <= {_PERIOD.format('get_higher_order_report')} GROUP BY factor_name", "factors over a week, month or quarter of trading days", "knowledge")
sql_tool("run_stress_test", "ticker STRING", "scenario STRING, period_return DOUBLE, max_drawdown DOUBLE", "stress", "SELECT scenario, period_return, max_drawdown FROM tool_stress s WHERE s.ticker = run_stress_test.ticker", "an instrument through bad times", "risk")
sql_tool("run_decay_detection", "ticker STRING", "weak BOOLEAN, low_ic BOOLEAN, flipped BOOLEAN, fading BOOLEAN, level STRING", "decay", "SELECT weak, low_ic, flipped, fading, level FROM tool_decay d WHERE d.ticker = run_decay_detection.ticker", "whether an instrument's signal fades", "risk")
sql_tool("get_risk_report", "ticker STRING", "part STRING, item STRING, value STRING", "stress decay", "SELECT 'stress', scenario, CAST(max_drawdown AS STRING) FROM tool_stress s WHERE s.ticker = get_risk_report.ticker UNION ALL SELECT 'decay', 'level', level FROM tool_decay d WHERE d.ticker = get_risk_report.ticker", "stress and decay of an instrument", "risk")
sql_tool("list_strategies", "", "strategy STRING", "strategies", "SELECT DISTINCT strategy FROM tool_strategies", "strategies", "strategy")
sql_tool("get_strategy_config", "strategy_name STRING", "name STRING, value STRING", "strategies", "SELECT name, value FROM tool_strategies WHERE strategy = get_strategy_config.strategy_name", "the settings of a strategy", "strategy")
sql_tool("compare_backtest_runs", "most INT DEFAULT 5", "run_id BIGINT, strategy STRING, created DATE, sharpe DOUBLE, max_drawdown DOUBLE", "runs", "SELECT run_id, strategy, created, sharpe, max_drawdown FROM (SELECT *, row_number() OVER (ORDER BY created DESC, run_id DESC) AS k FROM tool_runs) WHERE k <= compare_backtest_runs.most", "the newest backtests", "strategy")
sql_tool("run_health_check", "", "item STRING, status STRING", "health", "SELECT item, status FROM tool_health", "coverage, factors and freshness", "ops")
sql_tool("get_market_regime", "days INT DEFAULT 60", "total_return DOUBLE, volatility DOUBLE, regime STRING", "index",
    f"SELECT r, v, CASE WHEN v > 0.4 THEN 'extreme_volatility' WHEN abs(r) > 0.05 THEN 'trend' ELSE 'oscillating' END FROM (SELECT max_by(close, date) / min_by(close, date) - 1 AS r, stddev_samp(c) * sqrt(252) AS v FROM (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS c, {_NEWEST} AS k FROM tool_index) WHERE k <= get_market_regime.days)", "regime of the index over the last days", "risk")
sql_tool("review_data_quality", "ticker STRING", "vote STRING", "review", "SELECT data FROM tool_review r WHERE r.ticker = review_data_quality.ticker", "vote of the data agent", "committee")
sql_tool("review_strategy_signals", "ticker STRING", "vote STRING, multiplier DOUBLE, passed BOOLEAN, recommendation STRING", "review validation", "SELECT strategy, multiplier, passed, recommendation FROM tool_review r JOIN tool_validation v ON v.ticker = r.ticker WHERE r.ticker = review_strategy_signals.ticker", "vote of the strategy agent and checks of its signals", "committee")
sql_tool("review_risk_exposure", "ticker STRING", "vote STRING, risk_flags STRING, risk_level STRING", "review", "SELECT risk, risk_flags, risk_level FROM tool_review r WHERE r.ticker = review_risk_exposure.ticker", "vote of the risk agent", "committee")
sql_tool("review_decision_history", "ticker STRING DEFAULT '', days INT DEFAULT 90", "ticker STRING, n BIGINT, win_rate DOUBLE", "decisions",
    "SELECT d.ticker, count(return_5d), avg(CAST(return_5d > 0 AS INT)) FROM tool_decisions d WHERE (review_decision_history.ticker = '' OR d.ticker = review_decision_history.ticker) AND decision_date > date_sub((SELECT max(decision_date) FROM tool_decisions), review_decision_history.days) GROUP BY d.ticker", "win rate of the decisions of the last days", "committee")
sql_tool("compute_committee_consensus", "ticker STRING", "action STRING, sure DOUBLE, human_review BOOLEAN", "review", "SELECT action, sure, human_review FROM tool_review r WHERE r.ticker = compute_committee_consensus.ticker", "what the committee agrees on", "committee")


@tool("run_backtest", "a strategy over one instrument or all, between two days", "strategy")
def _backtest(spark, sf_dir, *, strategy: str = "momentum", ticker: str | None = None, start_date: datetime.date | None = None, end_date: datetime.date | None = None, dry_run: bool = False, fees: float = 0.001, slippage: float = 0.001):
    """With dry_run only the bars and entries that it would run over."""
    from marlstone.operators import backtest as bt
    from marlstone.operators import strategies
    from marlstone.plans.factors import panel
    from marlstone.plans.reports import where_all

    own = panel(spark, sf_dir, ["momentum_20d", "momentum_5d", "reversal_20d"])
    own = strategies.signals(where_all(own, ticker=None if ticker is None else resolve_ticker(ticker), start=start_date, end=end_date), strategy)
    if dry_run:
        return own.groupBy("ticker").agg(F.count("close").alias("bars"), F.count_if("en").alias("entries"))
    return bt.summarise(bt.equity(own, ["ticker"], fees=fees, slippage=slippage), ["ticker"])


@tool("run_brinson_attribution", "allocation, selection and interaction by sector", "risk")
def _brinson(spark, sf_dir, *, portfolio_weights: dict, benchmark_weights: dict, portfolio_returns: dict, benchmark_returns: dict):
    from marlstone.operators.backtest import brinson

    side = lambda weights, returns: spark.createDataFrame([(s, float(w), float(returns.get(s, 0.0))) for s, w in weights.items()], "sector string, weight double, ret double")
    return brinson(side(portfolio_weights, portfolio_returns), side(benchmark_weights, benchmark_returns))


@tool("run_daily_research", "write the day's report", "research", read_only=False)
def _research(spark, sf_dir, *, path: str, dry_run: bool = False):
    report = registry.queries()["daily_report"](spark, sf_dir)
    if not dry_run:
        report.coalesce(1).write.mode("overwrite").text(path)
    return report


@tool("generate_higher_order_report", "write the report of a period", "knowledge", read_only=False)
def _higher(spark, sf_dir, *, path: str, report_type: str = "weekly", report_date: datetime.date | None = None, dry_run: bool = False):
    more = {} if report_date is None else {"report_date": report_date}
    report = call("get_higher_order_report", spark, sf_dir, report_type=report_type, **more)
    if not dry_run:
        report.write.mode("overwrite").parquet(path)
    return report


@tool("update_data", "replace the stored bars of some instruments", read_only=False)
def _update(spark, sf_dir, *, path: str, tickers: list[str] | None = None, start_date: datetime.date | None = None, dry_run: bool = False):
    from marlstone.plans.reports import where_all
    from marlstone.plans.views import bars
    from marlstone.sources.sinks import replace_partitions

    own = where_all(bars(spark, sf_dir), ticker=tickers, start=start_date)
    if not dry_run:
        replace_partitions(own, path, "ticker")
    return own.groupBy("ticker").agg(F.count("*").alias("n_rows"))


@tool("update_data_incremental", "append the bars past each instrument's newest stored day", read_only=False)
def _append(spark, sf_dir, *, path: str, tickers: list[str] | None = None, target_date: datetime.date | None = None, dry_run: bool = False):
    """One row: rows_added, keys_updated, keys_skipped. A dry run says what would be added and writes nothing."""
    from marlstone.plans.reports import where_all
    from marlstone.plans.views import bars
    from marlstone.sources.loads import Ledger, load_batch, past_marks

    own = where_all(bars(spark, sf_dir), ticker=tickers)
    ledger = Ledger(spark, path)
    if dry_run:
        n, updated = past_marks(own, ledger.marks(), target=target_date).agg(F.count("*"), F.count_distinct("ticker")).first()
        info = {"rows_added": n, "keys_updated": updated, "keys_skipped": own.agg(F.count_distinct("ticker")).first()[0] - updated}
    else:
        info = load_batch(own, max([-1, *ledger.batches()]) + 1, path, target=target_date)
    return spark.createDataFrame([tuple(info.values())], "rows_added long, keys_updated long, keys_skipped long")


@tool("update_financials", "replace the stored reports", read_only=False)
def _statements(spark, sf_dir, *, path: str, ticker: str | None = None, dry_run: bool = False):
    from marlstone.plans.views import fundamentals
    from marlstone.sources.sinks import replace_partitions

    own = fundamentals(spark, sf_dir)
    own = own if ticker is None else own.where(F.col("ticker") == resolve_ticker(ticker))
    if not dry_run:
        replace_partitions(own, path, "ticker")
    return own.groupBy("ticker").agg(F.count("*").alias("n_rows"))
