"""What has no SQL twin, against plain loops; sinks, sources, adapters, tools and streams."""

import datetime
import json
import math
import os
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone import registry, tools
from marlstone.functions.safe import conform
from marlstone.operators import backtest, broker, committee, knowledge, regime, risk, strategies, text
from marlstone.plans import library
from marlstone.sources import adapters, readers, sinks

from .conftest import SF

DAY = datetime.date


def test_paper_fills_replayed(spark):
    orders = [r for r in library.paper_orders(spark, SF).collect()]
    want = {}
    for account, own in _by(orders, lambda r: r.account).items():
        cash, held = 1_000_000.0, {}
        for o in sorted(own, key=lambda r: r.seq):
            buys = o.side == "buy"
            px = math.floor(o.price * (1.001 if buys else 0.999) * 1000 + 0.5) / 1000
            q, cost = held.get(o.ticker, (0, 0.0))
            n = o.quantity
            fee = lambda k: max(k * px * 0.0003, 5.0)  # noqa: E731, B023
            if buys and n * px + fee(n) > cash:
                n = int(cash / (px * 1.0003) / 100) * 100
            if n <= 0 or not buys and q < n:
                want[account, o.seq] = ("rejected", 0, round(cash, 2), q)
                continue
            if buys:
                cash -= n * px + fee(n)
                held[o.ticker] = (q + n, (cost * q + n * px) / (q + n))
            else:
                cash += n * px - fee(n) - n * px * 0.001
                held[o.ticker] = (q - n, cost if q > n else 0.0)
            want[account, o.seq] = ("filled", n, round(cash, 2), held[o.ticker][0])
    rows = broker.fill(library.paper_orders(spark, SF)).collect()
    assert {(r.account, r.seq) for r in rows} == set(want)
    for r in rows:
        status, n, cash, q = want[r.account, r.seq]
        assert (r.status, r.quantity, r.held) == (status, n, q) and abs(r.cash - cash) < 0.02


def _by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def test_partial_sales_keep_the_mean_cost(spark):
    rows = [(1, 1, "T", "buy", 100, 10.0), (1, 2, "T", "sell", 200, 10.0), (1, 3, "T", "sell", 0, 10.0), (1, 4, "T", "buy", 100, 20.0), (1, 5, "U", "buy", 100, None)]
    f = broker.fill(spark.createDataFrame(rows, "account long, seq long, ticker string, side string, quantity long, price double"), slippage=0.0).orderBy("seq").collect()
    assert [r.status for r in f] == ["filled", "rejected", "rejected", "filled", "rejected"] and abs(f[3].avg_cost - 15.0) < 1e-9


def test_regimes_settle(spark):
    rows = [("a", DAY(2024, 1, d), r, c) for d, r, c in ((1, "x", 0.9), (2, "y", 0.9), (3, "y", 0.1), (4, "y", 0.9), (8, "y", 0.9), (9, "x", 0.9))]
    out = strategies.settle(spark.createDataFrame(rows, "key string, day date, regime string, confidence double"), {"x": ("momentum", 0.8)}).orderBy("day").collect()
    assert [(r.day.day, r.regime, r.strategy, r.weight) for r in out] == [(1, "x", "momentum", 0.8), (2, "x", "momentum", 0.8), (4, "x", "momentum", 0.8), (8, "y", None, 0.0), (9, "y", None, 0.0)]


def test_similar_titles_like_a_loop(spark):
    rows = [(r.id, r.title) for r in spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title")).collect()]
    rows += [(10_000, rows[0][1]), (10_001, rows[0][1].upper()), (10_002, ""), (10_003, "..."), (10_004, None), (10_005, "one two three four five"), (10_006, "one two three four"), (10_007, "one two three"), (10_008, "two three four five one")]
    words = lambda t: {w for w in re.sub(r"[^\w\s]", "", (t or "").lower()).split() if w}
    kept, sets = [], []
    for i, t in sorted(rows):
        w = words(t)
        if w and any(len(w & s) / len(w | s) >= 0.8 for s in sets):
            continue
        kept.append(i)
        if w:
            sets.append(w)
    got = text.dedup_similar(spark.createDataFrame(rows, "id long, title string"))
    assert sorted(r.id for r in got.collect()) == kept


def test_chain_of_similar_titles_keeps_plans_small(spark):
    chain = [(i, " ".join(f"w{k}" for k in range(i, i + 10))) for i in range(16)]  # neighbours share 9 of 11 words, others less
    got = text.dedup_similar(spark.createDataFrame(chain, "id long, title string"))
    short = text.dedup_similar(spark.createDataFrame(chain[:4], "id long, title string"))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().treeString().splitlines())
    assert sorted(r.id for r in got.collect()) == list(range(0, 16, 2))
    assert size(got) == size(short)


def test_losses_of_all_and_more_compound(spark):
    rows = [(DAY(2024, 1, d + 1), r) for d, r in enumerate((0.1, -1.5, 0.1, None, -2.0, 0.5, -1.0, 0.3))]
    got = [r.equity for r in backtest.compound(spark.createDataFrame(rows, "date date, r double")).orderBy("date").collect()]
    want, e = [], 1.0
    for _, r in rows:
        e *= 1 + (r or 0.0)
        want.append(e)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)) and got[-1] == 0.0


def test_orders_and_breakers(spark):
    none = spark.createDataFrame([], "ticker string, target_weight double")
    held = spark.createDataFrame([("A", 0.15, "S"), ("B", 0.1, "S")], "ticker string, weight double, sector string")
    assert risk.order_violations(none, held).collect()[0].rule == "sector_exposure"
    orders = spark.createDataFrame([("A", -0.04), ("C", None), ("D", 0.01)], "ticker string, target_weight double")
    got = {(r.rule, r.ticker) for r in risk.order_violations(orders, held, blacklist=["D"]).collect()}
    assert got == {("sector_exposure", "S"), ("blacklist", "D")} and not risk.passed(risk.order_violations(orders, held, blacklist=["D"])).first().passed
    curve = spark.createDataFrame([(DAY(2024, 1, 1), 100.0), (DAY(2024, 1, 2), 97.0), (DAY(2024, 1, 3), 94.0), (DAY(2024, 1, 4), 99.0)], "date date, equity double")
    assert [(r.drawdown_stop, r.daily_stop) for r in risk.breakers(curve).orderBy("date").collect()] == [(False, False), (False, True), (True, True), (True, False)]


def test_decay_rules(spark):
    rows = []
    for d in range(30):
        day = DAY(2024, 1, 1) + datetime.timedelta(days=d)
        rows += [("low", day, 0.01, 0.5, 1.0, 0.01), ("flip", day, 0.01, 0.5, 1.0, 0.8 - 0.05 * d), ("fade", day, 0.02 if d < 25 else 0.001, 0.5, 1.0, 0.3), ("weak", day, 0.01, 0.1, -1.0, 0.3), ("few", day, 0.01, None, None, None)]
    got = {r.ticker: r for r in risk.decay(spark.createDataFrame(rows, "ticker string, date date, r double, win_rate double, sharpe double, ic double")).collect()}
    assert {t: r.level for t, r in got.items()} == {"low": "warning", "flip": "critical", "fade": "warning", "weak": "critical", "few": "ok"}
    assert got["low"].low_ic and got["flip"].flipped and got["fade"].fading and got["weak"].weak


def test_calendar_regimes(spark):
    days = {DAY(2024, 3, 5): "earnings_season", DAY(2024, 8, 31): "earnings_season", DAY(2024, 12, 12): "policy_window", DAY(2024, 11, 20): "policy_window", DAY(2024, 10, 1): None}
    for day, want in days.items():
        got = spark.range(1).select(regime.calendar_regime(F.lit(day)).alias("r")).first().r
        assert (got.regime if got else None) == want


def test_committee_without_anything(spark):
    rows = [("T", None, None, None, None, 0, None, None, None, None, None, None, None, None, None)]
    schema = "ticker string, regime string, pct_change double, momenta array<double>, rsis array<double>, n_factors int, n_news long, n_positive long, n_negative long, wiki_score double, n_facts long, weights array<double>, drawdown double, n_decisions long, n_correct long"
    r = committee.consensus(committee.votes(committee.fuse(spark.createDataFrame(rows, schema)))).first()
    assert (r.direction, r.strength, [v.action for v in r.votes]) == ("neutral", "weak", ["caution", "hold", "bullish", "hold"])
    assert r.risk_flags == ["no_factors", "no_price"]


def test_signal_registry():
    with pytest.raises(ValueError):
        strategies.register("momentum", "", "")(lambda: None)
    assert set(strategies.REGISTRY) == {"momentum", "reversal", "sentiment", "regime_switch"}


def test_quarters_in_texts(spark):
    texts = {"in 2024Q3": "2024Q3", "Q2 2025 was": "2025Q2", "the Third Quarter of 2023": "2023Q3", "2024-q1": "2024Q1", "Q5 2024": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", knowledge.quarter_of(F.col("t")).alias("q")).collect()
    assert {r.t: r.q for r in rows} == texts


def test_sinks(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    bars = spark.createDataFrame([("A", DAY(2024, 1, 1), 1.0), ("B", DAY(2024, 1, 1), 2.0)], "ticker string, date date, close double")
    for _ in range(2):
        sinks.save_both(bars, at("clean"), at("raw"), datetime.datetime(2024, 1, 2), "ticker")
    assert spark.read.parquet(at("clean")).count() == 2 and spark.read.parquet(at("raw")).count() == 4
    runs = spark.createDataFrame([(1, {"k": "v"}, [(DAY(2024, 1, 1), 1.0), (DAY(2024, 1, 2), 1.1)])], "run_id long, params map<string,string>, curve array<struct<date:date,equity:double>>")
    sinks.save_run(runs, at("runs"))
    assert json.loads(spark.read.parquet(at("runs/runs")).first().params) == {"k": "v"} and spark.read.parquet(at("runs/equity")).count() == 2
    assert sinks.fill_if_empty(bars, at("copy")) and not sinks.fill_if_empty(bars, at("copy"))
    spark.createDataFrame([(1, "draft"), (2, "obsolete")], "id long, status string").write.json(at("h"))
    errors = sinks.rewrite_status(spark, at("h"), "id long, status string", spark.createDataFrame([(1, "active"), (2, "active"), (3, "active")], "id long, new_status string"), knowledge.HYPOTHESIS, at("h2"))
    assert {(r.id, r.error) for r in errors.collect()} == {(2, "not_allowed"), (3, "unknown")}
    assert {(r.id, r.status) for r in spark.read.json(at("h2")).collect()} == {(1, "active"), (2, "obsolete")}
    names = [sinks.period_name(k, DAY(2024, 12, 30)) for k in ("daily", "weekly", "monthly", "quarterly", "yearly")]
    assert names == ["2024-12-30.md", "2025-W01.md", "2024-12.md", "2024-Q4.md", "2024.md"]
    path = sinks.save_report(spark.createDataFrame([("# Title\nbody",)], "report string"), at("reports"), "daily", DAY(2024, 1, 2))
    assert spark.read.text(path, wholetext=True).first().value.strip() == "# Title\nbody"
    sinks.save_csv(bars, at("csv"))
    sinks.save_json(bars, at("json"))
    assert spark.read.option("header", True).csv(at("csv")).count() == spark.read.json(at("json")).count() == 2
    for day in (DAY(2024, 1, 1), DAY(2024, 2, 20)):
        gone = sinks.export(spark, {"bars": bars}, at("backup"), day)
    assert gone == ["2024-01-01"] and os.listdir(f"{tmp_path}/backup") == ["2024-02-20"]
    sinks.refresh_calendar(bars.select(F.col("date").alias("trade_date")), at("cal"))
    assert spark.read.parquet(at("cal")).count() == 1
    alerts = spark.createDataFrame([(1, "critical", False), (2, "info", False)], "alert_id long, level string, acknowledged boolean")
    assert {(r.alert_id, r.channel) for r in sinks.fan_out(alerts, {"mail": "warning", "log": "info"}).collect()} == {(1, "mail"), (1, "log"), (2, "log")}
    seen = sinks.acknowledge(alerts, spark.createDataFrame([(1,), (9,)], "alert_id long"))
    assert {r.alert_id: r.acknowledged for r in seen.collect()} == {1: True, 2: False}
    facts = spark.createDataFrame([(1, False), (2, False)], "fact_id long, verified boolean")
    ids = spark.createDataFrame([(2,)], "fact_id long")
    assert sinks.verify(facts, ids).where("verified").count() == 1 and sinks.delete(facts, ids, "fact_id").first().fact_id == 1
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    new = spark.createDataFrame([(2, 5.0), (3, 9.0)], "k long, v double")
    assert {r.k: r.v for r in sinks.update_values(old, new, ["k"], "v").collect()} == {1: 1.0, 2: 5.0}
    assert {r.k: r.v for r in sinks.append_new(old, new, ["k"]).collect()} == {1: 1.0, 2: 2.0, 3: 9.0}
    assert sinks.newer_than(bars, DAY(2024, 1, 1)).count() == 0 and sinks.newer_than(bars, None).count() == 2
    assert sinks.keep_recent(bars, DAY(2024, 1, 10), 5).count() == 0


def test_readers(spark, tmp_path):
    at = f"file://{tmp_path}/days"
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-03")], "name string, day string")
    sinks.append_json(df, at)
    (tmp_path / "days" / "day=2024-01-02" / "more.json").write_text("not json\n")  # a file of its own, as others have checksums
    got = readers.json_days(spark, at, "name string, day date", DAY(2024, 1, 2))
    assert sorted(r.name for r in got.collect()) == ["b", "c"]
    a = spark.createDataFrame([("A", 1.0)], "ticker string, close double")
    b = spark.createDataFrame([("A", 9.0), ("B", 2.0)], "ticker string, close double")
    assert {r.ticker: r.close for r in readers.first_available(a, b).collect()} == {"A": 1.0, "B": 2.0}


def test_adapters(spark, tmp_path):
    known = adapters.Adapters()
    bars = spark.createDataFrame([("A", DAY(2024, 1, 1)), ("B", DAY(2024, 1, 2))], "ticker string, date date")
    known.register("data", "tables", adapters.TableAdapter(lambda s: bars))
    assert isinstance(known.get("data"), adapters.DataAdapter) and known.names("data") == ["tables"]
    assert known.get("data", "tables").bars(spark, ["A", "B"], start=DAY(2024, 1, 2)).count() == 1
    with pytest.raises(ValueError):
        known.register("data", "tables", None)
    with pytest.raises(KeyError):
        known.get("agent")
    loads = []

    def load():
        loads.append(1)
        return bars

    at = f"file://{tmp_path}/boards"
    now = datetime.datetime.now().timestamp()
    for moment in (now, now + 60, now + 100_000):
        assert adapters.cached_dimension(spark, at, load, moment).count() == 2
    assert len(loads) == 2
    assert adapters.scan_view(bars, "own_bars", "SELECT count(*) AS n FROM own_bars").first().n == 2
    text_ = "risk:\n  single: 0.05  \n  # note\nname: 'x'\nnested:\n  deep:\n    value: 3\n"
    assert adapters.settings(text_, {"MARLSTONE_RISK__SINGLE": "0.1", "OTHER": "1"}) == {"risk.single": 0.1, "name": "x", "nested.deep.value": 3}
    more = "a: [1, two, 0.5]  # comment\nb:\n  - x # y\n  - 7\nc: 'no # comment'\nd: true\ne: ~\nf: # nothing\n  g: http://a#b"
    assert adapters.settings(more, {}) == {"a": [1, "two", 0.5], "b": ["x", 7], "c": "no # comment", "d": True, "e": None, "f.g": "http://a#b"}


def test_tools(spark, tmp_path):
    assert len(tools.TOOLS) == 48 and tools.listing(spark).count() == 48
    assert tools.resolve_ticker(" 12.sz ") == "000012" and tools.resolve_ticker("Brand#12") == "Brand#12"
    assert tools.call("get_quote", spark, SF, ticker="Brand#12").count() == 1
    assert tools.call("get_history", spark, SF, ticker="Brand#12", days=7).count() == 7
    assert [r.ticker for r in tools.call("search_tickers", spark, SF, query="brand#1").orderBy("ticker").collect()][:3] == ["Brand#1", "Brand#10", "Brand#11"]
    assert {r.sector_name for r in tools.call("get_sector_stocks", spark, SF, sector_name="nation_1").collect()} <= {"NATION_1"}
    day = DAY(1998, 1, 1)
    whole = tools.call("run_backtest", spark, SF, strategy="reversal", ticker="Brand#12")
    assert whole.count() == 1 and whole.collect() != tools.call("run_backtest", spark, SF, strategy="reversal", ticker="Brand#12", start_date=day).collect()
    assert tools.call("run_backtest", spark, SF, ticker="Brand#12", end_date=day, dry_run=True).first().bars > 0
    at = f"file://{tmp_path}/bars"
    step = lambda **how: tools.call("update_data_incremental", spark, SF, path=at, **how).first()
    planned = step(target_date=day, dry_run=True)
    assert step(target_date=day) == planned and planned.rows_added > 0
    assert step(target_date=day).rows_added == 0 and step().rows_added > 0 and step().keys_updated == 0
    sums = tools.call("run_brinson_attribution", spark, SF, portfolio_weights={"a": 0.6, "b": 0.4}, benchmark_weights={"a": 0.5, "b": 0.5}, portfolio_returns={"a": 0.1, "b": 0.0}, benchmark_returns={"a": 0.05, "b": 0.01})
    assert {r.sector for r in sums.collect()} == {"a", "b"}
    with pytest.raises(KeyError):
        tools.call("none", spark, SF)
    names = {t.name for t in tools.TOOLS.values()}
    assert {"get_market_regime", "compute_committee_consensus", "get_factor_collinearity", "run_stress_test"} <= names
    for bad in ({"word": "x"}, {"query": "x", "most": 3}):
        with pytest.raises(Exception):
            tools.call("search_tickers", spark, SF, **bad)
    with pytest.raises(TypeError):
        tools.call("run_backtest", spark, SF, begin=day)


#: Parameters of a call of each table function that has any without a default.
CALLS = {"ticker": "Brand#12", "query": "the thatnd in heed", "sector_name": "NATION_3", "strategy_name": "momentum"}


def test_every_table_function(spark):
    """Each is called with its own parameters from SQL and gives its own columns."""
    tools.register(spark, SF)
    seen = {}
    for t in tools.TOOLS.values():
        if t.run:
            continue
        needed = [p.split()[0] for p in t.parameters.split(", ") if p and "DEFAULT" not in p]
        df = spark.sql(f"SELECT * FROM {t.name}({', '.join(f'{p} => :{p}' for p in needed)})", args={p: "brand" if t.name == "search_tickers" else CALLS[p] for p in needed})
        seen[t.name] = df
        assert df.columns == [c.split()[0] for c in t.columns.split(", ")], t.name
        assert t.name in ("get_daily_report", "search_hypotheses") or not df.isEmpty(), t.name
    closes = [r.close for r in seen["get_history"].orderBy("date").collect()]
    assert len(closes) == 60 and seen["get_quote"].first().close == closes[-1]
    assert spark.sql("SELECT * FROM get_factor_collinearity(threshold => 0.999, days => 4000)").count() < spark.sql("SELECT * FROM get_factor_collinearity(0.3, days => 4000)").count()
    assert spark.sql("SELECT * FROM get_financials('Brand#12', report_type => 'ratio')").select("item").distinct().count() == 2
    best = knowledge.score_entries(library.entries(spark, SF), "the thatnd in heed", k=3).collect()
    assert [(r.id, round(r.score, 9)) for r in spark.sql("SELECT * FROM wiki_search('the thatnd in heed') ORDER BY score DESC, id").collect()] == [(r.id, round(r.score, 9)) for r in best]
    plan = spark.sql("SELECT * FROM get_quote('Brand#12')")._jdf.queryExecution().optimizedPlan().toString()
    assert "Brand#12" in plan


def test_news_of_an_adapter(spark):
    rows = [(1, "a", ["A"], DAY(2024, 1, 1)), (2, "b", ["B", "A"], DAY(2024, 1, 3)), (3, "c", None, DAY(2024, 1, 4))]
    news = adapters.TableAdapter(None, lambda s: s.createDataFrame(rows, "id long, title string, tickers array<string>, published date"))
    assert [r.id for r in news.news(spark, ["A"]).collect()] == [2, 1] and [r.id for r in news.news(spark, [], 1).collect()] == [3]


def test_search_by_index_like_a_scan(spark, tmp_path):
    """The index gives what scoring every entry gives, and reads only the words' buckets and the blocks that can matter."""
    import random

    from marlstone.operators import retrieval

    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    pick = lambda n: [rng.choice(words) if rng.random() < 0.6 else f"rare{rng.randrange(3000)}" for _ in range(n)]
    rows = [(k, " ".join(pick(4)), pick(2), pick(1) if k % 3 else None, " ".join(pick(30)), "scenario" if k % 2 else "entity", rng.sample(["trend", "Extreme Trend", "oscillating"], 1) if k % 5 else None, ["daily"] if k % 4 else ["all"]) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, title string, keywords array<string>, tags array<string>, content string, type string, market_regime array<string>, timeframe array<string>").cache()
    path = f"file://{tmp_path}/index"
    retrieval.build_index(df, path, buckets=16, block=20)
    queries = [("w1 w2 w3", "trend", "daily", "scenario"), ("w1", None, None, None), ("rare7 rare8", None, None, "entity"), ("nothing here at all", None, None, None), ("", "trend", None, "scenario"), ("W5 w5 w6", None, "daily", None), ("", None, None, None)]
    for q, regime_, timeframe, kind in queries:
        want = [(r.id, round(r.score, 12)) for r in knowledge.score_entries(df, q, regime_, timeframe, kind).collect()]
        got = [(r.id, round(r.score, 12)) for r in retrieval.search(spark, path, q, regime_, timeframe, kind, buckets=16).collect()]
        assert got == want, q
    stored = retrieval._stored(spark, path, "postings", ["w1", "w2"], 16)
    assert "bucket" in stored._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_batches_are_run_and_saved(spark, tmp_path):
    from marlstone.plans.factors import panel

    own = panel(spark, SF, ["momentum_20d", "momentum_5d", "reversal_20d"]).where("ticker in ('Brand#11', 'Brand#12')")
    short = own.where("ticker = 'Brand#11'").limit(20).withColumn("ticker", F.lit("short"))
    b = backtest.batch(own.unionByName(short), ["momentum", "reversal"])
    rows = {(r.strategy, r.ticker): r for r in b.collect()}
    assert rows["momentum", "short"].outcome == "too_short" and rows["momentum", "short"].total_return is None
    assert all(r.trade_count is not None for r in rows.values() if r.outcome == "run") and any(r.outcome == "run" for r in rows.values())
    runs = b.where("outcome = 'run'").select(F.concat_ws("_", "strategy", "ticker").alias("run_id"), F.create_map(F.lit("strategy"), "strategy").alias("params"), F.array().cast("array<struct<date:date,equity:double>>").alias("curve"), "total_return")
    sinks.save_run(runs, f"file://{tmp_path}/runs")
    assert spark.read.parquet(f"file://{tmp_path}/runs/runs").count() == runs.count()


def test_conform(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(1, "2")], "a int, b string")
    out = conform(df, T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.DoubleType())]))
    assert out.columns == ["b", "c"] and out.first() == (2, None)


def test_cooldown_over_batches(spark, tmp_path):
    """Events that arrive in several files, in any order within one, against a loop."""
    from marlstone.streaming import flows

    base = datetime.datetime(2024, 1, 1)
    rows = []
    for user in (1, 2):
        for d, kind in ((0, "a"), (1, "b"), (6, "b"), (7, "a"), (12, "a"), (13, "b")):
            rows.append((user, base + datetime.timedelta(days=d, hours=user), kind))
    for k, part in enumerate((rows[3::-1] + rows[6:9], rows[4:6] + rows[9:])):
        spark.createDataFrame(part, "user_id long, ts timestamp, event_type string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    src = spark.readStream.schema("user_id long, ts timestamp, event_type string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = flows.run_once(flows.cooldown(src), "cooldowns", checkpoint=f"file://{tmp_path}/check")
    got = sorted((r.user_id, (r.ts - base).days, r.regime) for r in out.collect())
    assert got == sorted((u, d, k) for u in (1, 2) for d, k in ((0, "a"), (6, "b"), (12, "a")))


def test_first_batch_and_gate(spark):
    from marlstone.streaming import flows

    empty, full = spark.createDataFrame([], "a int"), spark.createDataFrame([(1,)], "a int")
    assert flows.first_batch([empty, full, empty]).count() == 1 and flows.first_batch([empty]).count() == 0
    cal, ran = spark.createDataFrame([(DAY(2024, 1, 2),)], "trade_date date"), []
    assert flows.on_trading_days(spark, cal, DAY(2024, 1, 2), lambda: ran.append(1)) and not flows.on_trading_days(spark, cal, DAY(2024, 1, 3), lambda: ran.append(1))
    assert ran == [1]


def test_every_query_has_rows(spark):
    """Search terms and conditions that match something; what is empty proves nothing."""
    for name in ("ticker_search", "board_search", "set_difference", "event_filters", "tuple_in", "facts", "lessons", "alerts_open", "order_risk_checks", "paper_positions", "recent_decisions"):
        assert not registry.queries()[name](spark, SF).isEmpty(), name


def test_returns_of_decisions_like_a_loop(spark):
    from marlstone.plans.reports import backfill_returns

    days = [DAY(2024, 1, 1) + datetime.timedelta(d) for d in (0, 1, 4, 5, 9, 11, 12, 13, 30)]
    prices = [(t, d, 10.0 + 3 * k % 7) for t in ("x", "y", None) for k, d in enumerate(days)]
    asked = [(t, DAY(2023, 12, 28) + datetime.timedelta(d)) for t in ("x", "y", "z", None) for d in range(40) for _ in range(2)] + [("x", None)]
    own = [(i, d, t) for i, (t, d) in enumerate(asked)]
    df = backfill_returns(spark.createDataFrame(own, "decision_id long, decision_date date, ticker string"), spark.createDataFrame(prices, "ticker string, date date, close double"))
    want = {}
    for i, d, t in own:
        near = [c for u, b, c in prices if t is not None and d is not None and u == t and d <= b <= d + datetime.timedelta(15)]
        want[i] = (d, t, *[round(near[k] / near[0] - 1, 6) if len(near) > k else None for k in (1, 3, 5, 10)])
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == want
    assert "unboundedfollowing" not in df._jdf.queryExecution().optimizedPlan().toString().lower()  # summed anew for every row


#: Queries on the returns of decisions.
BACKFILLED = ["decision_backfill", "recent_decisions", "daily_report", "decision_accuracy", "pending_decisions", "win_rate_last_n"]


@pytest.mark.parametrize("name", BACKFILLED)
def test_decisions_look_bars_up_in_one_pass(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "windowframe" in plan and "unboundedfollowing" not in plan


def test_backtest_goes_on_beyond_the_largest_double(spark):
    rows = [("x", DAY(2024, 1, d + 1), c, e, x) for d, (c, e, x) in enumerate([(1.0, True, False), (1000.0, False, False), (1.0, False, False), (1000.0, False, True), (1.0, True, False), (1.0, False, True)])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, en boolean, ex boolean")
    got = backtest.summarise(backtest.equity(df, ["ticker"], cash=1e307), ["ticker"], cash=1e307).first()
    assert math.isnan(got.total_return) and got.max_drawdown == -1.0 and (got.trade_count, got.win_rate) == (2, 1.0)


def test_consensus_does_not_hang_on_the_order_of_events(spark, tmp_path):
    import random
    from fractions import Fraction

    from marlstone.plans import trading

    rng, rows, want = random.Random(3), [], {}
    for user in range(150):  # shares of B / 1280, whose seventh decimal is a five and the last
        b = rng.randrange(642, 1280, 4)
        for kind, total in (("purchase", b), ("click", 1280 - b)):
            cuts = sorted(rng.sample(range(1, total), min(12, total - 1)))
            rows += [(user, kind, '{"k": %d}' % (hi - lo)) for lo, hi in zip([0, *cuts], [*cuts, total])]
        want[user] = ("buy", math.floor(Fraction(b, 1280) * 10**6 + Fraction(1, 2)) / 1e6)
    rows += [(150, "view", "{}"), (150, "click", '{"k": 1}')]  # an unknown sum is not the largest
    want[150] = ("sell", 1.0)
    rng.shuffle(rows)
    spark.createDataFrame(rows, "user_id long, event_type string, props string").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    assert {r.user_id: (r.consensus, r.share) for r in trading.committee_consensus(spark, str(tmp_path)).collect()} == want


def _market(spark, path, trades, brands, decided):
    """Tables of trades (order, line, part, price, day), parts' brands and decisions (day, customer)."""
    stamp = lambda d: d and datetime.datetime(d.year, d.month, d.day)
    spark.createDataFrame([(o, p, 1, n, 1.0, c, stamp(d)) for o, n, p, c, d in trades], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").repartition(3).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(list(enumerate(brands)), "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(k, c, stamp(d), f"{k % 3}") for k, (d, c) in enumerate(decided)], "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").repartition(3).write.parquet(f"{path}/orders.parquet")
    return str(path)


def _random_market(spark, path):
    import random

    rng, brands = random.Random(5), ["Brand#1", "Brand#2", "Brand#12", "Brand#2", None]
    trades = [(rng.choice([None, *range(9)]), rng.randrange(2), rng.randrange(5), float(rng.randrange(1, 60)), rng.choice([None, *(DAY(2024, 1, 1) + datetime.timedelta(d) for d in range(40))])) for _ in range(900)]
    decided = [(rng.choice([None, *(DAY(2024, 1, 1) + datetime.timedelta(d) for d in range(45))]), rng.choice([0, 1, 11, 30, None])) for _ in range(400)]
    return _market(spark, path, trades, brands, decided)


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_closes_are_those_of_bars(spark, tmp_path, monkeypatch, sent):
    """Lines of one order in one bar, unknown orders, brands and days; sent to all tasks or shuffled."""
    from marlstone.plans import views

    monkeypatch.setattr(views, "SENT", sent)
    sf = _random_market(spark, tmp_path)
    got, want = views.closes(spark, sf), views.bars(spark, sf).select("ticker", "date", "close")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100


#: Queries that need no more than closes.
OF_CLOSES = ["daily_report", "decision_accuracy", "win_rate_last_n", "pending_decisions"]


@pytest.mark.parametrize("name", OF_CLOSES)
def test_closes_are_made_once_and_without_a_sort_of_trades(spark, name):
    assert "l_extendedprice" not in registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_accuracy_is_that_of_single_decisions(spark, tmp_path):
    from marlstone.plans import reports

    sf, want = _random_market(spark, tmp_path), {}
    for r in reports.decision_backfill(spark, sf).collect():
        for kind in (r.signal_type, None):
            want.setdefault(kind, []).append(r.return_5d)
    got = {r.signal_type: r for r in reports.decision_accuracy(spark, sf).collect()}
    assert got.keys() == want.keys()
    for kind, all_ in want.items():
        done = [x for x in all_ if x is not None]
        wins = sum(x > 0 for x in done)
        assert tuple(got[kind])[1:4] == (len(all_), len(done), wins) and 0 < wins < len(done) < len(all_)
        assert got[kind].accuracy == pytest.approx(wins / len(done), abs=1e-6) and got[kind].avg_return == pytest.approx(sum(done) / len(done), abs=1e-6)
    days = reports.returns_by_day(reports.decisions(spark, sf), reports.closes(spark, sf), "signal_type")
    assert days.select("ticker", "decision_date", "signal_type").distinct().count() == days.count() < 400 == days.agg({"n": "sum"}).first()[0]


def test_win_rate_is_that_of_single_decisions(spark, tmp_path):
    from marlstone.plans import reports

    sf, known = _random_market(spark, tmp_path), {}
    for r in reports.decision_backfill(spark, sf).where("return_5d is not null").collect():
        known.setdefault(r.ticker, []).append((r.decision_date, r.decision_id, r.return_5d > 0))
    want = {t: (round(sum(x[2] for x in sorted(all_)[-20:]) / len(all_[-20:]), 6), len(all_[-20:])) for t, all_ in known.items()}
    df = reports.win_rate_last_n(spark, sf)
    assert {r.ticker: (r.win_rate, r.n) for r in df.collect()} == want and max(map(len, known.values())) > 20
    assert "decision_id" not in df._jdf.queryExecution().optimizedPlan().toString()  # single decisions are not looked up


def test_pending_decisions_are_those_without_returns(spark, tmp_path):
    from marlstone.plans import reports

    sf = _random_market(spark, tmp_path)
    later = reports.decisions(spark, sf).selectExpr("decision_id", "date_add(decision_date, 110) as decision_date", "ticker")
    want = reports.backfill_returns(later, reports.bars(spark, sf)).where("coalesce(return_1d, return_3d, return_5d, return_10d) is null")
    assert {r.decision_id for r in reports.pending_decisions(spark, sf).collect()} == {r.decision_id for r in want.collect()} != set()


def test_recent_decisions_look_up_only_their_days(spark, tmp_path):
    from marlstone.plans import library, reports

    sf = _random_market(spark, tmp_path)
    every = reports.decision_backfill(spark, sf).where("ticker = 'Brand#12'").collect()
    want = sorted(every, key=lambda r: (r.decision_date is not None, r.decision_date or DAY(1, 1, 1), r.decision_id), reverse=True)[:20]
    df = library.recent_decisions(spark, sf)
    assert [tuple(r) for r in df.collect()] == [(r.decision_id, r.ticker, r.decision_date, r.return_5d) for r in want] and len(every) > 20
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "cast(l_shipdate" in plan.split("Filter", 1)[1] and f">= {min(r.decision_date for r in want)}" in plan
