"""Closed-form cases and edge frames."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from marlstone.functions import rolling
from marlstone.operators import align, backtest, clean, evaluate, factors, text
from marlstone.sources import readers, sinks
from marlstone.streaming import flows

from .conftest import SF

D = datetime.date(2026, 1, 1)


def series(spark, values, **more):
    rows = [("A", D + datetime.timedelta(i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_ewm_equals_pandas(spark):
    values = [100 + (i * 37 % 17) for i in range(700)]
    got = rolling.ewm(series(spark, [float(v) for v in values]), "close", 9, "e").orderBy("date").toPandas().e
    want = pd.Series(values, dtype=float).ewm(span=9).mean()
    assert (got - want).abs().max() < 1e-9


def test_rolling_skew_and_kurt_equal_pandas(spark):
    values = [float(i * i % 23) for i in range(60)]
    w = rolling.series()
    got = series(spark, values).select("date", rolling.skew("close", 20, w).alias("s"), rolling.kurt("close", 20, w).alias("k")).orderBy("date").toPandas()
    r = pd.Series(values).rolling(20)
    assert (got.s - r.skew()).abs().max() < 1e-9 and (got.k - r.kurt()).abs().max() < 1e-9
    assert got.s.isna().sum() == 19


def test_constant_series_has_no_correlation(spark):
    w = rolling.series()
    got = series(spark, [5.0] * 30).select(rolling.corr("close", "close", 20, w).alias("c")).toPandas().c
    assert got.isna().all()


def test_factor_overrides_reach_every_prefix(spark):
    b = series(spark, [float(i + 1) for i in range(30)]).withColumns({c: F.col("close") for c in ("open", "high", "low", "volume")})
    got = factors.compute(b, ["momentum_5d", "momentum_20d", "roe"], {"momentum": {"lookback": 2}, "roe": {"wrong": 1}}).orderBy("date").toPandas()
    assert (got.momentum_5d.dropna() == got.momentum_20d.dropna()).all() and got.momentum_5d.isna().sum() == 2 and got.roe.isna().all()


def test_empty_bars(spark):
    b = spark.createDataFrame([], "ticker string, date date, open double, high double, low double, close double, volume double")
    assert factors.compute(b).count() == 0


def test_asof_falls_back_by_column(spark):
    left = series(spark, [1.0] * 4).drop("close")
    fin = spark.createDataFrame([("A", D, 1.0, 2.0), ("A", D + datetime.timedelta(2), None, 5.0)], "ticker string, report_date date, x double, y double")
    got = align.asof_join(left, fin, ["x", "y"]).orderBy("date").toPandas()
    assert got.x.tolist() == [1.0] * 4 and got.y.tolist() == [2.0, 2.0, 5.0, 5.0]


def test_clean_ohlcv_repairs(spark):
    rows = [("A", D, 1.0, 2.0, 3.0, 1.0, -5.0), ("A", D, 1.0, 2.0, 3.0, 1.0, -5.0), ("B", D, -1.0, 3.0, 2.0, None, 1.0)]
    got = clean.clean_ohlcv(spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")).collect()
    assert len(got) == 1 and got[0].high is None and got[0].low is None and got[0].volume == 0


def test_backtest_fold(spark):
    rows = [("A", D + datetime.timedelta(i), p, en, ex) for i, (p, en, ex) in enumerate([(10.0, True, False), (12.0, False, False), (11.0, False, True), (9.0, False, False)])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, en boolean, ex boolean")
    got = backtest.equity(df, ["ticker"], cash=1000.0).orderBy("date").collect()  # a row a bar
    shares = int(1000 / (10 * 1.001 * 1.001))
    cash = 1000 - shares * 10 * 1.001 * 1.001
    end = cash + shares * 11 * 0.999 * 0.999
    assert [round(r.v, 6) for r in got] == [round(v, 6) for v in (cash + shares * 10, cash + shares * 12, end, end)]
    done = backtest.summarise(backtest.equity(df, ["ticker"], cash=1000.0), ["ticker"], 1000.0).collect()[0]
    assert done.trade_count == 1 and done.win_rate == 1.0


def test_realism_limits(spark):
    rows = [("A", D + datetime.timedelta(i), c, v, True, True) for i, (c, v) in enumerate([(10.0, 1.0), (11.0, 1.0), (9.9, 1.0), (9.9, 0.0)])]
    got = backtest.realism(spark.createDataFrame(rows, "ticker string, date date, close double, volume double, en boolean, ex boolean")).orderBy("date").collect()
    assert [r.en for r in got] == [True, False, True, False] and [r.ex for r in got] == [True, True, False, False]


def test_collinear_chain(spark):
    m = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("c", "d", 0.1), ("a", "a", 1.0)], "factor_a string, factor_b string, corr double")
    got = {r.factor: r.grp for r in evaluate.collinear_groups(m, list("abcd")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}


def test_similar_titles_are_greedy(spark):
    base = "one two three four five six seven eight nine ten"
    titles = [base, base.replace("ten", "x"), base.replace("ten", "x").replace("nine", "y"), "", "", "else"]
    got = sorted(r.id for r in text.dedup_similar(spark.createDataFrame(list(enumerate(titles)), "id long, title string")).collect())
    kept = []
    sets = [set(t.split()) for t in titles]
    for i, s in enumerate(sets):
        if not any(s and len(s & sets[k]) / len(s | sets[k]) >= 0.8 for k in kept):
            kept.append(i)
    assert got == kept


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.append_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    path = str(tmp_path / "t")
    sinks.replace_partitions(old, path, "k")
    sinks.replace_partitions(new, path, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_markdown(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Growth\ntype: note\ntags: [x, y]\n---\nBody\n")
    got = readers.markdown(spark, str(tmp_path)).collect()[0]
    assert (got.title, got.type, got.tags, got.body.strip()) == ("Growth", "note", ["x", "y"], "Body")


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = flows.read_events(spark, str(tmp_path / "in"), events.schema, files=10)
    got = flows.run_once(flows.tumbling(stream), "t_tumbling", "complete").select("start", "event_type", "n")
    want = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().select("w.start", "event_type", "count")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    users = flows.run_once(flows.active_users(stream), "t_users", "complete")
    assert users.count() > 0
    switched = flows.run_once(flows.cooldown(stream), "t_switched")
    assert switched.select("user_id").distinct().count() == events.select("user_id").distinct().count()
