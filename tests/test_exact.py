"""Exact quantiles, blocked covariances, streaming folds, expressions and sketches against plain computations."""

import datetime
import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import expressions
from marlstone.operators import backtest, clean, folds, quantiles, risk, sketches, strategies

from .conftest import SF

DAY = datetime.date
SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def frames():
    rng = np.random.default_rng(3)
    n = 4000
    return {
        "normal": rng.normal(100, 5, n), "tails": np.exp(rng.normal(0, 60, n)) * rng.choice([-1, 1], n), "ties": rng.choice([1.5, 2.5, 2.5, 2.5, 7.0], n),
        "near": 1.0 + rng.integers(0, 50, n) * 2.0**-52, "tiny": rng.integers(-20, 20, n) * 5e-324, "huge": rng.uniform(-1, 1, n) * 1.7e308,
    }


@pytest.mark.parametrize("fit", [1, 60, 50_000])
def test_quantiles_are_exact(spark, fit):
    own = frames()
    df = spark.createDataFrame(pd.DataFrame(own))
    df = df.unionByName(spark.createDataFrame([(None, float("nan"), float("inf"), None, None, None)], df.schema))
    got = quantiles.exact_quantiles(df, {c: SHARES for c in own}, fit)
    for c, values in own.items():
        ordered = sorted(float(v) for v in values)
        for p in SHARES:
            at = p * (len(ordered) - 1)
            lo, hi = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert got[c, p] == lo + (hi - lo) * (at - math.floor(at)), (c, p)


def test_quantiles_take_few_passes(spark, monkeypatch):
    passes = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda df, ranks: passes.append(1) or narrowed(df, ranks))
    own = frames()
    quantiles.exact_quantiles(spark.createDataFrame(pd.DataFrame(own)), {c: SHARES for c in own}, 1)
    assert len(passes) <= 7


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert quantiles.exact_quantiles(df, {"a": [0.5], "b": [0.5]}) == {("a", 0.5): None, ("b", 0.5): None}
    assert clean.fill_missing(df, ["a"]).first().a is None


def test_whole_frame_cleaning_like_by_group(spark):
    """One group of all rows and the whole frame give the same."""
    values = [None if k % 9 == 0 else float((k * 37) % 101) for k in range(300)]
    df = spark.createDataFrame([(k, 1, v) for k, v in enumerate(values)], "k int, g int, v double")
    for fn in (lambda by: clean.fill_missing(df, ["v"], by=by), lambda by: clean.winsorize(df, ["v"], 0.05, 0.9, by=by), lambda by: clean.outliers(df, "v", "iqr", 0.3, by=by), lambda by: clean.repair_pe(df.withColumn("v", F.col("v") - 20), "v", by=by)):
        assert sorted(map(str, fn(None).collect())) == sorted(map(str, fn(["g"]).collect()))


@pytest.mark.parametrize("tickers,days", [(256, 512), (3, 7)])
def test_covariances_of_blocks(spark, tickers, days):
    rng = random.Random(4)
    rows = [(f"T{t}", DAY(2024, 1, 1) + datetime.timedelta(days=d), rng.gauss(0.1 * t, 1) if rng.random() < 0.7 else None) for t in range(11) for d in range(40)]
    rows += [("lone", DAY(2030, 1, 1), 0.5), (None, DAY(2024, 1, 1), 1.0), ("T1", None, 1.0)]
    got = {(r.a, r.b): r.cov for r in risk.covariance(spark.createDataFrame(rows, "ticker string, date date, r double"), 1.0, tickers, days).collect()}
    wide = pd.DataFrame([r for r in rows if r[0] and r[1] and r[2] is not None], columns=["t", "d", "r"]).pivot(index="d", columns="t", values="r")
    want = wide.cov(min_periods=2)
    for a in wide.columns:
        for b in wide.columns:
            if a <= b and (wide[a].notna() & wide[b].notna()).sum() > 1:
                assert math.isclose(got.pop((a, b)), want.loc[a, b], rel_tol=1e-9, abs_tol=1e-12)
    assert all(v is None for v in got.values()) and ("lone", "lone") in got


def test_variance_with_and_without_gaps(spark):
    rng = random.Random(5)
    rows = [(f"T{t}", DAY(2024, 1, 1) + datetime.timedelta(days=d), rng.gauss(0, 1)) for t in range(6) for d in range(30)]
    df = spark.createDataFrame(rows, "ticker string, date date, r double")
    whole = risk.portfolio_variance(df, 1.0).first().v
    total = risk.covariance(df, 1.0).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")).otherwise(2 * F.col("cov")))).first()[0]
    assert math.isclose(whole, total, rel_tol=1e-9)


def test_fold_over_many_batches_and_segments(spark):
    """A series far larger than a batch; cut or not, each row meets the state that the one before left."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(20_000).selectExpr("id % 3 as k", "id as at", "cast((id * 7919) % 13 as double) as x").where("k < 2 or at < 30")

        def step(s, row):
            s = (s * 31 + int(row[1])) % 1_000_003
            return s, (row[0], s) if row[1] else None

        want, state = {}, {}
        for i in range(20_000):
            k, x = i % 3, (i * 7919) % 13
            if k == 2 and i >= 30:
                continue
            state[k] = (state.get(k, 1) * 31 + x) % 1_000_003
            if x:
                want[k, i] = state[k]
        for cuts in (None, [5, 6, 9000, 15_000]):
            rows = folds.fold(df, ["k"], ["at"], "at long, s long", lambda: 1, step, cuts).collect()
            assert {(r.k, r["at"]): r.s for r in rows} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_backtest_in_segments(spark):
    from marlstone.plans.trading import signals

    own = signals(spark, SF).where("ticker like 'Brand#1%'")
    whole = sorted(map(str, backtest.equity(own, ["ticker"], impact=True).collect()))
    assert whole == sorted(map(str, backtest.equity(own, ["ticker"], impact=True, cuts=[DAY(1997, 1, 1), DAY(1999, 5, 5)]).collect()))
    assert folds.fold(own.limit(0).select("ticker", "date", "close"), ["ticker"], ["date"], "date date", lambda: 0, lambda s, r: (s, None)).count() == 0


def test_regimes_of_a_long_series(spark):
    rows = [("a", DAY(2000, 1, 1) + datetime.timedelta(days=d), "xy"[d // 2 % 2], 0.9) for d in range(3000)]
    got = strategies.settle(spark.createDataFrame(rows, "key string, day date, regime string, confidence double"), {}).orderBy("day").collect()
    now, want = None, []
    for _, _, regime, _ in rows:  # days follow each other, so that no change ever waits three days
        now = now or regime
        want.append(now)
    assert [r.regime for r in got] == want


# Expressions


def series(n=60, seed=2):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(10, 3, n), rng.normal(5, 2, n)
    x[rng.random(n) < 0.1] = np.nan
    return pd.DataFrame({"ticker": "A", "date": [DAY(2024, 1, 1) + datetime.timedelta(days=k) for k in range(n)], "x": x, "y": y})


def computed(spark, frame, text):
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), "ticker string, date date, x double, y double")
    return [np.nan if r.f is None else r.f for r in expressions.compute(df, {"f": text}).orderBy("date").collect()]


def rank(w):
    known = w[~np.isnan(w)]
    return np.nan if np.isnan(w[-1]) else ((known < w[-1]).sum() + ((known == w[-1]).sum() + 1) / 2) / len(known)


def weighted(w):
    k = np.arange(1, len(w) + 1)
    known = ~np.isnan(w)
    return (w[known] * k[known]).sum() / k[known].sum() if known.any() else np.nan


CASES = {
    "Ref($x, 3)": lambda f: f.x.shift(3), "Delta($y, 2)": lambda f: f.y.diff(2), "Mean($x, 4)": lambda f: f.x.rolling(4, 1).mean(), "Sum($x, 4)": lambda f: f.x.rolling(4, 1).sum(),
    "Std($x, 5)": lambda f: f.x.rolling(5, 2).std(), "Max($x, 6) - Min($x, 6)": lambda f: f.x.rolling(6, 1).max() - f.x.rolling(6, 1).min(),
    "Corr($x, $y, 8)": lambda f: f.x.rolling(8, 2).corr(f.y), "Rank($x, 7)": lambda f: f.x.rolling(7, 1).apply(rank, raw=True), "WMA($x, 5)": lambda f: f.x.rolling(5, 1).apply(weighted, raw=True),
    "EMA($x, 6)": lambda f: f.x.ewm(span=6).mean(), "EMA($x, 1)": lambda f: f.x.ffill(), "Mean(Ref(Std($y, 4), 2), 3) * 2": lambda f: f.y.rolling(4, 2).std().shift(2).rolling(3, 1).mean() * 2,
    "If($x > Mean($x, 3), Sign($y - 5), Log(Abs($y)))": lambda f: np.where(f.x > f.x.rolling(3, 1).mean(), np.sign(f.y - 5), np.log(f.y.abs())),
    "-($x + 1e0) / .5 - -2": lambda f: -(f.x + 1) / 0.5 + 2, "($x >= 10) + ($y != 5) * 2": lambda f: (f.x >= 10).where(f.x.notna()) + 2.0, "2 - 3 - 4 * 5 / 10": lambda f: f.y * 0 - 3,
    "Log($y - 100)": lambda f: f.y * np.nan, "$x / ($y - $y)": lambda f: f.y * np.nan, "If($y > 0 & $y < 100 | $x > 0, 1, 0)": lambda f: f.y * 0 + 1,
}


@pytest.mark.parametrize("text", CASES)
def test_expressions_like_frames(spark, text):
    frame = series()
    got, want = computed(spark, frame, text), np.asarray(CASES[text](frame), float)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize(
    "text,position",
    [("$x +", 4), ("Mean($x)", 0), ("Mean($x, 2.5)", 9), ("Mean($x, $y)", 9), ("Ref($x, -1)", 8), ("Mean($x, 0)", 9), ("$x ? 2", 3), ("Foo($x)", 0), ("($x", 3), ("$x $y", 3), ("$nothing * 2", 0), ("2 * $x2", 4), ("", 0), ("If($x, 1)", 0)],
)
def test_errors_say_where(spark, text, position):
    df = spark.createDataFrame([("A", DAY(2024, 1, 1), 1.0, 2.0)], "ticker string, date date, x double, y double")
    with pytest.raises(expressions.ExpressionError) as e:
        expressions.compute(df, {"f": text})
    assert e.value.position == position


def test_equal_parts_are_made_once_and_exchanged_once(spark):
    from marlstone.plans.expressions import ALL, DEFAULT

    bars = spark.createDataFrame([("A", DAY(2024, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], "ticker string, date date, open double, high double, low double, close double, volume double")
    assert expressions.parse("Mean($x, 3) + 1") == expressions.parse(" Mean( $x ,3)+1.0")
    plan = expressions.compute(bars, DEFAULT | ALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    twice = expressions.compute(bars, {"a": "Mean($close, 3) * 2", "b": "1 - Mean($close, 3)"})._jdf.queryExecution().optimizedPlan().toString()
    assert twice.count("avg(") == 1


# Sketches


def test_sketches_near_exact_counts_and_late_events(spark, tmp_path):
    rng = random.Random(1)
    rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(4000)), rng.randrange(3000)) for _ in range(20_000)] + [(datetime.datetime(2024, 1, 1, 5), None), (None, 5)]
    df = spark.createDataFrame(rows, "ts timestamp, user_id long")
    for k in (2, 0, 1):  # batches in any order of time, one of them twice
        part = df.where(F.coalesce(F.hour("ts"), F.lit(0)) % 3 == k)
        sketches.keep(part, {2: 0, 0: 1, 1: 2}[k], f"file://{tmp_path}/sketch")
    sketches.keep(df.where(F.hour("ts") % 3 == 0), 1, f"file://{tmp_path}/sketch")
    got = {r.end: (r.n_users, r.n) for r in sketches.users_now(spark, f"file://{tmp_path}/sketch").collect()}
    for end in got:
        inside = [(t, u) for t, u in rows if t and end - datetime.timedelta(hours=24) <= t < end]
        users = len({u for _, u in inside if u is not None})
        assert got[end][1] == len(inside) and abs(got[end][0] - users) <= max(1, 4 * sketches.error() * users)
    assert statistics.mean(v[0] for v in got.values()) > 500


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    """Panels and joins with factors on tables in buckets have none, as-of joins one; the same rows as without."""
    from marlstone.operators import factors
    from marlstone.operators.align import asof_join
    from marlstone.plans.views import bars, fundamentals
    from marlstone.sources.buckets import exchanges, save_bucketed

    plain_bars, plain_reports = bars(spark, SF), fundamentals(spark, SF)
    own = save_bucketed(plain_bars, "t_bars", f"{tmp_path}/bars", buckets=4)
    reports = save_bucketed(plain_reports, "t_reports", f"{tmp_path}/reports", order="report_date", buckets=4)
    try:
        names = ["momentum_20d", "rsi_14", "volatility_20d"]
        panel = factors.compute(own, names)
        assert exchanges(panel) == 0 and exchanges(factors.compute(plain_bars, names)) > 0
        rows = lambda df: sorted(map(str, df.select("ticker", "date", *[F.round(n, 6).alias(n) for n in names]).collect()))
        assert rows(panel) == rows(factors.compute(plain_bars, names))
        known = asof_join(own, reports, ["revenue", "eps"])
        assert exchanges(known) == 1  # a union keeps no partitioning
        shown = lambda df: sorted(map(str, df.select("ticker", "date", "revenue", "eps").collect()))
        assert len(shown(known)) == own.count() and {s.split("revenue")[0] for s in shown(known)} == {s.split("revenue")[0] for s in shown(asof_join(plain_bars, plain_reports, ["revenue", "eps"]))}
        stored = save_bucketed(panel.select("ticker", "date", "rsi_14"), "t_factors", f"{tmp_path}/factors", buckets=4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        assert exchanges(own.join(stored, ["ticker", "date"])) == 0
        one = factors.compute(own.where("ticker = 'Brand#12'"), names)
        assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for t in ("t_bars", "t_reports", "t_factors"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
