"""Strategies: rules that turn features into signals and weights, their checks, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.safe import sdiv

from .folds import fold

RATINGS = {"Buy": 1.0, "Overweight": 0.5, "Hold": 0.0, "Underweight": -0.5, "Sell": -1.0}


@dataclass(frozen=True)
class Strategy:
    """entry and exit are conditions on the factor columns; the other figures are what its owner has set."""

    name: str
    description: str
    category: str
    entry: Callable[[], Column]
    exit: Callable[[], Column]
    holding: tuple[int, int, int] = (1, 5, 3)
    kill: dict = field(default_factory=lambda: {"max_drawdown": -0.05, "daily_loss_limit": -0.02, "consecutive_losses": 5, "volatility_spike": 3.0})


REGISTRY: dict[str, Strategy] = {}


def register(name: str, description: str, category: str, **more):
    """Register make() -> (entry, exit), both functions without arguments that give a condition."""

    def add(make):
        if name in REGISTRY:
            raise ValueError(f"strategy {name} is registered twice")
        entry, exit_ = make()
        REGISTRY[name] = Strategy(name, description, category, entry, exit_, **more)
        return make

    return add


@register("momentum", "momentum over 20 bars", "trend", holding=(3, 20, 10))
def _():
    return lambda: F.col("momentum_20d") > 0.05, lambda: F.col("momentum_20d") < -0.02


@register("reversal", "a fall over 20 bars, until half of it is made good", "reversion")
def _():
    return lambda: F.col("reversal_20d") > 0.05, lambda: F.col("reversal_20d") < 0.025


@register("sentiment", "momentum over 5 bars", "event", holding=(1, 3, 1), kill={"max_drawdown": -0.03, "daily_loss_limit": -0.01, "consecutive_losses": 3, "volatility_spike": 2.0})
def _():
    return lambda: F.col("momentum_5d") > 0.03, lambda: F.col("momentum_5d") < -0.015


@register("regime_switch", "momentum over 20 bars that goes on", "trend")
def _():
    return lambda: (F.col("momentum_20d") > 0.03) & (F.col("momentum_5d") > 0), lambda: F.col("momentum_20d") < -0.02


def signals(features: DataFrame, name: str) -> DataFrame:
    """features with ``en`` and ``ex`` by a strategy's rules (momentum's for an unknown one); missing values fulfil none."""
    s = REGISTRY.get(name, REGISTRY["momentum"])
    return features.withColumns({"en": F.coalesce(s.entry(), F.lit(False)), "ex": F.coalesce(s.exit(), F.lit(False))})


def limits(spark) -> DataFrame:
    """Holding periods and kill switches of all strategies, a row each."""
    rows = [(s.name, *s.holding, float(s.kill["max_drawdown"]), float(s.kill["daily_loss_limit"]), int(s.kill["consecutive_losses"]), float(s.kill["volatility_spike"])) for s in REGISTRY.values()]
    return spark.createDataFrame(rows, "strategy string, min_days int, max_days int, typical_days int, max_drawdown double, daily_loss_limit double, consecutive_losses int, volatility_spike double")


def momentum_weight(momentum: Column, rsi: Column, volume_ratio: Column, trend: Column, entry: float = 0.05, exit_: float = -0.02, overbought: float = 70.0) -> Column:
    """(weight, confidence) from -0.3 to 1; a missing value fulfils no condition."""
    is_ = lambda w, c: F.struct(w.cast("double").alias("weight"), c.cast("double").alias("confidence"))
    up = (momentum > entry) & (rsi < overbought) & (volume_ratio > 0.8) & (trend > 0)
    return (
        F.when(up, is_(F.least(F.greatest(momentum * 5, F.lit(0.3)), F.lit(1.0)), F.least(momentum * 3 + 0.3, F.lit(0.95))))
        .when((momentum < exit_) | (rsi > overbought), is_(F.lit(-0.3), F.lit(0.7))).otherwise(is_(F.lit(0.0), F.lit(0.3)))
    )


def position_sizes(signals_: DataFrame, positions: int = 10, most: float = 0.05) -> DataFrame:
    """(ticker, weight) of the long signals (ticker, score) of the highest scores, equal scores by ticker."""
    best = signals_.where("score > 0").orderBy(F.desc("score"), "ticker").limit(positions)
    n = best.agg(F.count("*").alias("n"))
    j = best.crossJoin(F.broadcast(n))  # one row
    return j.select("ticker", F.least(F.least(F.lit(1.0) / F.col("n"), F.lit(most)) * (F.col("score") / 0.6), F.lit(most)).alias("weight"))


def sentiment_signals(readings: DataFrame, weights: dict[str, float], *, least: float = 0.3, most: float = 0.6, extreme: float = 0.8, contrarian: bool = True, index: str = "000300") -> DataFrame:
    """(ticker, score, confidence, direction, strength) from (source, sentiment, confidence, bull_ratio, bear_ratio,
    tickers): extreme crowds count against themselves, by half; readings without tickers are of the index."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    own = readings.withColumn("_w", F.try_element_at(weight, F.col("source"))).where(F.col("_w").isNotNull() & (F.col("confidence") >= least))
    up, down = F.col("sentiment") == "bullish", F.col("sentiment") == "bearish"
    flips = F.lit(contrarian) & ((up & (F.col("bull_ratio") > extreme)) | (down & (F.col("bear_ratio") > extreme)))
    plain = F.when(up, F.col("bull_ratio") * F.col("_w")).when(down, -F.col("bear_ratio") * F.col("_w")).otherwise(0.0)
    score = F.when(flips & up, -F.abs(plain) * 0.5).when(flips & down, F.abs(plain) * 0.5).otherwise(plain)
    own = own.select(F.greatest(F.least(score, F.lit(most)), F.lit(-most)).alias("score"), (F.col("confidence") * F.when(flips, 0.7).otherwise(1.0)).alias("confidence"), F.explode(F.when(F.size(F.coalesce("tickers", F.array().cast("array<string>"))) > 0, F.col("tickers")).otherwise(F.array(F.lit(index)))).alias("ticker"))
    g = own.groupBy("ticker").agg(F.avg("score").alias("score"), F.avg("confidence").alias("confidence"))
    return g.withColumns({"direction": F.when(F.col("score") > 0.05, "long").when(F.col("score") < -0.05, "short").otherwise("flat"), "strength": F.when(F.abs("score") > 0.2, "moderate").otherwise("weak")})


def validate(df: DataFrame) -> DataFrame:
    """df with multiplier, passed and recommendation of a weight vector a row.

    Takes weights (array), source, regime, momenta and rsis (arrays, null: none), n_history and win_rate.
    """
    w = F.coalesce("weights", F.array().cast("array<double>"))
    n = F.size(w)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    mean = sdiv(total, n)
    idle = (n == 0) | (F.coalesce(F.array_max(F.transform(w, F.abs)), F.lit(0.0)) < 1e-6)
    won = ~F.coalesce((F.col("n_history") >= 5) & (F.col("win_rate") < 0.35), F.lit(False))
    side = F.when(mean > 0.1, "bullish").when(mean < -0.1, "bearish").otherwise("neutral")
    count = lambda c, test: F.size(F.filter(F.coalesce(c, F.array().cast("array<double>")), test))
    agrees = lambda m: ((side == "bullish") & (m > 0)) | ((side == "bearish") & (m < 0))
    calm = lambda x: ((side == "bullish") & (x < 70)) | ((side == "bearish") & (x > 30))
    yes = count("momenta", agrees) + count("rsis", calm)
    no = count("momenta", lambda m: ~agrees(m) & (F.abs(m) > 0.01)) + count("rsis", lambda x: ~calm(x))
    fits = (side == "neutral") | (no <= yes)
    source, regime = F.lower("source"), F.coalesce("regime", F.lit("unknown"))
    matched = ~((source.contains("momentum") & regime.contains("oscillating")) | (~(source.contains("momentum") & regime.contains("oscillating")) & source.contains("reversal") & regime.contains("trend")) | ((regime == "extreme_volatility") & (F.abs(mean) > 0.5)))
    gross = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.abs(x))
    hhi = sdiv(F.aggregate(w, F.lit(0.0), lambda a, x: a + x * x), gross * gross)
    spread = (n <= 1) | ((F.array_max(F.transform(w, F.abs)) <= 0.5) & ~F.coalesce(hhi > 0.5, F.lit(False)))
    factor = F.when(won, 1.0).otherwise(0.7) * F.when(fits, 1.0).otherwise(0.8) * F.when(matched, 1.0).otherwise(0.85) * F.when(spread, 1.0).otherwise(0.9)
    ok = won & fits & matched & spread
    advice = F.when(ok & (factor > 0.9), "proceed").when(ok & (factor > 0.6), "proceed_with_caution").otherwise("review")
    return df.withColumns({"multiplier": F.when(idle, 1.0).otherwise(F.round(factor, 3)), "passed": idle | ok, "recommendation": F.when(idle, "hold").otherwise(advice)})


def rating_score(signal: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in RATINGS.items() for x in kv]), signal), F.lit(0.0))


def settle(regimes: DataFrame, strategies: dict[str, tuple[str, float]], cooldown: int = 3, least: float = 0.3) -> DataFrame:
    """(key, day, regime, strategy, weight): the regime that holds each day, by an ordered fold over a key's days.

    A change within ``cooldown`` days of the last day with a regime is put off; days of little confidence have none.
    """

    def step(state, row):
        now, at = state
        day, regime = row
        if now is None or regime is None or now == regime or (day - at).days >= cooldown:
            now = regime
        return (now, day), (day, now)

    own = regimes.where(F.col("confidence") >= least).select("key", "day", "regime")
    out = fold(own, ["key"], ["day", "regime"], "day date, regime string", lambda: (None, None), step)
    name = F.create_map(*[F.lit(x) for k, v in strategies.items() for x in (k, v[0])])
    weight = F.create_map(*[F.lit(x) for k, v in strategies.items() for x in (k, float(v[1]))])
    return out.withColumns({"strategy": F.try_element_at(name, F.col("regime")), "weight": F.coalesce(F.try_element_at(weight, F.col("regime")), F.lit(0.0))})


def peers(returns: DataFrame, industries: DataFrame, most: int = 3) -> DataFrame:
    """(ticker, peer, ret): of each ticker the first others of its industry by name, the best return first.

    Only the first ``most`` + 1 names of an industry can be anyone's peers, so that no industry is joined with itself.
    """
    first = industries.withColumn("_n", F.row_number().over(Window.partitionBy("industry").orderBy("ticker"))).where(F.col("_n") <= most + 1)
    pairs = industries.join(first.select("industry", F.col("ticker").alias("peer"), "_n"), "industry").where("ticker != peer")
    pairs = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("_n"))).where(F.col("_k") <= most)
    return pairs.join(returns.select(F.col("ticker").alias("peer"), "ret"), "peer", "left").select("ticker", "peer", "ret")
