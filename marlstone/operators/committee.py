"""Fusion of five sources into a direction, and the votes of four rule agents on it. A row an instrument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.safe import sdiv
from marlstone.operators.regime import WEIGHTS

#: Weights of price, factors, news, wiki and facts without a known regime. Fixed values.
BASE = (0.40, 0.30, 0.15, 0.10, 0.05)
SIDES = ("bullish", "bearish", "neutral")
ACTIONS = ("bullish", "bearish", "hold", "caution")


def _lean(score: Column, up, down) -> Column:
    return F.when(score > up, "bullish").when(score < down, "bearish").otherwise("neutral")


def _normal(weights: list[Column]) -> list[Column]:
    total = reduce(lambda a, b: a + b, weights)
    return [F.coalesce(sdiv(w, total), w) for w in weights]


def _first_largest(values: list[Column], names) -> Column:
    """Name of the largest value, the first of equal ones."""
    top = F.greatest(*values)
    return F.coalesce(*[F.when(v == top, n) for v, n in zip(values, names)])


def fuse(snapshots: DataFrame) -> DataFrame:
    """snapshots with the five weights, direction, confidence, strength, conflicts and warnings.

    Takes regime, pct_change, momenta and rsis (arrays; null: no factors), n_factors, n_news, n_positive, n_negative,
    wiki_score, n_facts; a null count or score is a source that has nothing. Price against factors, and news against
    factors, are conflicts in which the factors win; near a price limit, factors and news weigh less.
    """
    has = {"price": F.col("pct_change").isNotNull(), "factor": F.col("momenta").isNotNull(), "news": F.col("n_news") > 0, "wiki": F.col("wiki_score").isNotNull(), "facts": F.col("n_facts") > 0}
    has = {k: F.coalesce(c, F.lit(False)) for k, c in has.items()}
    share = lambda c, whole: F.least(F.col(c) / whole, F.lit(1.0))
    quality = [F.lit(0.9), share("n_factors", 15), share("n_news", 5), F.col("wiki_score"), share("n_facts", 10)]
    quality = [F.when(h, q).otherwise(0.0) for h, q in zip(has.values(), quality)]
    table = F.create_map(*[x for name, w in WEIGHTS.items() for x in (F.lit(name), F.array(*map(F.lit, w)))])
    base = F.coalesce(F.try_element_at(table, F.col("regime")), F.array(*map(F.lit, BASE)))
    own = snapshots.withColumns({f"_w{i}": w for i, w in enumerate(_normal([base[i] * q for i, q in enumerate(quality)]))})
    wild = has["price"] & (F.abs("pct_change") > 0.095)
    damped = _normal([F.col("_w0"), F.col("_w1") * 0.1, F.col("_w2") * 0.5, F.col("_w3"), F.col("_w4")])
    names = ("w_price", "w_factors", "w_news", "w_wiki", "w_facts")
    own = own.withColumns({n: F.when(wild, d).otherwise(F.col(f"_w{i}")) for i, (n, d) in enumerate(zip(names, damped))})
    pct = F.col("pct_change")
    bulls = F.size(F.filter("momenta", lambda m: m > 0.02)) + F.size(F.filter(F.coalesce("rsis", F.array().cast("array<double>")), lambda x: x > 30))
    bears = F.size(F.filter("momenta", lambda m: m < -0.02))
    price, factor, news = _lean(pct, 0.01, -0.01), _lean(bulls - bears, 0, 0), _lean(F.col("n_positive") - F.col("n_negative"), 0, 0)
    against = lambda a, b: (a != b) & (a != "neutral") & (b != "neutral")
    first = F.when(has["price"] & has["factor"] & against(price, factor), "price_against_factors")
    second = F.when(has["news"] & has["factor"] & against(news, factor), "news_against_factors")
    own = own.withColumn("conflicts", F.array_compact(F.array(first, second))).withColumn("warnings", F.array_compact(F.array(F.when(first.isNotNull(), "unclear"), F.when(wild, "near_limit"))))
    # each source gives its weight to one side; factors without a clear mean give half to neutral
    mean = sdiv(F.aggregate("momenta", F.lit(0.0), lambda a, m: a + m), F.size("momenta"))
    by_price, by_news = _lean(pct, 0.02, -0.02), F.when(F.col("n_positive") / F.col("n_news") > 0.5, "bullish").when(F.col("n_negative") / F.col("n_news") > 0.5, "bearish").otherwise("neutral")
    by_mean = _lean(mean, 0.03, -0.03)
    half = F.when(mean > 0, "bullish").otherwise("bearish")
    counts = has["factor"] & (F.size("momenta") > 0)
    scores = []
    for side in SIDES:
        from_factors = F.when(by_mean != "neutral", F.when(by_mean == side, 1.0).otherwise(0.0)).otherwise(0.5 if side == "neutral" else F.when(half == side, 0.5).otherwise(0.0))
        parts = ((has["price"], by_price == side, "w_price"), (has["news"], by_news == side, "w_news"))
        score = reduce(lambda a, b: a + b, [F.when(h & hit, F.col(w)).otherwise(0.0) for h, hit, w in parts])
        scores.append(score + F.when(counts, F.col("w_factors") * from_factors).otherwise(0.0))
    own = own.withColumns({f"_s{i}": s for i, s in enumerate(scores)})
    values = [F.col(f"_s{i}") for i in range(3)]
    total = values[0] + values[1] + values[2]
    raw = F.when(total > 0, F.greatest(*values) / total).otherwise(0.3)
    out = {
        "direction": F.when(total > 0, _first_largest(values, SIDES)).otherwise("neutral"), "confidence": F.least(raw, F.lit(0.95)),
        "strength": F.when((total > 0) & (raw > 0.7), "strong").when(raw > 0.4, "moderate").otherwise("weak"),
    }
    return own.withColumns(out).drop(*[c for c in own.columns if c[:2] in ("_w", "_s")])


def with_intelligence(fused: DataFrame, side: str = "intel_direction", sure: str = "intel_confidence", tags: str = "intel_tags") -> DataFrame:
    """Outside intelligence strengthens a direction it shares; against it, or marked extreme, it only adds a warning."""
    extreme = F.coalesce(F.arrays_overlap(tags, F.array(F.lit("black_swan"), F.lit("extreme_policy"))), F.lit(False))
    known = F.coalesce(F.col(side) != "neutral", F.lit(False))
    same = ~extreme & known & (F.col(side) == F.col("direction"))
    apart = ~extreme & known & (F.col("direction") != "neutral") & (F.col(side) != F.col("direction"))
    note = F.when(extreme, "extreme_intelligence").when(apart, "intelligence_against")
    return fused.withColumns(
        {
            "confidence": F.when(same, F.least(F.col("confidence") + 0.1 * F.col(sure), F.lit(0.95))).otherwise(F.col("confidence")),
            "conflicts": F.when(apart, F.array_append("conflicts", F.lit("intelligence_against"))).otherwise(F.col("conflicts")),
            "warnings": F.concat("warnings", F.array_compact(F.array(note))),
        }
    )


def _vote(agent: str, action: Column, confidence: Column, flags: Column) -> Column:
    return F.struct(F.lit(agent).alias("agent"), action.alias("action"), confidence.cast("double").alias("confidence"), flags.alias("flags"))


def votes(df: DataFrame) -> DataFrame:
    """df with ``votes``: data, strategy, risk and memory agents.

    Takes what fuse() takes and gives, weights (array of the signals' weights; null or empty: none), drawdown of the
    portfolio, n_decisions and n_correct (null: no memory).
    """
    none = F.array().cast("array<string>")
    flags = lambda *pairs: F.array_compact(F.array(*[F.when(c, n) for c, n in pairs]))
    has = [F.col("pct_change").isNotNull(), F.col("momenta").isNotNull(), F.coalesce(F.col("n_news") > 0, F.lit(False)), F.col("wiki_score").isNotNull(), F.coalesce(F.col("n_facts") > 0, F.lit(False))]
    there = reduce(lambda a, b: a + b, [h.cast("int") for h in has])
    issues = flags((~has[0], "no_price"), (has[0] & (F.abs("pct_change") > 0.095), "abnormal_move"), (~has[1], "no_factors"))
    data = (
        F.when((there >= 4) & (F.size(issues) == 0), _vote("data", F.lit("bullish"), F.lit(0.9), none))
        .when(there >= 2, _vote("data", F.lit("hold"), F.lit(0.5), issues)).otherwise(_vote("data", F.lit("caution"), F.lit(0.3), issues))
    )
    w = F.coalesce("weights", F.array().cast("array<double>"))
    count = lambda test: F.size(F.filter(w, test))
    longs, shorts, flats = count(lambda x: x > 0.1), count(lambda x: x < -0.1), count(lambda x: F.abs(x) <= 0.1)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    side = F.when(total > 0.1, "bullish").when(total < -0.1, "bearish").otherwise("neutral")
    own = flags((shorts > 0, "short_signals"), ((side != "neutral") & (F.col("direction") != "neutral") & (side != F.col("direction")), "signals_against_fusion"))
    empty = F.size(w) == 0
    strategy = (
        F.when(empty, _vote("strategy", F.lit("hold"), F.lit(0.3), none)).when((longs > flats) & (F.size(own) == 0), _vote("strategy", F.lit("bullish"), F.lit(0.7), none))
        .when(longs > 0, _vote("strategy", F.lit("bullish"), F.lit(0.5), own)).otherwise(_vote("strategy", F.lit("hold"), F.lit(0.4), own))
    )
    gross = F.aggregate(w, F.lit(0.0), lambda a, x: a + F.abs(x))
    top = F.coalesce(F.array_max(F.transform(w, F.abs)), F.lit(0.0))
    risks = F.concat(flags((top > 0.5, "single_weight"), (gross > 1.0, "exposure"), (F.col("drawdown") < -0.05, "drawdown"), (F.col("regime") == "extreme_volatility", "extreme_volatility")), F.col("conflicts"))
    risk = (
        F.when(F.size(risks) >= 3, _vote("risk", F.lit("caution"), F.lit(0.8), risks)).when(F.size(risks) > 0, _vote("risk", F.lit("hold"), F.lit(0.6), risks))
        .otherwise(_vote("risk", F.lit("bullish"), F.lit(0.8), none))
    )
    n, right = F.col("n_decisions"), sdiv("n_correct", "n_decisions")
    memory = (
        F.when(empty, _vote("memory", F.lit("hold"), F.lit(0.5), none)).when(n.isNull(), _vote("memory", F.lit("hold"), F.lit(0.4), F.array(F.lit("no_memory"))))
        .when(n < 5, _vote("memory", F.lit("hold"), F.lit(0.4), none))
        .when(right >= 0.6, _vote("memory", F.when(side == "neutral", "hold").otherwise(side), F.least(0.5 + (right - 0.5), F.lit(0.85)), none))
        .when(right <= 0.4, _vote("memory", F.lit("caution"), F.lit(0.6), F.array(F.lit("low_accuracy")))).otherwise(_vote("memory", F.lit("hold"), F.lit(0.5), none))
    )
    return df.withColumn("votes", F.array(data, strategy, risk, memory))


def _adder(action: str):
    return lambda a, v: a + F.when(v["action"] == action, v["confidence"]).otherwise(0.0)


def consensus(df: DataFrame) -> DataFrame:
    """df (with ``votes``) with risk_flags, action, confidence, risk_level and human_review.

    The action of most confidence wins, caution from three tenths of all; flags count once.
    """
    all_ = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["confidence"])
    by = [F.aggregate("votes", F.lit(0.0), _adder(name)) for name in ACTIONS]
    flags = F.array_sort(F.array_distinct(F.flatten(F.transform("votes", lambda v: v["flags"]))))
    own = df.withColumns({"risk_flags": flags, "_all": all_, **{f"_v{i}": b for i, b in enumerate(by)}})
    values = [F.col(f"_v{i}") for i in range(4)]
    action = F.when(F.col("_v3") / F.greatest("_all", F.lit(0.01)) > 0.3, "caution").otherwise(_first_largest(values, ACTIONS))
    critical = F.size(F.filter("risk_flags", lambda f: f.isin("extreme_volatility", "drawdown")))
    n = F.size("risk_flags")
    level = F.when((critical >= 2) | (n >= 5), "critical").when((critical >= 1) | (n >= 3), "high").when(n >= 1, "medium").otherwise("low")
    own = own.withColumns({"action": action, "sure": F.when(F.col("_all") > 0, F.least(F.greatest(*values) / F.col("_all"), F.lit(0.95))).otherwise(0.0), "risk_level": level})
    review = F.col("risk_level").isin("high", "critical") | (F.col("action") == "caution") | (n >= 3)
    return own.withColumn("human_review", review).drop("_all", "_v0", "_v1", "_v2", "_v3")
