"""Evaluation of factors: information coefficients, groups, turnover, decay, correlation and neutralisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import rolling as r
from marlstone.functions.safe import col, sdiv
from marlstone.operators.clean import group_stats


def avg_rank(c, *keys: str) -> Column:
    """Rank with ties sharing their mean."""
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(c)
    ties = F.count("*").over(Window.partitionBy(*keys, c))
    return F.rank().over(ordered) + (ties - 1) / 2


def safe_corr(x, y) -> Column:
    """Pearson correlation as an aggregate over complete pairs; null without variance."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return sdiv(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def forward_return(k: int, close: str = "close") -> Column:
    return sdiv(F.lead(close, k).over(r.series()), close) - 1


def rolling_ic(df: DataFrame, factor: str = "factor", returns: str = "fwd", window: int = 60) -> DataFrame:
    """A row a ticker of at least 30 pairs: rolling correlation of the ranks, its mean, spread and sign."""
    own = df.where(F.col(factor).isNotNull() & F.col(returns).isNotNull())
    own = own.withColumns({"_x": avg_rank(factor, "ticker"), "_y": avg_rank(returns, "ticker"), "_n": F.count("*").over(Window.partitionBy("ticker"))}).where("_n >= 30")
    own = own.withColumn("_ic", r.corr("_x", "_y", window, r.series()))
    mean, std = F.avg("_ic"), F.stddev_samp("_ic")
    return own.groupBy("ticker").agg(mean.alias("ic"), std.alias("ic_std"), sdiv(mean, std + 1e-8).alias("icir"), F.avg((F.col("_ic") > 0).cast("int")).alias("ic_positive_ratio"), F.count("_ic").alias("n_periods"))


def bucket(c: str, groups: int, *keys: str) -> Column:
    """Equal-frequency bucket from 0: how many of the inner quantiles lie below the value."""
    edges = F.percentile(c, F.array(*[F.lit(i / groups) for i in range(1, groups)])).over(Window.partitionBy(*keys))
    return F.size(F.filter(F.array_distinct(edges), lambda e: e < F.col(c)))


def quantile_groups(df: DataFrame, factor: str = "factor", returns: str = "fwd", groups: int = 5) -> DataFrame:
    """Mean, spread and count of returns by ticker and bucket, with the long-short return and whether means rise or
    fall throughout; tickers of under 10 rows a group are left out."""
    own = df.where(F.col(factor).isNotNull() & F.col(returns).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_n") >= groups * 10)
    g = own.withColumn("bucket", bucket(factor, groups, "ticker")).groupBy("ticker", "bucket").agg(F.avg(returns).alias("mean_return"), F.stddev_samp(returns).alias("std_return"), F.count("*").alias("n"))
    w = Window.partitionBy("ticker")
    step = F.col("mean_return") - F.lag("mean_return").over(w.orderBy("bucket"))
    g = g.withColumn("_step", step)
    return g.select("ticker", "bucket", "mean_return", "std_return", "n", (F.max_by("mean_return", "bucket").over(w) - F.min_by("mean_return", "bucket").over(w)).alias("long_short"), F.coalesce((F.min("_step").over(w) > 0) | (F.max("_step").over(w) < 0), F.lit(True)).alias("monotonic"))


def turnover(df: DataFrame, factor: str = "factor", holding: int = 5) -> DataFrame:
    own = df.where(F.col(factor).isNotNull()).withColumn("_r", avg_rank(factor, "ticker") / F.count("*").over(Window.partitionBy("ticker")))
    change = F.abs(F.col("_r") - F.lag("_r", holding).over(r.series()))
    g = own.withColumn("_c", change).groupBy("ticker").agg(F.avg("_c").alias("avg_turnover"))
    return g.withColumn("stability", 1 - F.col("avg_turnover"))


def decay_curve(df: DataFrame, factor: str = "factor", close: str = "close", lags: int = 20) -> DataFrame:
    """Correlation with the returns over 1 to ``lags`` bars, all in one pass, and the first lag below half the first."""
    w = r.series()
    own = df.withColumns({f"_f{k}": sdiv(F.lead(close, k).over(w), close) - 1 for k in range(1, lags + 1)})
    both = lambda k: F.col(factor).isNotNull() & F.col(f"_f{k}").isNotNull()
    ics = [F.when(F.count_if(both(k)) > 30, safe_corr(factor, f"_f{k}")).alias(f"ic_{k}") for k in range(1, lags + 1)]
    wide = own.groupBy("ticker").agg(*ics)
    under = [F.when(F.abs(F.col(f"ic_{k}")) < F.abs(F.col("ic_1")) / 2, F.lit(k)) for k in range(2, lags + 1)]
    return wide.withColumn("half_life", F.coalesce(*under, F.lit(lags)))


def correlation_matrix(wide: DataFrame, names: list[str]) -> DataFrame:
    """(factor_a, factor_b, corr) for a before or equal to b in names, pairwise complete; null without variance.

    A row becomes one for each pair of names, of which there is a bounded number, and is summed up at once, before
    anything is shuffled: the moments of each pair are all that leaves a task.
    """
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    place = lambda k: F.get(F.array(*[F.lit(p[k]) for p in pairs]), F.col("_p"))
    values = wide.select(F.array(*[F.col(n).cast("double") for n in names]).alias("_v")).select("_v", F.explode(F.array(*map(F.lit, range(len(pairs))))).alias("_p"))
    both = values.select("_p", F.get("_v", place(0)).alias("_x"), F.get("_v", place(1)).alias("_y"))
    both = both.where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    found = both.groupBy("_p").agg(sdiv(F.covar_samp("_x", "_y"), F.stddev_samp("_x") * F.stddev_samp("_y")).alias("corr"))
    every = wide.sparkSession.createDataFrame([(k, names[i], names[j]) for k, (i, j) in enumerate(pairs)], "_p int, factor_a string, factor_b string")
    return F.broadcast(every).join(found, "_p", "left").select("factor_a", "factor_b", F.greatest(F.least("corr", F.lit(1.0)), F.lit(-1.0)).alias("corr"))


def collinear_groups(matrix: DataFrame, names: list[str], threshold: float = 0.7) -> DataFrame:
    """(factor, grp) of the groups of two or more that strong correlations connect; grp is the first name in it.

    Labels of at most len(names) nodes are passed along the edges, which is bounded by the registry and not by data.
    """
    spark = matrix.sparkSession
    edges = [(r_.factor_a, r_.factor_b) for r_ in matrix.where((F.abs("corr") >= threshold) & (F.col("factor_a") != F.col("factor_b"))).collect()]
    label = {n: n for n in names}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    sizes = {v: sum(x == v for x in label.values()) for v in label.values()}
    rows = [(n, v) for n, v in label.items() if sizes[v] > 1]
    return spark.createDataFrame(rows, "factor string, grp string")


def demean(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def neutralise(df: DataFrame, columns: list[str], industry: str = "industry", cap: str | None = None, by: list[str] = ()) -> DataFrame:
    """Residuals of a regression on industry dummies and, if given, the standardised log of size.

    Means within the industry take the place of the dummies; what size explains beyond them is taken off by its slope
    (Frisch-Waugh). Groups of under 30 rows stay as they are. Without ``by`` sums over all rows are one row, joined
    back, and no task holds them all.
    """
    inner = Window.partitionBy(*by, industry)
    first = {"_n": F.count(F.lit(1))}
    own = df
    if cap:
        own = own.withColumn("_l", F.when(F.col(cap) > 0, F.ln(cap)).otherwise(0.0))
        first |= {"_m": F.avg("_l"), "_s": F.stddev_pop("_l")}
    own = group_stats(own, list(by), **first)
    if cap:
        own = own.withColumn("_z", (F.col("_l") - F.col("_m")) / (F.col("_s") + 1e-8))
        own = own.withColumn("_z", F.col("_z") - F.avg("_z").over(inner))
    own = own.withColumns({f"_y_{c}": F.col(c) - F.avg(c).over(inner) for c in columns})
    if cap:
        z = F.col("_z")
        own = group_stats(own, list(by), _zz=F.sum(z * z), **{f"_zy_{c}": F.sum(z * F.col(f"_y_{c}")) for c in columns})
    out = {}
    for c in columns:
        e = F.col(f"_y_{c}")
        if cap:
            e = e - F.coalesce(sdiv(f"_zy_{c}", "_zz"), F.lit(0.0)) * F.col("_z")
        out[c] = F.when(F.col("_n") >= 30, e).otherwise(F.col(c))
    return own.withColumns(out).select(*df.columns)
