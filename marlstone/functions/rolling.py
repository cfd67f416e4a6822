"""Trailing-window statistics with the conventions of data frames: null until the window holds n values."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .safe import col, sdiv

KEYS = ("ticker",)


def series(*keys: str, by: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(by)


def last_n(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(w: WindowSpec, n: int, e: Column, c: Column) -> Column:
    return F.when(F.count(c).over(last_n(w, n)) == n, e)


def pct_change(c, n: int, w: WindowSpec) -> Column:
    """Change over n rows; a missing value counts as the one before it."""
    kept = F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.last(col(c), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -n))
    return sdiv(kept, before) - 1


def mean(c, n: int, w: WindowSpec) -> Column:
    return full(w, n, F.avg(col(c)).over(last_n(w, n)), col(c))


def std(c, n: int, w: WindowSpec) -> Column:
    return full(w, n, F.stddev_samp(col(c)).over(last_n(w, n)), col(c))


def highest(c, n: int, w: WindowSpec) -> Column:
    return full(w, n, F.max(col(c)).over(last_n(w, n)), col(c))


def lowest(c, n: int, w: WindowSpec) -> Column:
    return full(w, n, F.min(col(c)).over(last_n(w, n)), col(c))


def corr(a, b, n: int, w: WindowSpec) -> Column:
    """Pearson correlation of the pairs in the window; null where either does not vary."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    f = last_n(w, n)
    return full(w, n, sdiv(F.covar_samp(x, y).over(f), F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f)), x)


def skew(c, n: int, w: WindowSpec) -> Column:
    """Bias-corrected skewness."""
    g = F.skewness(col(c)).over(last_n(w, n))
    return full(w, n, g * ((n * (n - 1)) ** 0.5 / (n - 2)), col(c))


def kurt(c, n: int, w: WindowSpec) -> Column:
    """Bias-corrected excess kurtosis."""
    g = F.kurtosis(col(c)).over(last_n(w, n))
    return full(w, n, (g * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))), col(c))


#: Rows after which an exponential weight is dropped as under 1e-17 of the newest.
_FORGET = 39.2


def ewms(df, means: dict[str, tuple[str, int]], keys=KEYS, by: str = "date"):
    """df with exponentially weighted means, out: (column, span), weights normalised over the rows so far; no gaps.

    Weighted sums are running sums in blocks of rows, scaled to each block's start so that nothing overflows; of the
    earlier blocks only the last still counts in double precision. All means share the blocks and so their sorts.
    """
    from math import ceil, log

    qs = {out: 1 - 2 / (span + 1) for out, (_, span) in means.items()}
    block = max(ceil(_FORGET / -log(q)) for q in qs.values())
    if min(qs.values()) ** -block > 1e280:  # too unlike to share blocks
        for out, one in means.items():
            df = ewms(df, {out: one}, keys, by)
        return df
    w = series(*keys, by=by)
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumns({"_b": F.floor(F.col("_i") / block), "_j": F.col("_i") % block})
    inner = Window.partitionBy(*keys, "_b").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-1, -1)
    terms = {out: F.col(c) * F.pow(F.lit(1 / qs[out]), F.col("_j")) for out, (c, _) in means.items()}
    df = df.withColumns({f"_h_{out}": F.sum(t).over(inner) for out, t in terms.items()})
    df = df.withColumns({f"_l_{out}": F.coalesce(F.sum(t).over(last), F.lit(0.0)) for out, t in terms.items()})
    made = {}
    for out, q in qs.items():
        weights = (1 - F.pow(F.lit(q), F.col("_i") + 1)) / (1 - q)
        made[out] = F.pow(F.lit(q), F.col("_j")) * (F.col(f"_h_{out}") + F.col(f"_l_{out}") * (q**block)) / weights
    return df.withColumns(made).drop("_i", "_b", "_j", *[f"_{k}_{out}" for out in means for k in "hl"])


def ewm(df, c: str, span: int, out: str, keys=KEYS, by: str = "date"):
    """df with one exponentially weighted mean."""
    return ewms(df, {out: (c, span)}, keys, by)
