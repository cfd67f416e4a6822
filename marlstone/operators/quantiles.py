"""Exact quantiles of whole columns, by narrowing the ranges that hold them.

A quantile lies between two ranks. A pass counts, for every rank still open, the values of its range by bucket, and the
bucket that holds the rank is its next range: by sign and power of two while a range spans several, then by equal steps.
Ranges of few values, or of one, end the search, so that no task ever holds more than a bounded number of values; five
equal passes tell any two doubles apart, and so there are at most seven in all, however many rows there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.safe import finite

#: Values of a range that one task sorts, and steps that a range is cut into.
FIT, STEPS = 50_000, 4096


@dataclass
class _Rank:
    column: str
    rank: int
    lo: float
    hi: float
    below: int
    inside: int

    def spans(self) -> bool:
        """Whether the range has several powers of two, or zero."""
        return self.lo <= 0 <= self.hi or max(abs(self.lo), abs(self.hi)) > 2 * min(abs(self.lo), abs(self.hi))


def _power(x):
    """Sign and power of two as one number that never falls as x rises."""
    return F.when(x == 0, 0).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x))) + 1100)).cast("long")


def _step(x, r: _Rank):
    return F.least(F.floor((x - r.lo) / (r.hi - r.lo) * STEPS), F.lit(STEPS - 1)).cast("long")


def _spread(df: DataFrame, ranks: list[_Rank], bucket) -> DataFrame:
    """(rank, x, bucket) of the values in each rank's range."""
    of = []
    for k, r in enumerate(ranks):
        x = F.col(r.column)
        of.append(F.when(x.between(r.lo, r.hi), F.struct(F.lit(k).alias("rank"), x.alias("x"), bucket(x, r).alias("bucket"))))
    return df.select(F.explode(F.filter(F.array(*of), lambda s: s.isNotNull())).alias("s")).select("s.*")


def _narrowed(df: DataFrame, ranks: list[_Rank]) -> None:
    spread = _spread(df, ranks, lambda x, r: _power(x) if r.spans() else _step(x, r))
    counts = spread.groupBy("rank", "bucket").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # of a few thousand buckets
    wanted = F.get(F.array(*[F.lit(r.rank - r.below) for r in ranks]), F.col("rank"))
    found = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where((F.col("before") <= wanted) & (wanted < F.col("before") + F.col("n")))
    for row in found.collect():  # one of each rank
        r = ranks[row["rank"]]
        r.lo, r.hi, r.below, r.inside = row.lo, row.hi, r.below + row.before, row.n


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], fit: int = FIT) -> dict[tuple[str, float], float | None]:
    """Quantiles of numeric columns, by (column, share), between two values by their distance.

    Nulls, NaN and infinities take no part; None for columns without any other value. Each pass reads the columns anew.
    """
    own = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in wanted])
    sums = own.agg(*[f(c).alias(f"{k}_{c}") for c in wanted for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    places, ranks = {}, {}
    for c, shares in wanted.items():
        n = sums[f"n_{c}"]
        for p in shares if n else ():
            at = p * (n - 1)
            places[c, p] = (floor(at), ceil(at), at - floor(at))
            for k in places[c, p][:2]:
                ranks[c, k] = _Rank(c, k, sums[f"lo_{c}"], sums[f"hi_{c}"], 0, n)
    while wide := [r for r in ranks.values() if r.inside > fit and r.lo < r.hi]:
        _narrowed(own, wide)
    values = {key: r.lo for key, r in ranks.items() if r.lo == r.hi}
    rest = [r for r in ranks.values() if r.lo < r.hi]
    if rest:
        got = _spread(own, rest, lambda x, r: F.lit(0)).groupBy("rank").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        at = F.get(F.array(*[F.lit(r.rank - r.below) for r in rest]), F.col("rank"))
        for row in got.select("rank", F.get("xs", at.cast("int")).alias("x")).collect():
            values[rest[row["rank"]].column, rest[row["rank"]].rank] = row.x
    out: dict[tuple[str, float], float | None] = {(c, p): None for c, shares in wanted.items() for p in shares}
    for (c, p), (a, b, share) in places.items():
        out[c, p] = values[c, a] + (values[c, b] - values[c, a]) * share
    return out
