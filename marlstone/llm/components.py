"""Connected components of a graph whose edges no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges, as a written table; root is the smallest node reachable.

    Large-star and small-star in turn: every node's neighbours are hung on the smallest of them, first the larger ones,
    then the smaller ones, until nothing moves. Each half is a minimum by node, combined before it is shuffled, and a
    join on the node that Spark may split; no list of neighbours is ever gathered, so a hub may hold any share of the
    edges. Edges with a null end are ignored.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = written(now, "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        # large star: a node's larger neighbours go to the smallest of itself and its neighbours
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        dropped(large)
        dropped(now)
        now, before, mark = small, mark, _mark(small)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "components")
    dropped(now)
    return out


def _mark(edges: DataFrame) -> tuple:
    """Tells two sets of distinct edges apart."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 16)), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).first())
