"""The day's report in eight sections, a row of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("Market state", "Snapshot", "Factor signals", "Risk checks", "Events", "Sentiment", "Method", "Prediction")


def market_state(change: Column) -> Column:
    """Of the index's change in a day; as a share."""
    name = F.when(change > 0.005, "trend").when(change < -0.005, "weak").otherwise("sideways")
    return F.concat(name, F.format_string(" (index %+.2f%%)", change * 100))


def listed(rows: DataFrame, line: Column, order: list, most: int, empty: str) -> DataFrame:
    """One row: up to ``most`` lines, or what stands in their place."""
    first = rows.select(F.struct(*order).alias("o"), line.alias("l")).orderBy("o").limit(most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"]), "\n")
    return first.agg(F.coalesce(F.nullif(lines, F.lit("")), F.lit(empty)).alias("text"))


def compose(day: DataFrame, sections: list[DataFrame]) -> DataFrame:
    """(report): the head of a day (date) and the sections (text), each a frame of one row."""
    parts = [s.select(F.col("text").alias(f"t{k}")) for k, s in enumerate(sections)]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts, day.select(F.date_format("date", "yyyy-MM-dd").alias("day")))  # one row each
    head = F.concat(F.lit("---\nreport_id: rpt_"), F.translate("day", "-", ""), F.lit("_market\ndate: "), F.col("day"), F.lit("\n---\n# Daily report "), F.col("day"))
    body = [F.concat(F.lit(f"\n\n## {k + 1}. {name}\n"), F.col(f"t{k}")) for k, name in enumerate(SECTIONS)]
    return one.select(F.concat(head, *body).alias("report"))
