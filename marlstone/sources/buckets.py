"""Catalogue tables whose rows lie where windows and joins by series want them.

A table is dealt into buckets by its series once, when it is written; panels, and joins by series of such tables of
equally many buckets, then run without an exchange, as-of joins with one (a union keeps no partitioning), and a filter on
one series reads one bucket. Joins by series and day are such joins where ``spark.sql.requireAllClusterKeysForCoPartition``
is false.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 64


def save_bucketed(df: DataFrame, name: str, path: str | None = None, key: str = "ticker", order: str = "date", buckets: int = BUCKETS) -> DataFrame:
    """Write df as a table in buckets by key, each sorted by key and order, and give it as read from the catalogue."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return bucketed(df.sparkSession, name)


def bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """Exchanges in the plan of df, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
