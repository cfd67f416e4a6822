"""Incremental loads that a repeated delivery or a crash leaves as they would be after one.

A load is a folder: ``data/batch=N`` holds what batch N added, ``marks/batch=N`` the newest date of every key after it,
and ``ledger/N.json`` says that both are whole. The ledger is written last, by a rename. A batch that is in the ledger
is not loaded again; one that is not is written anew, whatever a crash has left of it, from the marks of the last batch
that the ledger has.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._root = self._path(f"{path}/ledger")
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit(self, batch: int, info: dict) -> None:
        temporary, to = self._path(f"{self.path}/ledger/_{batch}"), self._path(f"{self.path}/ledger/{batch}.json")
        out = self._fs.create(temporary, True)
        out.write(json.dumps(info).encode())
        out.close()
        self._fs.rename(temporary, to)

    def info(self, batch: int) -> dict:
        (row,) = self.spark.read.text(f"{self.path}/ledger/{batch}.json", wholetext=True).collect()
        return json.loads(row[0])

    def marks(self) -> DataFrame | None:
        """(key, last) of every key, or None before the first batch."""
        done = self.batches()
        return self.spark.read.parquet(f"{self.path}/marks/batch={done[-1]}") if done else None


def past_marks(rows: DataFrame, marks: DataFrame | None, key: str = "ticker", order: str = "date", target=None) -> DataFrame:
    """Rows of a key past its mark (key, last), all of a key without one, up to ``target``; null keys and dates go."""
    own = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    if target is not None:
        own = own.where(F.col(order) <= F.lit(target))
    if marks is None:
        return own
    known = marks.select(F.col(key).alias("_key"), F.col("last").alias("_last"))
    return own.join(known, F.col(key) == F.col("_key"), "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_key", "_last")


def load_batch(rows: DataFrame, batch: int, path: str, *, key: str = "ticker", order: str = "date", target=None, clean: Callable | None = None) -> dict:
    """Add what a batch has past the marks; {rows_added, keys_updated, keys_skipped}, of a repeated batch as at first."""
    spark = rows.sparkSession
    ledger = Ledger(spark, path)
    if batch in ledger.batches():
        return ledger.info(batch)
    before = ledger.marks()
    fresh = past_marks(rows, before, key, order, target)
    (clean(fresh) if clean else fresh).write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
    added = spark.read.schema(rows.schema).parquet(f"{path}/data/batch={batch}")
    marks = added.groupBy(key).agg(F.max(order).alias("last"))
    after = marks if before is None else marks.unionByName(before).groupBy(key).agg(F.max("last").alias("last"))
    after.write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")
    n, updated = added.agg(F.count("*"), F.count_distinct(key)).first()
    offered = rows.agg(F.count_distinct(key)).first()[0]
    info = {"rows_added": n, "keys_updated": updated, "keys_skipped": offered - updated}
    ledger.commit(batch, info)
    return info


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the batches that are whole, with their batch."""
    done = Ledger(spark, path).batches()
    own = spark.read.parquet(f"{path}/data")
    return own.where(F.col("batch") <= (done[-1] if done else -1))


def load_stream(rows: DataFrame, path: str, checkpoint: str, **how):
    """Load a stream's batches as they come; the writer, to be given a trigger and started."""
    return rows.writeStream.foreachBatch(lambda batch, k: load_batch(batch, k, path, **how) and None).option("checkpointLocation", checkpoint)
