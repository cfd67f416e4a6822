"""A global shuffle in two passes, for tables larger than any memory.

The first pass scatters records uniformly over memory-sized buckets by a seeded hash. The second takes one bucket at a
time, shuffles it by Fisher and Yates' method and writes it. Buckets in a row are then a uniform permutation, and
shards are equal runs of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, prefix_sums, table, written

#: Buckets whose offsets are sent to all executors, 16 bytes each.
BROADCAST_BUCKETS = 1 << 20


def fisher_yates(n: int, seed) -> np.ndarray:
    """A uniform permutation of n places."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64(seed)).shuffle(order)  # swaps each place with a random one not yet settled
    return order


def two_pass_shuffle(docs: DataFrame, n_shards: int, *, seed: int = 0, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows and columns of docs, written in shuffled order, with ``shard`` and ``slot``.

    The law is ``rows``: counts of shards differ by one at most, and slots are gapless from 0. The hash is of the seed,
    the document and the partition that it was read from, so that equal rows, however many, spread as well; the order
    depends on the seed and on how the input is split. Input columns named shard or slot are replaced. Null and empty
    texts are rows like others; a text of any length goes whole, so that its bucket may be larger; an empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    docs = plain(docs).drop("shard", "slot")
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.spark_partition_id())
    scattered = docs.withColumn("_ms_hash", hashed).withColumn("_ms_bucket", F.pmod("_ms_hash", F.lit(buckets)))
    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("_ms_bucket", T.LongType()), T.StructField("_ms_at", T.LongType())])

    def shuffle(key, bucket):
        bucket = bucket.combine_chunks()
        h = bucket.column("_ms_hash").to_numpy()
        base = np.argsort(h, kind="stable")  # rows arrive in any order
        order = base[fisher_yates(len(h), [seed, key[0].as_py()])]
        out = bucket.select(keep).take(pa.array(order))
        return out.append_column("_ms_bucket", pa.repeat(key[0], len(h))).append_column("_ms_at", pa.array(np.arange(len(h))))

    done = written(scattered.groupBy("_ms_bucket").applyInArrow(shuffle, schema), "shards")
    sizes = done.groupBy("_ms_bucket").count()
    n = done.count()
    least, more = divmod(n, n_shards)
    at = F.col("_ms_before") + F.col("_ms_at")
    cut = more * (least + 1)
    over = max(least, 1)
    shard = F.when(at < cut, F.floor(at / (least + 1))).otherwise(more + F.floor((at - cut) / over)).cast("int")
    first = F.when(at < cut, F.col("shard") * (least + 1)).otherwise(cut + (F.col("shard") - more) * least)
    before = prefix_sums(sizes, "_ms_bucket", "count", "_ms_before")
    if buckets <= BROADCAST_BUCKETS:  # a row of two numbers each; with more, the join is left to Spark
        before = F.broadcast(before)
    placed = done.join(before, "_ms_bucket")
    return placed.withColumn("shard", shard).withColumn("slot", (at - first).cast("long")).select(*keep, "shard", "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder of Parquet files a shard, each file in the order of its slots."""
    shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_two_pass_shuffle(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the law ``rows``. A null text has size 1 and the checksum of no bytes."""
    done = two_pass_shuffle(table(spark, sf_dir, "documents"), 8, seed=17)
    text = F.coalesce("text", F.lit(""))
    return done.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
