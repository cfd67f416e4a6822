"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of the columns that the operators add for themselves on the way.
OWN = "_ms_"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = OWN + name
    while name.lower() in taken:
        name += "_"
    return name


def plain(df: DataFrame) -> DataFrame:
    """df without columns whose names begin as the operators' own do; they would clash on the way."""
    return df.drop(*[c for c in df.columns if c.lower().startswith(OWN)])


class Scratch:
    """Tables on the way to a result, which go as soon as nothing reads them."""

    def __init__(self):
        self.made: list[DataFrame] = []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(written(df, tag))
        return self.made[-1]

    def drop(self, *tables: DataFrame) -> None:
        for one in tables or list(self.made):
            dropped(one)
            self.made = [t for t in self.made if t is not one]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set and all is one process."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="marlstone-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ms_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing will read it again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._ms_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give what a worker is done with back to the system, as Spark uses workers again and again."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def in_pieces(batches, rows: int = 512):
    """Arrow batches cut into smaller ones; memory goes back to the system at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prefix_sums(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Exclusive running sum of value by key. df has one row a partition or bucket, never one a document."""
    from pyspark.sql import Window

    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))
