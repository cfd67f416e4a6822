"""Writes: replace by key, append, upsert, point updates and retention, as new tables or dynamic partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def update_values(old: DataFrame, new: DataFrame, keys: list[str], column: str) -> DataFrame:
    """column takes the value of new where there is one."""
    j = old.join(new.select(*keys, F.col(column).alias("_new")), keys, "left")
    return j.withColumn(column, F.coalesce("_new", column)).select(*old.columns)


def newer_than(df: DataFrame, mark, column: str = "date") -> DataFrame:
    """Rows past a high-water mark; all without one."""
    return df if mark is None else df.where(F.col(column) > F.lit(mark))


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write df, replacing the partitions it holds and leaving the others; rows are clustered and sorted for pruning."""
    ordered = df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("date",) if c in df.columns])
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def keep_recent(df: DataFrame, as_of, days: int, column: str = "date") -> DataFrame:
    return df.where(F.col(column) > F.date_sub(F.lit(as_of), days))


def append_json(df: DataFrame, path: str, day: str = "day") -> None:
    df.write.mode("append").partitionBy(day).json(path)


def save_both(df: DataFrame, path: str, raw_path: str, stamp, *by: str) -> None:
    """Replace the partitions of the cleaned layer, and append the same rows to the raw layer with the time they came."""
    replace_partitions(df, path, *by)
    df.withColumn("ingested_at", F.lit(stamp)).write.mode("append").partitionBy(*by).parquet(raw_path)


def save_run(runs: DataFrame, path: str) -> None:
    """Runs (run_id, params map, curve array<struct<date, equity>>, ...) as two tables: parameters as JSON, a row a point."""
    runs.drop("curve").withColumn("params", F.to_json("params")).write.mode("append").parquet(f"{path}/runs")
    points = runs.select("run_id", F.explode("curve").alias("p")).select("run_id", "p.date", "p.equity")
    points.write.mode("append").parquet(f"{path}/equity")


def fill_if_empty(source: DataFrame, path: str) -> bool:
    """Copy source to a table that is missing or empty; whether it did."""
    spark = source.sparkSession
    try:
        if not spark.read.parquet(path).isEmpty():
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    source.write.mode("overwrite").parquet(path)
    return True


def rewrite_status(spark: SparkSession, path: str, schema, changes: DataFrame, allowed: dict, to: str) -> DataFrame:
    """JSON records (id, status, ...) with their new status, written to another place; the errors as (id, error)."""
    from marlstone.operators.knowledge import transition

    records = spark.read.schema(schema).json(path)
    moved = transition(records.select("id", "status"), changes, allowed)
    fine = moved.where("error is null").select("id", F.col("status").alias("_s"))
    records.join(fine, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s").write.mode("overwrite").json(to)
    return moved.where("error is not null").select("id", "error")


def period_name(kind: str, day) -> str:
    """File name of a report: by day, ISO week, month, quarter or year."""
    if kind == "weekly":
        year, week, _ = day.isocalendar()
        return f"{year}-W{week:02d}.md"
    names = {"daily": f"{day:%Y-%m-%d}", "monthly": f"{day:%Y-%m}", "quarterly": f"{day.year}-Q{(day.month + 2) // 3}", "yearly": str(day.year)}
    return f"{names[kind]}.md"


def save_report(report: DataFrame, folder: str, kind: str, day) -> str:
    """Write a report of one row and column as text under its period's name; the place."""
    path = f"{folder}/{kind}/{period_name(kind, day)}"
    report.coalesce(1).write.mode("overwrite").text(path)
    return path


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export(spark: SparkSession, tables: dict[str, DataFrame], folder: str, as_of, keep_days: int = 30) -> list[str]:
    """Copy all tables into a folder of the day, and delete the folders of days that are too old; those that went."""
    from datetime import date, timedelta

    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{as_of:%Y-%m-%d}/{name}")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(root):
        name = s.getPath().getName()
        try:
            old = date.fromisoformat(name) < as_of - timedelta(days=keep_days)
        except ValueError:
            continue
        if old:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def refresh_statistics(spark: SparkSession, name: str) -> None:
    """Sizes and column statistics of a catalogue table, for the optimiser."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def refresh_calendar(days: DataFrame, path: str) -> None:
    """The trading calendar anew: one row a day, in order."""
    days.select("trade_date").distinct().orderBy("trade_date").coalesce(1).write.mode("overwrite").parquet(path)


def fan_out(alerts: DataFrame, channels: dict[str, str]) -> DataFrame:
    """A row for each alert (alert_id, level) and channel whose least level it reaches; senders read these rows."""
    rank = F.create_map(*[F.lit(x) for kv in (("info", 0), ("warning", 1), ("critical", 2)) for x in kv])
    every = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.lit(least).alias("least")) for c, least in channels.items()]))
    own = alerts.select("*", every.alias("_c"))
    fine = F.try_element_at(rank, F.col("level")) >= F.try_element_at(rank, F.col("_c.least"))
    return own.where(fine).select(*alerts.columns, F.col("_c.channel").alias("channel"))


def acknowledge(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    seen = ids.select("alert_id").distinct().withColumn("_a", F.lit(True))
    return alerts.join(seen, "alert_id", "left").withColumn("acknowledged", F.coalesce("_a", "acknowledged")).drop("_a")


def verify(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """facts (fact_id, verified, ...) with those of ids marked as verified."""
    seen = ids.select("fact_id").distinct().withColumn("_v", F.lit(True))
    return facts.join(seen, "fact_id", "left").withColumn("verified", F.coalesce("_v", "verified")).drop("_v")


def delete(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")
