"""Reads of bars, JSON lines by day and Markdown with a YAML head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_days(spark: SparkSession, path: str, schema: StructType | str, start=None, end=None) -> DataFrame:
    """JSON lines in day folders; folders outside the range are not read, and bad lines are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("basePath", path).json(path)
    df = df if start is None else df.where(F.col("day") >= F.lit(start))
    return df if end is None else df.where(F.col("day") <= F.lit(end))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, type, tags, body) of Markdown files with a YAML head."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:\s*(.*)$", 1)), F.lit(""))
    tags = F.filter(F.split(F.regexp_replace(field("tags"), r"[\[\]]", ""), r"\s*,\s*"), lambda t: t != "")
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    return raw.select("path", field("title").alias("title"), field("type").alias("type"), tags.alias("tags"), body.alias("body"))


def first_available(*sources: DataFrame) -> DataFrame:
    """Rows of the first source that has a ticker; later ones fill in tickers that the earlier ones lack."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s.join(out.select("ticker").distinct(), "ticker", "left_anti"), allowMissingColumns=True)
    return out
