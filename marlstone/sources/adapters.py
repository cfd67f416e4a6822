"""Interfaces of outside systems, a registry of those that implement them, a cached dimension and settings.

Nothing here reaches a network: an adapter gives DataFrames, wherever it gets them from.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("data", "research", "execution", "agent")


@runtime_checkable
class DataAdapter(Protocol):
    """Bars, news (id, title, tickers, published) and statements of a vendor."""

    def bars(self, spark: SparkSession, tickers: list[str], start=None, end=None) -> DataFrame: ...
    def news(self, spark: SparkSession, tickers: list[str], limit: int = 50) -> DataFrame: ...
    def statements(self, spark: SparkSession, tickers: list[str]) -> DataFrame: ...


@runtime_checkable
class NewsCollector(Protocol):
    """collect gives (id, title, content, source, tier, published)."""

    def collect(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class ExecutionAdapter(Protocol):
    """place takes orders and gives them back with their status."""

    def place(self, orders: DataFrame) -> DataFrame: ...
    def positions(self) -> DataFrame: ...


class Adapters:
    """Adapters by kind and name; the first of a kind is its default."""

    def __init__(self):
        self._known: dict[str, dict[str, object]] = {k: {} for k in KINDS}

    def register(self, kind: str, name: str, adapter) -> None:
        if kind not in self._known:
            raise ValueError(f"no such kind of adapter: {kind}")
        if name in self._known[kind]:
            raise ValueError(f"{kind} adapter {name} is registered twice")
        self._known[kind][name] = adapter

    def get(self, kind: str, name: str | None = None):
        known = self._known[kind]
        if name is None:
            if not known:
                raise KeyError(f"no {kind} adapter")
            return next(iter(known.values()))
        return known[name]

    def names(self, kind: str) -> list[str]:
        return list(self._known[kind])


class TableAdapter:
    """A data adapter over tables: the reads of a vendor's files once they are stored."""

    def __init__(self, bars: Callable, news: Callable | None = None, statements: Callable | None = None):
        self._bars, self._news, self._statements = bars, news, statements

    def bars(self, spark, tickers, start=None, end=None):
        df = self._bars(spark).where(F.col("ticker").isin(list(tickers)))
        df = df if start is None else df.where(F.col("date") >= F.lit(start))
        return df if end is None else df.where(F.col("date") <= F.lit(end))

    def news(self, spark, tickers, limit=50):
        """The newest news that name one of the tickers; all without tickers."""
        own = self._news(spark)
        own = own.where(F.arrays_overlap("tickers", F.array(*map(F.lit, tickers)))) if tickers else own
        return own.orderBy(F.desc("published"), "id").limit(limit)

    def statements(self, spark, tickers):
        return self._statements(spark).where(F.col("ticker").isin(list(tickers)))


def cached_dimension(spark: SparkSession, path: str, load: Callable[[], DataFrame], now: float, max_age: float = 86_400.0) -> DataFrame:
    """A small table from its file while that is younger than ``max_age`` seconds, else loaded and written again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or now - fs.getFileStatus(p).getModificationTime() / 1000 > max_age:
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scan_view(df: DataFrame, name: str, sql: str) -> DataFrame:
    """The result of a query over a frame that it names."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)


def catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table_name, n_rows) of a database's tables, of which the catalogue has a bounded list."""
    rows = [(t.name, spark.table(f"{database}.{t.name}").count()) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "table_name string, n_rows long")


def _value(text: str):
    """A setting's value: true, false, null, a number, a list in brackets, or text without its quotes and comment."""
    text = text.strip()
    if text[:1] in ("'", '"') and text.find(text[0], 1) > 0:
        return text[1 : text.index(text[0], 1)]
    text = re.split(r"\s#", text, maxsplit=1)[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("true", "false", "null", "~"):
        return {"true": True, "false": False}.get(text.lower())
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def settings(text: str, environ: dict | None = None, prefix: str = "MARLSTONE_") -> dict[str, object]:
    """Flat settings of indented "name: value" lines and "- item" lists, nested names joined by dots.

    Values are typed; comments go. The environment overrides settings, and is typed alike.
    """
    out: dict[str, object] = {}
    stack: list[tuple[int, str]] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        item = line.strip()
        if item.startswith("- "):
            while stack and stack[-1][0] > depth:
                stack.pop()
            out.setdefault(".".join(n for _, n in stack), []).append(_value(item[2:]))
            continue
        name, _, value = item.partition(":")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        path = ".".join([n for _, n in stack] + [name.strip()])
        if value.strip() and not value.strip().startswith("#"):
            out[path] = _value(value)
        else:
            stack.append((depth, name.strip()))
    for k, v in (os.environ if environ is None else environ).items():
        if k.startswith(prefix):
            out[k[len(prefix) :].lower().replace("__", ".")] = _value(v)
    return out
