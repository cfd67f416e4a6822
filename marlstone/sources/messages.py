"""Messages of groups as a source, for streams and for batches: a log of segments that is read by offsets.

A listener appends what it has received since it last looked as one segment (a poll) of its own log. A segment never
changes once it has its name, which says its first and last offset, so that any range of offsets can be read again.
Segments are the partitions of a batch; the groups wanted are an option, and others never leave the reader.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import threading
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "log int, offset long, poll long, group_id long, user_id long, message string, time timestamp"
_ARROW = pa.schema([("log", pa.int32()), ("offset", pa.int64()), ("poll", pa.int64()), ("group_id", pa.int64()), ("user_id", pa.int64()), ("message", pa.string()), ("time", pa.timestamp("us", "UTC"))])


def opened(path: str) -> tuple[files.FileSystem, str]:
    """The file system of a path or URI, which workers and driver reach alike, and the path in it."""
    return files.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def segments(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """Of each log the (first offset, end, file) of its segments, in order."""
    own, root = opened(path)
    found: dict[int, list[tuple[int, int, str]]] = {}
    for info in own.get_file_info(files.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.is_file and info.extension == "jsonl":
            first, _, end = info.base_name.removesuffix(".jsonl").partition("-")
            found.setdefault(int(info.path.split("/")[-2]), []).append((int(first), int(end), info.path))
    return {log: sorted(of) for log, of in sorted(found.items())}


def append(path: str, received: Iterable[str], log: int = 0) -> int:
    """Append texts as the next segment of a log that only this listener writes; the log's end. None, no segment."""
    lines = [line.replace("\n", " ") for line in received]
    own, root = opened(path)
    first = max([end for _, end, _ in segments(path).get(log, [])], default=0)
    if lines:
        own.create_dir(f"{root}/{log}")
        name = f"{root}/{log}/{first:020d}-{first + len(lines):020d}"
        with own.open_output_stream(f"{name}.part") as to:
            to.write("\n".join(lines).encode())
        own.move(f"{name}.part", f"{name}.jsonl")
    return first + len(lines)


def parse(line: str) -> tuple | None:
    """(group_id, user_id, message, time) of a group's message; None for all else, JSON or not."""
    try:
        data = json.loads(line)
    except ValueError:
        return None
    if not isinstance(data, dict) or data.get("post_type") != "message" or data.get("message_type") != "group":
        return None
    number = lambda v: int(v) if isinstance(v, (int, float)) or isinstance(v, str) and v.lstrip("-").isdigit() else None
    seconds = data.get("time")
    when = datetime.datetime.fromtimestamp(seconds, datetime.UTC) if isinstance(seconds, (int, float)) and abs(seconds) < 2**35 else None
    return number(data.get("group_id")), number(data.get("user_id")), str(data.get("raw_message", "")), when


class Part(InputPartition):
    """Offsets start to end of one segment."""

    def __init__(self, log: int, path: str, first: int, start: int, end: int):
        super().__init__((log, path, first, start, end))
        self.log, self.path, self.first, self.start, self.end = log, path, first, start, end


def _parts(path: str, start: dict, end: dict) -> list[Part]:
    out = []
    for log, own in segments(path).items():
        at, to = start.get(str(log), 0), end.get(str(log), 0)
        for first, last, name in own:
            if first < to and last > at:
                out.append(Part(log, name, first, max(at, first), min(to, last)))
        covered = sum(p.end - p.start for p in out if p.log == log)
        if covered != max(0, to - at):
            raise RuntimeError(f"log {log} no longer has all of its messages from {at} to {to}")
    return out


def _ends(path: str) -> dict:
    return {str(log): own[-1][1] for log, own in segments(path).items()}


class _Reading:
    def __init__(self, options: dict):
        self.path = options["path"]
        groups = options.get("groups", "")
        self.groups = {int(g) for g in groups.split(",") if g.strip()} or None

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        own, _ = opened(self.path)
        with own.open_input_stream(part.path) as f:
            lines = f.read().split(b"\n")
        for at in range(part.start, part.end, 4096):
            rows = []
            for offset in range(at, min(at + 4096, part.end)):
                message = parse(lines[offset - part.first].decode("utf-8", "replace"))
                if message and (self.groups is None or message[0] in self.groups):
                    rows.append((part.log, offset, part.first, *message))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Batch(_Reading, DataSourceReader):
    def partitions(self):
        return _parts(self.path, {}, _ends(self.path)) or [Part(0, "", 0, 0, 0)]

    def read(self, partition):
        return super().read(partition) if partition.path else iter(())


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self):
        return {}

    def latestOffset(self):
        return _ends(self.path)

    def partitions(self, start, end):
        return _parts(self.path, start, end)


class GroupMessages(DataSource):
    """Format ``group_messages``; options: path, and groups, their ids with commas between (all without it)."""

    @classmethod
    def name(cls):
        return "group_messages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def _options(reader, path: str, groups: Iterable[int] | None):
    own = reader.format("group_messages").option("path", path)
    return own if groups is None else own.option("groups", ",".join(map(str, groups)))


def read_messages(spark: SparkSession, path: str, groups: Iterable[int] | None = None) -> DataFrame:
    spark.dataSource.register(GroupMessages)
    return _options(spark.read, path, groups).load()


def stream_messages(spark: SparkSession, path: str, groups: Iterable[int] | None = None) -> DataFrame:
    spark.dataSource.register(GroupMessages)
    return _options(spark.readStream, path, groups).load()


def first_poll(messages: DataFrame, poll: str = "poll") -> DataFrame:
    """The messages of the first poll that has any."""
    first = messages.agg(F.min(poll).alias("_first"))
    return messages.join(F.broadcast(first), F.col(poll) == F.col("_first")).drop("_first")  # one row


def collect(messages: DataFrame, path: str, checkpoint: str, timeout: float = 60.0, every: str = "1 second") -> bool:
    """Write the first batch of a stream that has messages to a path, then stop; whether there was one in time.

    Called again with its checkpoint, it goes on behind what it read, so that no message is given twice or lost.
    """
    done = threading.Event()

    def keep(batch, _):
        if batch.isEmpty():
            return
        if done.is_set():
            raise InterruptedError  # the batch stays unread
        batch.write.mode("overwrite").parquet(path)
        done.set()

    q = messages.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    if done.wait(timeout):
        with contextlib.suppress(StreamingQueryException):  # the first batch is committed before a second one fails
            q.processAllAvailable()
    q.stop()
    return done.is_set()
