"""A sink of alerts that sends each at most once.

Tasks stage what they write; a batch's manifest, made by a rename when all tasks are done, publishes it. What a failed or
repeated attempt has staged is in no manifest. Senders claim a published part before they send it, so that a crash may
leave a part unsent, never sent twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from .messages import opened


@dataclass
class Staged(WriterCommitMessage):
    name: str
    rows: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator):
        lines = [json.dumps(r.asDict(True), default=str) for r in iterator]
        name = f"{uuid.uuid4().hex}.jsonl"
        if lines:
            own, root = opened(self.path)
            own.create_dir(f"{root}/staged")
            with own.open_output_stream(f"{root}/staged/{name}") as to:
                to.write("\n".join(lines).encode())
        return Staged(name, len(lines))

    def commit(self, messages, batchId):
        own, root = opened(self.path)
        manifest = f"{root}/published/{batchId:020d}.json"
        if own.get_file_info(manifest).type != files.FileType.NotFound:  # delivered again
            self.abort(messages, batchId)
            return
        own.create_dir(f"{root}/published")
        with own.open_output_stream(f"{manifest}.part") as to:
            to.write(json.dumps([m.name for m in messages if m and m.rows]).encode())
        own.move(f"{manifest}.part", manifest)

    def abort(self, messages, batchId):
        own, root = opened(self.path)
        for m in messages:
            if m and m.rows:
                own.delete_file(f"{root}/staged/{m.name}")


class AlertSink(DataSource):
    """Format ``alert_sink``; option: path, the outbox."""

    @classmethod
    def name(cls):
        return "alert_sink"

    def streamWriter(self, schema, overwrite):
        return _Writer(self.options)


def write_alerts(alerts: DataFrame, path: str, checkpoint: str):
    """The writer of a stream of alerts, to be given a trigger and started."""
    alerts.sparkSession.dataSource.register(AlertSink)
    return alerts.writeStream.format("alert_sink").option("path", path).option("checkpointLocation", checkpoint)


def published(spark: SparkSession, path: str, schema) -> DataFrame:
    """All alerts that are published."""
    names = [f"{path}/staged/{name}" for _, own in _manifests(path) for name in own]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def _manifests(path: str) -> list[tuple[str, list[str]]]:
    own, root = opened(path)
    out = []
    for info in sorted(own.get_file_info(files.FileSelector(f"{root}/published", allow_not_found=True)), key=lambda i: i.path):
        if info.extension == "json":
            with own.open_input_stream(info.path) as f:
                out.append((info.base_name, json.loads(f.read())))
    return out


def deliver(path: str, send: Callable[[dict], None]) -> int:
    """Send every published alert whose part nobody has claimed yet; how many were sent.

    One process delivers. If sending fails, the rest of that part stays unsent and the error is raised.
    """
    own, root = opened(path)
    own.create_dir(f"{root}/claimed")
    sent = 0
    for _, names in _manifests(path):
        for name in names:
            claim = f"{root}/claimed/{name}"
            if own.get_file_info(claim).type != files.FileType.NotFound:
                continue
            own.open_output_stream(claim).close()
            with own.open_input_stream(f"{root}/staged/{name}") as f:
                for line in f.read().split(b"\n"):
                    send(json.loads(line))
                    sent += 1
    return sent
