"""A sink for messages: alerts, posts, notices to an index. Each message of an epoch is there once, whatever is repeated.

Tasks write their messages to files of their own, which nobody reads yet. An epoch's commit names the files that count in one manifest, and a manifest that is there
already wins: an epoch that is repeated adds nothing. An aborted epoch's files are deleted, and those of tasks that died are in no manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..sources.polls import get, put, store


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    messages: int


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        lines = [json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) for row in iterator]
        if not lines:
            return Written(None, 0)
        file = f"{uuid.uuid4().hex}.json"
        put(f"{self.path}/messages/{file}", "\n".join(lines) + "\n")
        return Written(file, len(lines))

    def _forget(self, messages: list[Written | None]) -> None:
        at, path = store(self.path)
        for m in messages:
            if m is not None and m.file:
                at.delete_file(f"{path}/messages/{m.file}")

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        manifest = f"{self.path}/epochs/{batchId}.json"
        if get(manifest) is not None:
            self._forget(messages)
            return
        own = [m for m in messages if m is not None and m.file]
        put(manifest, json.dumps({"epoch": batchId, "files": [m.file for m in own], "messages": sum(m.messages for m in own)}))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._forget(messages)


class Outbox(DataSource):
    """writeStream.format("outbox").option("path", folder)."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return OutboxWriter(dict(self.options)["path"].rstrip("/"))


def send(messages: DataFrame, path: str, at: str, every: str | None = None) -> StreamingQuery:
    """Put a stream of messages into the outbox ``path``; progress is kept below ``at``."""
    messages.sparkSession.dataSource.register(Outbox)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return messages.writeStream.format("outbox").option("path", path).option("checkpointLocation", f"{at}/progress").trigger(**trigger).start()


def sent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """epoch and the messages (schema) of all epochs that were committed."""
    named = spark.read.schema("epoch long, files array<string>, messages long").json(f"{path}/epochs").select("epoch", F.explode("files").alias("_file"))
    rows = spark.read.schema(schema).json(f"{path}/messages").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(named, "_file").drop("_file")
