"""Polling as a streaming source: the time of a poll is its offset, the executors fetch, and what was fetched is kept until the poll is done.

A poll fetches all sources of a list once, spread over tasks. Each body (or the error) is put into an archive below the poll's offset before it is
passed on; so a batch that runs again after a failure, or on another executor, gets what the first attempt got, even where the site has moved on. A job
that was down for many intervals polls once. When Spark reports a poll as done, archives of earlier ones are deleted.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from urllib.request import urlopen

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import unseen
from ..streaming.jobs import Days, start
from ..tables import kept
from . import feeds

#: Sources that a task fetches at most: their bodies come to Spark in one Arrow batch.
SHARE = 256
SCHEMA = "source_name string, polled_ms long, body string, error string"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def put(uri: str, text: str) -> None:
    """A file that is there as a whole or not at all."""
    at, path = store(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with at.open_output_stream(part) as f:
        f.write(text.encode())
    at.move(part, path)


def get(uri: str) -> str | None:
    at, path = store(uri)
    if at.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with at.open_input_stream(path) as f:
        return f.read().decode()


class Share(InputPartition):
    def __init__(self, at: int, number: int, of: int) -> None:
        self.at, self.number, self.of = at, number, of


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.list, self.archive = options["sources"], options["archive"].rstrip("/")
        self.every, self.tasks, self.timeout = int(options.get("everyms", 600_000)), int(options.get("tasks", 8)), float(options.get("timeout", 15))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        now = int(time.time() * 1000)
        return {"at": now - now % self.every}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        if end["at"] <= start["at"]:
            return []
        of = max(self.tasks, -(-len(self._sources()) // SHARE))
        return [Share(end["at"], k, of) for k in range(of)]

    def _sources(self) -> list[tuple[str, str]]:
        """The list's sources, each line once."""
        return list(dict.fromkeys((x.partition(",")[0], x.partition(",")[2]) for x in (get(self.list) or "").splitlines() if "," in x))

    def read(self, partition: Share) -> Iterator[tuple]:
        for name, url in self._sources()[partition.number :: partition.of]:
            yield (name, partition.at, *self._body(partition.at, name, url))

    def _body(self, at: int, name: str, url: str) -> tuple[str | None, str | None]:
        uri = f"{self.archive}/{at}/{hashlib.md5(f'{name},{url}'.encode()).hexdigest()}"
        found = get(uri)
        if found is None:
            try:
                with urlopen(url, timeout=self.timeout) as f:  # noqa: S310  # the list is the operator's own
                    found = json.dumps([f.read().decode("utf-8", "replace"), None])
            except (OSError, ValueError) as e:
                found = json.dumps([None, f"{type(e).__name__}: {e}"])
            put(uri, found)
        body, error = json.loads(found)
        return body, error

    def commit(self, end: dict) -> None:
        at, path = store(self.archive)
        for found in at.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if found.type == fs.FileType.Directory and int(found.base_name) < end["at"]:
                at.delete_dir(found.path)


class PollSource(DataSource):
    """readStream.format("polls"): options sources (a file of lines ``name,url``), archive (a folder that all share), everyms, tasks, timeout."""

    @classmethod
    def name(cls) -> str:
        return "polls"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PollReader(dict(self.options))


def stream(spark: SparkSession, sources: str, at: str, every_ms: int = 600_000, tasks: int = 8) -> DataFrame:
    spark.dataSource.register(PollSource)
    return spark.readStream.format("polls").option("sources", sources).option("archive", f"{at}/archive").option("everyms", every_ms).option("tasks", tasks).load()


ITEM = "external_id string, source_name string, content string, polled_ms long"


def taken(spark: SparkSession, at: str) -> Days:
    """The items taken in so far, by the day of their poll."""
    return Days(spark, f"{at}/items", ITEM, F.timestamp_millis("polled_ms"))


def poll_job(bodies: DataFrame, at: str, seen: DataFrame | None = None, every: str | None = None) -> StreamingQuery:
    """Take in what each poll brings that neither earlier polls nor ``seen`` (external_id, such as those of the news of 48 hours) had."""
    table = taken(bodies.sparkSession, at)
    first = None if seen is None else kept(seen.select("external_id"), "seen")

    def step(batch: DataFrame, batch_id: int) -> None:
        own = feeds.items(feeds.parsed(batch.filter("body IS NOT NULL"))).withColumn("external_id", F.nullif("external_id", F.lit("")))
        own = own.crossJoin(F.broadcast(batch.agg(F.max("polled_ms").alias("polled_ms"))))  # one row
        own = kept(own, "polled-items")  # bodies are fetched and parsed once, not for each use
        old = table.table(batch_id).select("external_id")
        table.put(unseen(own, old if first is None else old.unionByName(first), "external_id"), batch_id)

    return start(bodies, at, step, every)
