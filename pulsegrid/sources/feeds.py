"""Feeds (RSS 2.0): parsed where their bodies are, from rows or files, in batch or as a stream; and as a data source of a few given texts."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.streaming import DataStreamReader

NAMES = ("source_name", "title", "summary", "description", "link")
SCHEMA = "source_name string, title string, summary string, description string, link string"


class _Feed(InputPartition):
    def __init__(self, name: str, text: str) -> None:
        self.name, self.text = name, text


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.feeds = [(k.removeprefix("feed."), v) for k, v in options.items() if k.startswith("feed.")]

    def partitions(self) -> list[_Feed]:
        return [_Feed(n, t) for n, t in self.feeds] or [_Feed("", "<rss/>")]

    def read(self, partition: _Feed) -> Iterator[tuple]:
        for item in ET.fromstring(partition.text).iter("item"):
            yield (partition.name, *(item.findtext(x) for x in ("title", "summary", "description", "link")))


class FeedSource(DataSource):
    """spark.read.format("feed").option("feed.<name>", <RSS text>): the items of some feeds."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _items_of(batches):
    schema = pa.schema([(n, pa.string()) for n in NAMES])
    for batch in batches:
        out: list[tuple] = []
        for name, body in zip(batch.column("source_name").to_pylist(), batch.column("body").to_pylist(), strict=True):
            try:
                found = ET.fromstring(body or "<rss/>")
            except ET.ParseError:
                continue
            out += [(name, *(item.findtext(x) for x in NAMES[1:])) for item in found.iter("item")]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)


def parsed(bodies: DataFrame) -> DataFrame:
    """The items of feeds (source_name, body), a feed to a row. A feed that isn't well formed, or null, has none."""
    return bodies.select("source_name", "body").mapInArrow(_items_of, SCHEMA)


def polled(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """The items of the feed files in a folder, which the executors read: spark.read in batch, spark.readStream as files arrive."""
    files = reader.text(path, wholetext=True)  # the option of that name is overwritten by this argument
    return parsed(files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source_name"), F.col("value").alias("body")))


def items(feed: DataFrame, least: int = 30) -> DataFrame:
    """source_name, content ('title. summary'), external_id: what a poll takes in, without texts that are too short."""
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    content = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce(nonempty("summary"), nonempty("description"), F.lit("")))
    return feed.select("source_name", content.alias("content"), F.coalesce("link", F.lit("")).alias("external_id")).filter(F.length("content") >= least)
