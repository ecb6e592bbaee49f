"""Continuous ingest, history, deduplication and clustering, as jobs that drain what is there, or run on at an interval.

Event time drives the windows: rows later than 48 hours behind the newest are dropped. Watermarks need TIMESTAMP, so the engine's
TIMESTAMP_NTZ columns (UTC) are cast on the way in and back on the way out. What a job has made so far stands in a log: a folder
for each batch id, with what that batch adds. Nothing is kept in the driver, and a batch that runs twice after a failure overwrites
its own folder, so that a table is the same whether a job ran through, was repeated, or was started again on its folder.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import latest, running, unseen
from ..operators.vectors import STATE, added, assign
from ..plans.ingest import prepared, trends_after
from ..tables import children, is_folder, kept, names, new_path, remove, touch
from ..udfs import embed

LATE = "48 hours"

Fold = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, name: str, schema, files: int = 16) -> DataFrame:
    """A stream of a table's Parquet files as they arrive: of the parts in ``name.parquet``, or, where that is a file, of itself."""
    reader, path = spark.readStream.schema(schema).option("maxFilesPerTrigger", files), f"{folder}/{name}.parquet"
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def start(stream: DataFrame, at: str, each: Callable[[DataFrame, int], None] | None = None, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Start a job that keeps its progress in the folder ``at``: every interval, or through what is there now and then it ends."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(**trigger)
    return (w.foreachBatch(each) if each else w.format("parquet").option("path", f"{at}/table")).start()


def clock(spark: SparkSession, action: Callable[[int], None], at: str, every: str) -> StreamingQuery:
    """Run action(number of the run) at an interval: for what has no input of its own, such as fading scores or reading lists anew."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return start(ticks, at, lambda _, batch_id: action(batch_id), every)


class Log:
    """A table as the fold of what batches added; every so many batches the fold is written, so that a read stays short.

    A fold holds what was before its batch and the batch, never an earlier attempt at itself; so a batch that is repeated with other rows
    replaces what it gave before. The last two folds and the batches after the older of them stay; what is older is deleted.
    """

    def __init__(self, spark: SparkSession, top: str, schema: str, fold: Fold, every: int = 64) -> None:
        self.spark, self.top, self.schema, self.fold, self.every = spark, top, schema, fold, every

    def _folds(self, before: int | None = None) -> list[tuple[int, str]]:
        found = [(int(n.partition("-")[0]), n) for n in children(self.spark, f"{self.top}/upto")]
        return sorted(x for x in found if before is None or x[0] < before)

    def _paths(self, before: int | None) -> list[str]:
        last, name = max(self._folds(before), default=(-1, ""))
        own = sorted(i for n in children(self.spark, f"{self.top}/batch") if (i := int(n)) > last and (before is None or i < before))
        return [f"{self.top}/upto/{name}"] * (last >= 0) + [f"{self.top}/batch/{i}" for i in own]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, batch: DataFrame, batch_id: int) -> None:
        own = f"{self.top}/batch/{batch_id}"
        batch.write.mode("overwrite").parquet(own)
        if batch_id % self.every == self.every - 1:
            remove(self.spark, f"{self.top}/upto/{batch_id}-*")
            self.fold(self._read([*self._paths(batch_id), own])).write.parquet(f"{self.top}/upto/{batch_id}-{uuid.uuid4().hex}")
            for number, name in self._folds(batch_id)[:-1]:
                remove(self.spark, f"{self.top}/upto/{name}")
                for n in names(self.spark, f"{self.top}/batch"):
                    if int(n) <= number:
                        remove(self.spark, f"{self.top}/batch/{n}")

    def table(self, before: int | None = None) -> DataFrame:
        """The table as it stood before a batch, or as it is."""
        return self.fold(self._read(self._paths(before)))


class Days:
    """A table that batches only add to, in folders by day and batch; a read that names its first day lists the days from there on only.

    A batch that is repeated replaces its own rows. What a batch that hasn't come to its end has written isn't read.
    """

    def __init__(self, spark: SparkSession, top: str, schema: str, day: Column) -> None:
        self.spark, self.top, self.schema, self.day = spark, top, schema, day

    def put(self, batch: DataFrame, batch_id: int) -> None:
        remove(self.spark, f"{self.top}/data/_day=*/_batch={batch_id}")
        columns = [f.strip().split()[0] for f in self.schema.split(",")]
        batch.select(*columns, self.day.cast("date").alias("_day"), F.lit(batch_id).cast("long").alias("_batch")).write.mode("append").partitionBy("_day", "_batch").parquet(f"{self.top}/data")
        done = names(self.spark, f"{self.top}/last")
        touch(self.spark, f"{self.top}/last/{max([batch_id, *map(int, done)])}")
        for n in done:
            if int(n) < batch_id:
                remove(self.spark, f"{self.top}/last/{n}")

    def table(self, before: int | None = None, since: datetime.date | None = None) -> DataFrame:
        """What batches before one have added, or all; since: of that day and later, and of no day."""
        if before is None:
            before = max(map(int, names(self.spark, f"{self.top}/last")), default=-1) + 1
        days = [n for n in names(self.spark, f"{self.top}/data") if n.startswith("_day=") and (since is None or not n[5:6].isdigit() or n[5:] >= since.isoformat())]
        if not days:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(f"{self.schema}, _day date, _batch long").option("basePath", f"{self.top}/data")
        return reader.parquet(*(f"{self.top}/data/{d}" for d in sorted(days))).filter(F.col("_batch") < before).drop("_day", "_batch")


# --- History -----------------------------------------------------------------------------------------------------------


def history_log(spark: SparkSession, at: str) -> Log:
    """Counts only grow while a bucket is open, so the largest is the latest."""
    return Log(spark, f"{at}/log", "trend_id long, bucket timestamp_ntz, n long", lambda rows: rows.groupBy("trend_id", "bucket").agg(F.max("n").alias("n")))


def history_job(arrivals: DataFrame, at: str, every: str | None = None) -> StreamingQuery:
    """Five-minute counts of a stream of arrivals (trend_id, timestamp). State holds 48 hours; a batch adds the buckets that it changed."""
    stamped = arrivals.select("trend_id", F.col("timestamp").cast("timestamp").alias("_ts")).withWatermark("_ts", LATE)
    counts = stamped.groupBy("trend_id", F.window("_ts", "5 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    log = history_log(arrivals.sparkSession, at)
    return start(counts.select("trend_id", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n"), at, log.put, every, mode="update")


def history(arrivals: DataFrame, at: str | None = None) -> DataFrame:
    """Drain a stream of arrivals; the counts by five minutes and their running sums."""
    at = at or new_path(arrivals.sparkSession, "history")
    history_job(arrivals, at).awaitTermination()
    return running(history_log(arrivals.sparkSession, at).table(), "n", "bucket", "trend_id", "total")


# --- Deduplication -----------------------------------------------------------------------------------------------------


def dedup_job(items: DataFrame, key: str, ts: str, at: str, every: str | None = None) -> StreamingQuery:
    stamped = items.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", LATE)
    return start(stamped.dropDuplicatesWithinWatermark([key]).drop("_ts"), at, every=every)


def deduplicated(items: DataFrame, key: str, ts: str, at: str | None = None) -> DataFrame:
    """Drain a stream; the first of each key within the watermark. State older than 48 hours is dropped."""
    at = at or new_path(items.sparkSession, "unique")
    dedup_job(items, key, ts, at).awaitTermination()
    return items.sparkSession.read.schema(items.schema).parquet(f"{at}/table")


# --- Trends ------------------------------------------------------------------------------------------------------------

TRENDS = "trend_id long, message_count long, first_seen timestamp_ntz, last_updated timestamp_ntz, needs_scoring boolean"


def trend_log(spark: SparkSession, at: str) -> Log:
    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy("trend_id").agg(F.sum("message_count").alias("message_count"), F.min("first_seen").alias("first_seen"), F.max("last_updated").alias("last_updated"), F.bool_or("needs_scoring").alias("needs_scoring"))

    return Log(spark, f"{at}/log", TRENDS, fold)


def trend_job(arrivals: DataFrame, at: str, every: str | None = None) -> StreamingQuery:
    """Count and date trends by a stream of arrivals and mark them for scoring; a batch writes only the trends that it met."""
    log = trend_log(arrivals.sparkSession, at)

    def merge(batch: DataFrame, batch_id: int) -> None:
        one = batch.select("trend_id", F.lit(1).cast("long").alias("message_count"), F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_updated"), F.lit(True).alias("needs_scoring"))
        log.put(log.fold(one), batch_id)

    return start(arrivals, at, merge, every)


def ingested(arrivals: DataFrame, at: str | None = None) -> DataFrame:
    """Drain a stream of arrivals; the trends as they then are."""
    at = at or new_path(arrivals.sparkSession, "trends")
    trend_job(arrivals, at).awaitTermination()
    return trend_log(arrivals.sparkSession, at).table()


# --- Clusters ----------------------------------------------------------------------------------------------------------


def _by_seconds(ts: str) -> Column:
    return F.timestamp_seconds(ts)


def cluster_log(spark: SparkSession, at: str) -> Days:
    return Days(spark, f"{at}/log", f"{STATE}, is_duplicate boolean", _by_seconds("ts"))


def _first_day(oldest: float | None, hours: float) -> datetime.date | None:
    """A day that is surely not after what lies so many hours before a time, in any time zone."""
    return None if oldest is None else datetime.datetime.fromtimestamp(oldest - hours * 3600, datetime.UTC).date() - datetime.timedelta(days=1)


def cluster_job(items: DataFrame, at: str, every: str | None = None, hours: float = 48, **how) -> StreamingQuery:
    """Leader clusters of a stream of vectors (id, embedding, ts, document): each batch meets what is still live of those before."""
    log = cluster_log(items.sparkSession, at)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        oldest = batch.agg(F.min("ts")).first()[0]
        old = log.table(batch_id, _first_day(oldest, hours)).drop("is_duplicate")
        live = old if oldest is None else old.filter(F.col("ts") >= oldest - hours * 3600)
        got = kept(assign(batch, live, hours=hours, **how), "assigned")  # it is read twice
        log.put(added(live, batch, got).join(got.select("id", "is_duplicate"), "id").select(*log_columns), batch_id)
        batch.unpersist()

    log_columns = ["id", "embedding", "ts", "cluster_id", "reference", "is_duplicate"]
    return start(items, at, step, every)


def clustered(items: DataFrame, at: str | None = None, **how) -> DataFrame:
    """Drain a stream of vectors; id, cluster_id, is_duplicate."""
    at = at or new_path(items.sparkSession, "clusters")
    cluster_job(items, at, **how).awaitTermination()
    return cluster_log(items.sparkSession, at).table().select("id", "cluster_id", "is_duplicate")


# --- Ingest as a whole -------------------------------------------------------------------------------------------------

NEWS = "id long, source_type string, source_name string, external_id string, content string, document string, published_at timestamp_ntz, trend_id long"
ARRIVED = "id long, trend_id long, raw_news_id long, timestamp timestamp_ntz"
LIVE_TRENDS = "trend_id long, title string, slug string, message_count long, first_seen timestamp_ntz, last_updated timestamp_ntz, needs_scoring boolean"


class Ingest:
    """The tables that a stream of polled items keeps up to date, all in logs below one folder.

    A batch is cleaned, rid of what was seen before, embedded, clustered against the live vectors, and written as news,
    arrivals, vectors and trends. Each of these reads only what earlier batches wrote, so a repeated batch writes the same.
    """

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark = spark
        self.news, self.arrivals = Days(spark, f"{at}/news", NEWS, F.col("published_at")), Days(spark, f"{at}/arrivals", ARRIVED, F.col("timestamp"))
        self.vectors = Days(spark, f"{at}/vectors", STATE, _by_seconds("ts"))
        # later snapshots of a trend carry the sums of the earlier ones
        self.trends = Log(spark, f"{at}/trends", LIVE_TRENDS, lambda rows: latest(rows, "trend_id", ["message_count"], [c.split()[0] for c in LIVE_TRENDS.split(", ")[1:]]))

    def step(self, batch: DataFrame, batch_id: int, hours: float = 48, **how) -> None:
        stamp = F.unix_micros(F.col("published_at").cast("timestamp")) / 1e6
        ids = F.xxhash64(F.coalesce("external_id", "document"), "published_at").alias("id")
        first = _first_day(batch.agg(F.min(stamp)).first()[0], hours)
        once = unseen(prepared(batch, self.news.table(batch_id, first)).select(ids, "*"), self.spark.createDataFrame([], "id long"), "id")
        new = kept(once.withColumn("ts", stamp), "polled")
        oldest = new.agg(F.min("ts")).first()[0]
        live = self.vectors.table(batch_id, first)
        live = live if oldest is None else live.filter(F.col("ts") >= oldest - hours * 3600)
        vectors = kept(new.select("id", embed("document").alias("embedding"), "ts", "document"), "embedded")
        got = kept(assign(vectors, live, hours=hours, **how), "assigned")
        news = new.join(got.select("id", F.col("cluster_id").alias("trend_id")), "id")
        self.vectors.put(added(live, vectors, got), batch_id)
        self.arrivals.put(news.select("id", "trend_id", F.col("id").alias("raw_news_id"), F.col("published_at").alias("timestamp")), batch_id)
        touched = news.select("trend_id").distinct()
        old = self.trends.table(batch_id).join(touched, "trend_id", "left_semi")
        self.trends.put(trends_after(old, news.withColumn("cluster_id", F.col("trend_id"))), batch_id)
        self.news.put(news.select(*(c.split()[0] for c in NEWS.split(", "))), batch_id)


def ingest_job(items: DataFrame, at: str, every: str | None = None, **how) -> StreamingQuery:
    """Ingest a stream of items (source_type, source_name, external_id, content, published_at) into the tables of Ingest(spark, at)."""
    tables = Ingest(items.sparkSession, at)
    return start(items, at, lambda batch, batch_id: tables.step(batch, batch_id, **how), every)
