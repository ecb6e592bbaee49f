"""A keyed table on storage, in folders by a hash of the key: a write replaces the folders that hold what it changes, and no other."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import children, fresh, kept, names, remove, touch

#: Changes of so many rows at most go to every task; a task of a shuffle puts about so many rows of a part in order.
FEW, ROWS = 10_000, 500_000


class Snapshot:
    """The latest row of each key, in ``parts`` folders. Writes carry a rising number, and number -1 is the table as it was first given.

    A write puts the parts that it changes into new folders and then says that it is done, so that a reader sees all of it or nothing, and files of other
    parts keep their names. A write that is repeated starts from what was before its number. Of each part the last two versions stay. Rows of a change that have the
    same key come to the one of the greatest hash; a null key is a key.
    """

    def __init__(self, spark: SparkSession, top: str, schema: StructType, key: str = "id", parts: int = 64) -> None:
        self.spark, self.top, self.schema, self.key, self.parts = spark, top.rstrip("/"), schema, key, parts
        self.part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def done(self) -> int | None:
        """The greatest number of a finished write."""
        return max(map(int, names(self.spark, f"{self.top}/done")), default=None)

    def folders(self, before: int | None = None) -> dict[int, str]:
        """The folder of each part that holds rows, as the table stood before a number, or stands."""
        last = self.done()
        upto = -2 if last is None else last if before is None else before - 1
        out = {}
        for n in names(self.spark, f"{self.top}/data"):
            versions = [int(v.partition("=")[2]) for v in names(self.spark, f"{self.top}/data/{n}") if v.startswith("_at=")]
            live = [v for v in versions if v <= upto]
            if live and n.startswith("_part="):
                out[int(n.partition("=")[2])] = f"{self.top}/data/{n}/_at={max(live)}"
        return out

    def table(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows, or those of some parts."""
        paths = [p for k, p in sorted(self.folders(before).items()) if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def of(self, ids: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of some keys, from their parts only."""
        return self.table(before, self._parts_of(ids)).join(ids.select(self.key).distinct(), self.key, "left_semi").select(*self.schema.names)

    def _parts_of(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self.part).distinct().collect()]  # at most ``parts`` numbers

    def put(self, changes: DataFrame, number: int) -> None:
        """Insert or replace the rows that changes holds, with all columns. Changes are made once: what they observe is counted once.

        A few changes of rows that are there are put in their places, in the files as they are; else the parts are shuffled, once, with what changes them.
        """
        rows = kept(changes.select(*self.schema.names), "changes")
        counts = {r[0]: r[1] for r in rows.groupBy(self.part.alias("_part")).count().collect()}  # at most ``parts`` rows
        parts, n = sorted(counts), sum(counts.values())
        remove(self.spark, f"{self.top}/data/_part=*/_at={number}")
        old = self.table(number, parts)
        if parts:
            new = self._replaced(old, rows) if n <= FEW else None
            new = self._merged(old, rows, -(-(n + old.count()) // (len(parts) * ROWS))) if new is None else new
            self._write(new.select(*self.schema.names).withColumns({"_part": self.part, "_at": F.lit(number)}))
        touch(self.spark, f"{self.top}/done/{number}")
        for n in names(self.spark, f"{self.top}/done"):
            if int(n) < number:
                remove(self.spark, f"{self.top}/done/{n}")
        for p in parts:
            versions = sorted(int(v.partition("=")[2]) for v in names(self.spark, f"{self.top}/data/_part={p}") if v.startswith("_at="))
            for v in versions[:-2]:
                remove(self.spark, f"{self.top}/data/_part={p}/_at={v}")

    def _last(self, rows: DataFrame, first: list[str], order: list[Column]) -> DataFrame:
        """Of each key the first row by order and by the greatest hash; ``first`` are columns that the key decides, by which the rows may be dealt out already."""
        place = fresh(rows, "_place")
        w = Window.partitionBy(*first, self.key).orderBy(*order, F.xxhash64(*self.schema.names).desc())
        return rows.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1)

    def _replaced(self, old: DataFrame, rows: DataFrame) -> DataFrame | None:
        """The old rows with a few changes in their places, or None where one has no place yet. No old row leaves its task."""
        rows, new = self._last(rows, [], []), fresh(old, "_new")
        rows = F.broadcast(rows.select(F.struct(*self.schema.names).alias(new)))  # at most FEW rows
        met = F.col(self.key).eqNullSafe(F.col(f"{new}.{self.key}"))
        if old.join(rows, met, "left_semi").count() < rows.count():
            return None
        return old.join(rows, met, "left").select(*(F.when(F.col(new).isNotNull(), F.col(f"{new}.{c}")).otherwise(F.col(c)).alias(c) for c in self.schema.names))

    def _merged(self, old: DataFrame, rows: DataFrame, slices: int) -> DataFrame:
        """Old and new rows shuffled once, by part and by slices of the key; of each key the new row where there is one."""
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        both = both.withColumns({"_part": self.part, "_slice": F.pmod(F.hash(self.key), F.lit(max(1, slices)))}).repartition("_part", "_slice")
        return self._last(both, ["_part", "_slice"], [F.col("_new").desc()])

    def _write(self, rows: DataFrame) -> None:
        """Append by part. A task holds few parts, so their files are open side by side, and nothing is sorted for them."""
        conf, key = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
        before = conf.get(key)
        conf.set(key, str(self.parts))
        try:
            rows.write.mode("append").partitionBy("_part", "_at").parquet(f"{self.top}/data")
        finally:
            conf.set(key, before)


def served(spark: SparkSession, path: str, make: Callable[[], DataFrame], seconds: float, now: float | None = None) -> DataFrame:
    """A served list as JSON lines (value), made anew once what is stored is older than so many seconds: 120 for lists, 600 for details, 60 for histories.

    A list is written to a folder of its own time and read by whoever asks until it expires; the one before stays for readers that are still at it. A list that
    wasn't written to its end isn't served.
    """
    now = time.time() if now is None else now
    stored = sorted(int(n) for n in children(spark, path))
    if not stored or now * 1000 - stored[-1] >= seconds * 1000:
        made = int(now * 1000)
        make().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{made}")
        for old in stored[:-1]:
            remove(spark, f"{path}/{old}")
        stored.append(made)
    return spark.read.schema("value string").text(f"{path}/{stored[-1]}")
