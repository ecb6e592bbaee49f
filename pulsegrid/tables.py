"""Tables between steps: written by Spark to the folder that all executors share, and read back; ranks without one-task windows."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process, as in tests.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or LOCAL_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table and read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def is_folder(spark: SparkSession, path: str) -> bool:
    at, store = _store(spark, path)
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    at, store = _store(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables in a folder that were written to their end."""
    return [n for n in names(spark, path) if is_written(spark, f"{path}/{n}")]


def remove(spark: SparkSession, pattern: str) -> None:
    """Delete the folders that a pattern names."""
    at, store = _store(spark, pattern)
    for found in store.globStatus(at) or []:
        store.delete(found.getPath(), True)


def touch(spark: SparkSession, path: str) -> None:
    at, store = _store(spark, path)
    store.create(at, True).close()


def is_written(spark: SparkSession, path: str) -> bool:
    at, store = _store(spark, f"{path}/_SUCCESS")
    return store.exists(at)


def numbered(df: DataFrame, group: str, order: str, rank: str, name: str) -> DataFrame:
    """Add ``rank``: 0, 1, ... within a group by order, also where one group holds most rows.

    A group is cut over as many range partitions as its rows fill. Rows are counted within sorted partitions, and only
    one row a partition and group is summed over partitions.
    """
    at, part, first, n, base, own = (fresh(df, x) for x in ("_at", "_part", "_first", "_n", "_base", "_group"))
    keys = [F.col(group), F.col(order)]
    rows = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), name)
    rows = rows.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    runs = rows.groupBy(part, group).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = kept(runs.select(part, F.col(group).alias(own), (F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).alias(base)), f"{name}-runs")
    out = rows.join(runs, (rows[part] == runs[part]) & rows[group].eqNullSafe(runs[own]))
    return out.select(*(rows[c] for c in df.columns), (rows[at] + runs[base]).alias(rank))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
