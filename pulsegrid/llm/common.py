"""What the operators of this subpackage share: inputs, written tables, distributed ranks.

No function here collects rows to the driver. Tables are written with Spark's own writers to the folder
that the session names in ``spark.checkpoint.dir``, which all executors share, so that a lost executor
costs only the tasks it was running.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process, as in tests.
LOCAL_DIR = "/tmp/checkpoints"

#: A word, in Java's and Python's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All that separates words once A-Z are lowered: ASCII but for digits and small letters.
_GAPS = "".join(chr(c) for c in range(128) if chr(c) not in _LOWER and not chr(c).isdigit())
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (found or LOCAL_DIR).rstrip("/")


def stash(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: lineage ends there, and its size is known."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {"compression": "zstd"})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the table behind a frame that stash() gave, once nothing reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have yet (names compare without case)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond &= left[k].eqNullSafe(right[k])
    return cond


def ranked(df: DataFrame, groups: list[str], order: list[str], rank: str, name: str) -> DataFrame:
    """Add ``rank``: 0, 1, ... within groups by order, without bringing a group into one task.

    Rows are range-partitioned by group and order together, so a group of any size is cut over as many
    partitions as its rows fill. The row number inside a sorted partition comes from
    monotonically_increasing_id (partition above bit 33, row below it); only one row per partition and group
    is then summed over partitions. Rows that are equal in groups and order rank in any order among themselves.
    """
    at, part, first, n, base = (fresh(df, x) for x in ("_at", "_part", "_first", "_n", "_base"))
    keys = [F.col(c) for c in (*groups, *order)]
    rows = stash(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), name)
    rows = rows.withColumns({part: F.shiftright(at, 33), at: F.col(at).bitwiseAND(F.lit((1 << 33) - 1))})
    runs = rows.groupBy(part, *groups).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = stash(runs.withColumn(base, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).drop(first, n), f"{name}-runs")
    out = rows.join(runs, same(rows, runs, [part, *groups]))
    return out.select(*(rows[c] for c in df.columns), (rows[at] + runs[base]).alias(rank))


def lowered(text: Column) -> Column:
    """A-Z only; lower() says the same of a text that is all ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def plain_words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z lowered) and all beyond ASCII, in order; null where there are none."""
    bare = F.btrim(lowered(text), F.lit(_GAPS))
    return F.when(bare != "", F.split(bare, _GAP))
