"""Source lists (name,url lines), channel lists, the monitoring log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest
from ..schema import struct


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines with their place, without blank ones and comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("place"))
    return rows.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def source_list(rows: DataFrame) -> DataFrame:
    """name, url: split at the first comma; of equal names the last line counts; lines without a comma don't."""
    parts = F.split("line", ",", 2)
    named = rows.filter(F.size(parts) == 2).select(F.trim(parts[0]).alias("name"), F.trim(parts[1]).alias("url"), "place")
    return latest(named, "name", ["place"], ["url"]).select("name", "url")


def channel_list(rows: DataFrame) -> DataFrame:
    """Distinct channel names, without any @."""
    return rows.select(F.replace("line", F.lit("@"), F.lit("")).alias("channel")).filter("channel <> ''").distinct()


def monitor_log(spark: SparkSession, path: str) -> DataFrame:
    """The cost log; broken fields read as null, and a folder that isn't there as an empty log."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.csv(path, schema=struct("log"), header=True, mode="PERMISSIVE")
    except AnalysisException:
        return spark.createDataFrame([], struct("log"))


def write_log(rows: DataFrame, path: str) -> None:
    """Append rows of the log with their cost to eight digits."""
    from ..functions.display import fixed
    from ..functions.scores import cost

    out = rows.withColumn("cost_usd", fixed(cost(F.col("input_tokens"), F.col("output_tokens")), 8))
    out.select(*struct("log").names).write.mode("append").csv(path, header=True)


def best_model(names: DataFrame, fallback: str) -> DataFrame:
    """The model to use of those on offer: a light flash model, else a stable 1.5 one, else the first flash model, else the fallback."""
    low = F.lower("name")
    fit = names.withColumn("name", F.replace("name", F.lit("models/"), F.lit(""))).filter(low.contains("flash") & ~low.contains("image") & ~low.contains("audio"))
    n = F.col("name")
    order = F.when(n.contains("lite") & n.contains("flash"), 1).when(n.contains("1.5-flash") & ~n.contains("latest"), 2).otherwise(3)
    return fit.withColumn("_order", order).agg(F.coalesce(F.min_by("name", F.struct("_order", "place")), F.lit(fallback)).alias("name"))
