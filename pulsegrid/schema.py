"""Tables of the engine, and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW_NEWS = "id long, source_type string, source_name string, source_tier int, external_id string, content string, published_at timestamp_ntz, created_at timestamp_ntz, trend_id long"
TRENDS = (
    "id long, cluster_id string, slug string, title string, summary string, category string, message_count int, score double, tps_signal double, tps_confidence double, final_tps double, "
    "previous_tps double, trajectory string, needs_scoring boolean, first_seen timestamp_ntz, last_updated timestamp_ntz, is_active boolean"
)
ARRIVALS = "id long, trend_id long, raw_news_id long, timestamp timestamp_ntz"
SETTINGS = "id long, key string, value string, updated_at timestamp_ntz"
VECTORS = "id string, document string, embedding array<float>, source string, cluster_id string, external_id string, timestamp double, is_reference boolean"
LOG = "timestamp string, trend_id long, model string, input_tokens long, output_tokens long, duration_sec double, category string, status string, cost_usd string"
TABLES = {"raw_news": RAW_NEWS, "trends": TRENDS, "trend_arrivals": ARRIVALS, "system_settings": SETTINGS, "vectors": VECTORS, "log": LOG}
DEFAULTS = {"source_tier": 3, "category": "Gündem", "message_count": 1, "score": 0.0, "tps_signal": 0.0, "tps_confidence": 0.0, "final_tps": 0.0, "previous_tps": 0.0, "trajectory": "steady", "needs_scoring": True, "is_active": True}


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def evolve(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """df with the schema's columns, in its order and types: missing ones get their default or null, others go."""
    own, defaults = set(df.columns), DEFAULTS if defaults is None else defaults
    return df.select(*((F.col(f.name) if f.name in own else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def seeded(settings: DataFrame, defaults: dict[str, str], now: str) -> DataFrame:
    """settings with a row for each default whose key isn't there; keys that are there keep their value. New ids follow the greatest."""
    rows = [(i, k, v) for i, (k, v) in enumerate(sorted(defaults.items()), 1)]
    new = settings.sparkSession.createDataFrame(rows, "id long, key string, value string").join(settings.select("key"), "key", "left_anti")
    last = settings.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    new = new.crossJoin(F.broadcast(last)).select((F.col("id") + F.col("_last")).alias("id"), "key", "value", F.lit(now).cast("timestamp_ntz").alias("updated_at"))  # one row
    return settings.select("id", "key", "value", "updated_at").unionByName(new)


def reset(trends: DataFrame) -> DataFrame:
    """Summaries, titles and categories forgotten and scores set to 0; final_tps stays."""
    empty = {c: F.lit(None).cast("string") for c in ("summary", "title", "category")}
    return trends.withColumns(empty | {"score": F.lit(0.0)})
