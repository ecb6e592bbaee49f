"""From arrivals, news, similarities and model scores to a trend's final score, course and decay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import is_junk
from ..operators.relational import accelerations, confidences, latest, speeds
from .serving import at

MIN_TPS, DEAD_TPS = 3.0, 2.0


def reference_texts(news: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """trend_id, reference: the cluster's tagged reference, else another of its documents, else the trend's first item."""
    first = latest(news.withColumn("_age", -F.col("id")), "trend_id", ["_age"], ["content"]).select("trend_id", F.col("content").alias("first_text"))
    if vectors is None:
        return first.select("trend_id", F.col("first_text").alias("reference"))
    v = vectors.withColumns({"_tag": F.col("is_reference").cast("int"), "_age": -F.col("timestamp")})
    tagged = latest(v, "trend_id", ["_tag", "_age"], ["document"])
    return tagged.join(first, "trend_id", "full_outer").select("trend_id", F.coalesce("document", "first_text").alias("reference"))


def model_scores(json: DataFrame, key: str = "trend_id", column: str = "response") -> DataFrame:
    """entity, criticality, opinion from a model's JSON; 30, 30, false where a field, or all of it, can't be read. A list counts by its first element."""
    fields = "entity_score double, criticality_score double, is_opinion boolean"
    first = F.try_element_at(F.from_json(column, f"array<struct<{fields}>>"), F.lit(1))
    parsed = F.when(F.ltrim(column).startswith("["), first).otherwise(F.from_json(column, fields))
    return json.select(key, F.coalesce(parsed["entity_score"], F.lit(30.0)).alias("entity"), F.coalesce(parsed["criticality_score"], F.lit(30.0)).alias("criticality"), F.coalesce(parsed["is_opinion"], F.lit(False)).alias("opinion"))


def scored(trends: DataFrame, arrivals: DataFrame, news: DataFrame, similarity: DataFrame, models: DataFrame, vectors: DataFrame | None = None, **lists) -> DataFrame:
    """trends (id, title, final_tps as before) with all signals and their new scores.

    Four aggregates by trend, each of which combines before its shuffle, meet the trends in left joins on the same key; the rest is
    projection. A trend without any reference text stays as it was, and is left out.
    """
    t = trends.withColumnRenamed("id", "trend_id")
    for part in (speeds(arrivals).select("trend_id", "n", "velocity"), accelerations(arrivals), confidences(news).select("trend_id", "confidence"), similarity, models):
        t = t.join(part, "trend_id", "left")
    t = t.join(reference_texts(news, vectors), "trend_id").filter("reference IS NOT NULL")
    t = t.withColumns({"velocity": F.coalesce("velocity", F.lit(0.0)), "confidence": F.coalesce("confidence", F.lit(0.5)), "novelty": S.novelty(F.col("similarity")), "boost": S.boost(F.col("reference"), **lists)})
    entity, criticality = F.coalesce("entity", F.lit(30.0)), F.coalesce("criticality", F.lit(30.0))
    t = t.withColumn("tps_signal", S.signal(F.col("velocity"), entity, criticality, F.col("novelty"), F.col("boost")))
    t = t.withColumn("new_tps", S.final(F.col("tps_signal"), F.col("confidence"), is_junk(F.col("title"), F.col("reference")), F.coalesce("opinion", F.lit(False))))
    t = t.withColumn("trajectory", S.trajectory(F.col("new_tps"), F.coalesce("final_tps", F.lit(0.0)), F.col("acceleration")))
    return t.select("trend_id", "velocity", "acceleration", "novelty", "boost", "confidence", "tps_signal", F.coalesce("final_tps", F.lit(0.0)).alias("previous_tps"), F.col("new_tps").alias("final_tps"), "trajectory", F.lit(False).alias("needs_scoring"), "reference")


def decay(trends: DataFrame, now: str, factors: dict[str, float], other: float) -> DataFrame:
    """One step of gravity: active trends above 3 that are at least an hour old fade; those that fall below 2 are closed."""
    hours = S.minutes(F.col("last_updated"), at(now)) / 60
    due = F.col("is_active") & (F.col("final_tps") > MIN_TPS) & (hours >= 1)
    new = F.when(due, S.decayed(F.col("final_tps"), F.col("category"), hours, factors, other)).otherwise(F.col("final_tps"))
    out = trends.withColumns({"decayed": F.coalesce(due, F.lit(False)), "new_tps": new})
    return out.withColumn("is_active", F.when(F.col("decayed") & (F.col("new_tps") < DEAD_TPS), False).otherwise(F.col("is_active")))


def rollup(arrivals: DataFrame) -> DataFrame:
    """Trends as their arrivals make them: how many, first and last."""
    return arrivals.groupBy("trend_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_updated"))
