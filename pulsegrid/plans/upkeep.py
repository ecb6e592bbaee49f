"""Writes as new snapshots: switching trends on and off, emptying tables, and one pass of the scoring worker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import full
from ..tables import kept
from .scoring import scored
from .serving import alerts, at, scoring_queue


def _changed(trends: DataFrame, ids: DataFrame, active: Column) -> DataFrame:
    """The next snapshot, with another is_active for the trends that ids (id) names; unknown and repeated ids change nothing more."""
    named = ids.select(F.col("id").alias("_id")).distinct().withColumn("_named", F.lit(True))
    out = trends.join(named, F.col("id") == F.col("_id"), "left")
    return out.withColumn("is_active", F.when(F.col("_named"), active).otherwise(F.col("is_active"))).select(*trends.columns)


def toggled(trends: DataFrame, ids: DataFrame) -> DataFrame:
    """Null counts as not active."""
    return _changed(trends, ids, ~F.coalesce("is_active", F.lit(False)))


def deactivated(trends: DataFrame, ids: DataFrame) -> DataFrame:
    return _changed(trends, ids, F.lit(False))


def deleted(**tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without its rows, and how many there were: name, deleted."""
    counts = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("deleted")) for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return {name: t.limit(0) for name, t in tables.items()}, out


def scoring_pass(trends: DataFrame, arrivals: DataFrame, news: DataFrame | Callable[[DataFrame], DataFrame], similarity: Callable[[DataFrame], DataFrame], models: DataFrame, now: str, limit: int = 50, changed_only: bool = False, **lists) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of trends (or its changed rows only) after up to ``limit`` waiting ones are scored, and the alerts that this gives rise to.

    The inputs are cut to the waiting trends first, so that a pass costs what they have, not what all trends have: similarity is a function
    that is called with their ids (trend_id) and gives trend_id, similarity; news may be one as well, where what makes them is better cut before it is joined. A trend without any text keeps its scores and goes on waiting. An
    alert compares the new score with the previous_tps that stands in trends, which is two passes old.
    """
    queue = kept(scoring_queue(trends, limit), "queue")
    waiting = queue.select(F.col("id").alias("trend_id"))
    own = lambda df: df(waiting) if callable(df) else df.join(F.broadcast(waiting), "trend_id", "left_semi")  # noqa: E731  # at most ``limit`` rows
    new = scored(queue, own(arrivals), own(news), similarity(waiting), own(models), **lists)
    columns = ["tps_signal", "tps_confidence", "final_tps", "previous_tps", "trajectory", "needs_scoring", "score", "last_updated"]
    new = new.withColumnRenamed("confidence", "tps_confidence").withColumns({"score": F.col("final_tps"), "last_updated": at(now)})
    new = kept(new.select(F.col("trend_id").alias("_id"), F.left("reference", F.lit(60)).alias("_head"), *(F.col(c).alias(f"_{c}") for c in columns)), "scored")
    both = trends.join(F.broadcast(new), F.col("id") == F.col("_id"), "inner" if changed_only else "left")  # at most ``limit`` rows
    known = lambda c: F.col(c) if c in trends.columns else F.lit(None)
    after = {c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(known(c)) for c in columns}
    snapshot = both.withColumns(after).drop("_id", "_head", *(f"_{c}" for c in columns))
    title = F.coalesce(full(F.col("title")), F.col("_head"))
    scored_now = both.filter("_id IS NOT NULL").select("id", title.alias("title"), F.col("_final_tps").alias("final_tps"), known("previous_tps").cast("double").alias("previous_tps"), F.col("_trajectory").alias("trajectory"))
    return snapshot, alerts(scored_now)
