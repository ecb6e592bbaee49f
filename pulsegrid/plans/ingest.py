"""From polled items to news, arrivals, trends and vectors: clean, guard, deduplicate, embed, cluster, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, first_slug
from ..operators.relational import unseen, upsert
from ..operators.vectors import assign
from ..udfs import embed

SHORTEST = 25


def prepared(items: DataFrame, seen: DataFrame) -> DataFrame:
    """items (external_id, content, ...) that are new and long enough once cleaned. Cheap tests come first: the model sees what is left."""
    fresh = unseen(items.withColumn("external_id", F.nullif("external_id", F.lit(""))), seen, "external_id")
    return fresh.withColumn("document", clean(F.col("content"))).filter(F.length("document") >= SHORTEST)


def clustered(items: DataFrame, state: DataFrame, **how) -> DataFrame:
    """items (id, ts seconds, document, ...) with cluster_id and is_duplicate."""
    vectors = items.select("id", embed("document").alias("embedding"), "ts", "document")
    return items.join(assign(vectors, state, **how), "id")


def first_title(content: Column) -> Column:
    return F.concat(F.trim(F.left(content, F.lit(70))), F.lit("..."))


def trends_after(old: DataFrame, news: DataFrame) -> DataFrame:
    """The next snapshot of trends (trend_id, title, slug, message_count, first_seen, last_updated, needs_scoring) after some news (cluster_id, content, published_at).

    A new trend takes title and slug from its first item; an old one keeps them, counts on, and waits to be scored again.
    """
    first = F.min_by("content", F.struct("published_at", "id"))
    new = news.groupBy(F.col("cluster_id").alias("trend_id")).agg(first.alias("content"), F.count(F.lit(1)).alias("message_count"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_updated"))
    new = new.select("trend_id", first_title(F.col("content")).alias("title"), first_slug(F.col("content"), empty="haber-detayi").alias("slug"), "message_count", "first_seen", "last_updated", F.lit(True).alias("needs_scoring"))
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
    merge = {"title": keep("title"), "slug": keep("slug"), "first_seen": keep("first_seen"), "last_updated": F.greatest("o.last_updated", "n.last_updated"), "message_count": F.coalesce("o.message_count", F.lit(0)) + F.coalesce("n.message_count", F.lit(0))}
    return upsert(old, new, "trend_id", merge)
