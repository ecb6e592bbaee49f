"""The star-schema tables under the engine's names. SQL for both engines comes from one text where they agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import xml
from ..functions.scores import tier

#: 'now' of the fixtures: just after the last order, and after the last event.
ORDERS_NOW, EVENTS_NOW = "2001-08-02 00:00:00", "2024-01-31 00:00:00"
TIER_1, TIER_2 = ["src0", "src2"], ["src3", "src4"]

TRENDS_SQL = """
SELECT o_orderkey AS id, concat('cl-', o_orderkey) AS cluster_id,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE concat('order-', o_orderkey) END AS slug,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat(c_mktsegment, ' & ', o_orderpriority, ' No ', o_orderkey) END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Summary of order ', o_orderkey) END AS summary,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS category, CAST(o_orderkey % 7 AS int) AS message_count, o_totalprice / 10000 AS score,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice / 5000 END AS final_tps, o_totalprice / 4000 AS tps_signal, o_orderdate - INTERVAL 1 DAY AS first_seen, o_orderdate AS last_updated,
  o_orderstatus <> 'F' AS is_active, o_orderstatus = 'P' AS needs_scoring, o_custkey AS custkey
FROM orders JOIN customer ON o_custkey = c_custkey
"""
NEWS_SQL = """
SELECT doc_id AS id, 'rss' AS source_type, source AS source_name,
  CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 2 = 0 THEN concat('https://example.com/', doc_id) ELSE concat('example.com/', doc_id) END AS external_id,
  text AS content, ts AS published_at, user_id AS trend_id
FROM documents JOIN events ON doc_id = event_id
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRENDS_SQL.replace("FROM orders JOIN customer", "FROM {o} JOIN {c}"), o=table(spark, sf_dir, "orders"), c=table(spark, sf_dir, "customer"))


def raw_news(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """All news, or those of some events."""
    news = spark.sql(NEWS_SQL.replace("FROM documents JOIN events", "FROM {d} JOIN {e}"), d=table(spark, sf_dir, "documents"), e=table(spark, sf_dir, "events") if events is None else events)
    return news.withColumn("source_tier", tier(F.col("source_name"), TIER_1, TIER_2))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("trend_id"), F.col("event_id").alias("raw_news_id"), F.col("ts").alias("timestamp"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster_id"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("l_orderkey").alias("trend_id"), F.lit("m").alias("model"), (F.col("l_quantity") * 2).cast("long").alias("input_tokens"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("output_tokens"), F.col("l_discount").alias("duration_sec"), F.when(F.col("l_linestatus") == "O", "Spor").alias("category"),
        F.when(F.col("l_returnflag") == "N", "Success").otherwise("Failed").alias("status"), F.when(F.col("l_returnflag") == "R", "bad").otherwise(F.col("l_tax").cast("string")).alias("cost_usd"), F.col("l_linenumber").alias("line"),
    )


def feed_bodies(spark: SparkSession, sf_dir: str, each: int = 40) -> DataFrame:
    """All documents, whole, as feeds (source_name, body) of up to so many items: what polls would have fetched."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")
    item = F.concat(F.lit("<item><title>"), xml(text), F.lit("</title><description>"), F.repeat(F.lit("x"), (F.col("doc_id") % each).cast("int")), F.lit("</description><link>https://example.com/"), F.floor(F.col("doc_id") / 2), F.lit("</link></item>"))
    own = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / each).alias("feed"), item.alias("item"))
    bodies = own.groupBy("feed").agg(F.array_join(F.collect_list("item"), "").alias("items"))  # at most ``each`` documents a feed
    return bodies.select(F.concat(F.lit("f"), "feed").alias("source_name"), F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("body"))
