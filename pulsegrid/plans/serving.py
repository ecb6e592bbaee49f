"""What a trend site asks for: hot list, timeline, search, detail, history, statistics, sitemap, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import lexicons as L
from ..functions import scores as S
from ..functions.text import html_text
from ..operators.index import Index, find
from ..operators.relational import buckets, latest, running, top_of_each
from ..operators.search import matches_stemmed


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def hours_before(now: str, hours: float) -> Column:
    return at(now) - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")


def since_date(column: str, date: str | None) -> Column:
    """A lower bound by calendar day; one that doesn't parse is no bound."""
    day = F.try_to_timestamp(F.lit(date), F.lit("y-M-d")).cast("timestamp_ntz")
    return F.coalesce(F.col(column) >= day, F.lit(True)) if date else F.lit(True)


def hidden(title: Column, words: list[str]) -> Column:
    """Titles with one of the words, or none at all (null), do not pass."""
    keep = F.lit(True)
    for w in words:
        keep &= ~title.ilike(f"%{w}%")
    return keep


def shown(trends: DataFrame, news: DataFrame) -> DataFrame:
    """The fields of a list entry, with the latest source of each trend. The few trends listed are what the news are looked up for."""
    newest = latest(news.join(F.broadcast(trends.select(F.col("id").alias("trend_id")).distinct()), "trend_id", "left_semi"), "trend_id", ["published_at", "id"], ["source_name"])
    t = trends.join(newest, F.col("trend_id") == trends["id"], "left")
    return t.select(
        trends["id"], D.canonical(trends["id"], F.col("slug"), F.col("cluster_id")).alias("link"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("category", F.lit("Gündem")).alias("category"), F.round(F.coalesce(F.nullif("final_tps", F.lit(0.0)), F.col("score")), 1).alias("score"),
        F.coalesce(F.nullif("message_count", F.lit(0)), F.lit(1)).alias("message_count"), D.iso(F.col("last_updated")).alias("last_updated"), D.iso(F.col("first_seen")).alias("first_seen"),
        F.coalesce("source_name", F.lit("Bilinmiyor")).alias("source"),
    )


def listed(trends: DataFrame, category: str = "All", query: str | None = None, date: str | None = None, date_column: str = "last_updated", index: Index | None = None) -> DataFrame:
    """Active trends; of those that a query asks for, all whose title has the stems of its words: by an index of titles by id where there is one, else by looking at the titles left."""
    t = trends.filter("is_active")
    if category != "All":
        t = t.filter(F.col("category") == category)
    if query:
        t = t.join(find(t.sparkSession, index, query).withColumnRenamed("key", "id"), "id", "left_semi") if index else t.filter(matches_stemmed(F.col("title"), query))
    return t.filter(since_date(date_column, date))


def hot(trends: DataFrame, news: DataFrame, now: str, hours: float = 24, limit: int = 8, hide: list[str] = L.HIDDEN, **filters) -> DataFrame:
    """The strongest recent trends. The cut comes before the look-up of sources, so that takes a few rows only."""
    t = listed(trends, **filters).filter((F.col("last_updated") >= hours_before(now, hours)) & hidden(F.col("title"), hide))
    return shown(t.orderBy(F.col("final_tps").desc_nulls_first(), F.col("last_updated").desc_nulls_first(), "id").limit(limit), news)


def timeline(trends: DataFrame, news: DataFrame, offset: int = 0, limit: int = 32, **filters) -> DataFrame:
    t = listed(trends, date_column="first_seen", **filters)
    return shown(t.orderBy(F.col("first_seen").desc_nulls_first(), "id").offset(offset).limit(limit), news)


def more(page: DataFrame, limit: int = 32) -> DataFrame:
    """listed, more: how many entries a page has, and whether to offer the next one, which is so unless the page is shorter than asked for."""
    return page.agg(F.count(F.lit(1)).alias("listed")).select("listed", (F.col("listed") >= limit).alias("more"))


def bot_top(trends: DataFrame, limit: int = 5, pending: str = "...") -> DataFrame:
    """place, id, line: the strongest active trends as the bot lists them."""
    top = trends.filter("is_active").orderBy(F.col("final_tps").desc_nulls_first(), "id").limit(limit)
    place = F.row_number().over(Window.orderBy(F.col("final_tps").desc_nulls_first(), "id"))  # ``limit`` rows
    line = F.concat_ws("", F.col("place"), F.lit(". <code>"), D.fixed(F.coalesce("final_tps", F.lit(0.0)), 1), F.lit("</code> | "), F.coalesce(D.full(F.col("title")), F.lit(pending)))
    return top.withColumn("place", place).select("place", "id", line.alias("line"))


def detail(news: DataFrame, k: int = 20) -> DataFrame:
    """trend_id and its newest items as an array of structs."""
    top = top_of_each(news, "trend_id", [F.col("published_at").desc_nulls_first(), F.col("id").desc()], k)
    item = F.struct("rn", F.col("source_name").alias("source"), D.iso(F.col("published_at")).alias("time"), html_text(F.col("content")).alias("content"), D.link(F.col("external_id")).alias("link"))
    return top.groupBy("trend_id").agg(F.array_sort(F.collect_list(item)).alias("news_list"))


def context(news: DataFrame, k: int = 15, chars: int = 1000) -> DataFrame:
    """trend_id and its first items joined into one text, as input for a summary."""
    top = top_of_each(news, "trend_id", [F.col("id")], k)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.concat(F.lit("- "), F.left("content", F.lit(chars))).alias("x")))), lambda s: s["x"])
    return top.groupBy("trend_id").agg(F.array_join(lines, "\n").alias("context"))


def history(arrivals: DataFrame, now: str, hours: float = 48) -> DataFrame:
    """trend_id, bucket, label, n, total: five-minute counts of the last hours and their running sum."""
    live = arrivals.filter(F.col("timestamp") >= hours_before(now, hours))
    out = running(buckets(live, key="trend_id"), "n", "bucket", "trend_id", "total")
    return out.select("trend_id", "bucket", F.date_format("bucket", "HH:mm").alias("label"), "n", "total")


def zero_padded(series: DataFrame) -> DataFrame:
    """A single point gets a zero before it, so that a chart has a line."""
    lone = series.groupBy("trend_id").agg(F.count(F.lit(1)).alias("points")).filter("points = 1")
    zero = lone.select("trend_id", F.lit("").alias("label"), F.lit(0).cast("long").alias("total"))
    return series.select("trend_id", "label", "total").unionByName(zero)


def stats(news: DataFrame, trends: DataFrame, now: str) -> DataFrame:
    """Totals in one row: all news, those of the last day, active trends."""
    n = news.agg(F.count(F.lit(1)).alias("total_news"), F.count_if(F.col("published_at") >= hours_before(now, 24)).alias("day_news"))
    return n.crossJoin(trends.agg(F.count_if("is_active").alias("active_trends")))  # one row and one row


def worker_status(trends: DataFrame, now: str, seconds: int = 600) -> DataFrame:
    age = S.minutes(F.max("last_updated"), at(now)) * 60
    return trends.agg(F.max("last_updated").alias("last_update"), F.when(age < seconds, "Active").otherwise("Idle/Offline").alias("worker_status"))


def sitemap(trends: DataFrame, base_url: str, limit: int = 3000) -> DataFrame:
    """One line to an active trend, the most recently updated first."""
    t = trends.filter("is_active AND last_updated IS NOT NULL").orderBy(F.col("last_updated").desc(), "id").limit(limit)
    loc = D.xml(F.concat(F.lit(f"{base_url}/trend/"), D.canonical(F.col("id"), F.col("slug"), F.col("cluster_id"))))
    line = F.format_string("  <url><loc>%s</loc><lastmod>%s</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url>", loc, F.date_format("last_updated", "yyyy-MM-dd"))
    return t.select("id", line.alias("line"))


def category_lines(spark, base_url: str, categories: list[str] = L.CATEGORIES) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in categories], "category string")
    return rows.select(F.format_string("  <url><loc>%s/category/%s</loc><changefreq>daily</changefreq><priority>0.9</priority></url>", F.lit(base_url), F.lower("category")).alias("line"))


def sitemap_document(trends: DataFrame, base_url: str, limit: int = 3000) -> DataFrame:
    """place, line: the sitemap as it is delivered, in order of place (part, number within it)."""
    spark = trends.sparkSession
    fixed = ['<?xml version="1.0" encoding="UTF-8"?>', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', f"  <url><loc>{base_url}/</loc><changefreq>always</changefreq><priority>1.0</priority></url>"]
    place = lambda part, n: F.struct(F.lit(part).alias("part"), n.cast("long").alias("n")).alias("place")
    head = spark.createDataFrame(list(enumerate(fixed)), "n long, line string").select(place(0, F.col("n")), "line")
    own = category_lines(spark, base_url).select(place(1, F.row_number().over(Window.orderBy("line"))), "line")  # a few categories
    lines = sitemap(trends, base_url, limit).withColumn("n", F.monotonically_increasing_id()).select(place(2, F.col("n")), "line")
    end = spark.createDataFrame([("</urlset>",)], "line string").select(place(3, F.lit(0)), "line")
    return head.unionByName(own).unionByName(lines).unionByName(end)


def related_trends(found: DataFrame, trends: DataFrame) -> DataFrame:
    """query_id, rank, distance and the active trends of the related clusters (query_id, cluster_id, rank), but not the query itself."""
    active = trends.filter("is_active").select("id", "cluster_id", "slug", "title")
    return found.join(active, "cluster_id").filter(F.col("id") != F.col("query_id"))


def detail_page(news: DataFrame, found: DataFrame, trends: DataFrame, k: int = 20) -> DataFrame:
    """id, news_list and related, an array in order of nearness: what a detail page shows of each trend."""
    near = related_trends(found, trends).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "slug", "title"))).alias("related"))
    rows = trends.select("id").join(detail(news, k), F.col("id") == F.col("trend_id"), "left").drop("trend_id")
    return rows.join(near, F.col("id") == F.col("query_id"), "left").drop("query_id")


def scoring_queue(trends: DataFrame, limit: int = 50) -> DataFrame:
    return trends.filter("needs_scoring AND is_active").orderBy("id").limit(limit)


def summary_queue(trends: DataFrame, limit: int | None = 5, least: float = 20) -> DataFrame:
    """The strongest active trends that have no summary, or all of those where limit is null."""
    t = trends.filter(F.col("is_active") & (F.col("final_tps") >= least) & (F.col("summary").isNull() | (F.col("summary") == "")))
    return t if limit is None else t.orderBy(F.col("final_tps").desc_nulls_first(), "id").limit(limit)


def admin_list(trends: DataFrame, limit: int = 100) -> DataFrame:
    t = trends.orderBy(F.col("last_updated").desc_nulls_first(), "id").limit(limit)
    return t.select("id", F.coalesce(D.full(F.col("title")), F.lit("...")).alias("title"), F.round(F.coalesce("final_tps", F.lit(0.0)), 1).alias("tps"), F.coalesce(F.date_format("last_updated", "HH:mm"), F.lit("-")).alias("time"), "is_active", (F.col("final_tps") > 30).alias("strong"))


def resolved(identifiers: DataFrame, trends: DataFrame) -> DataFrame:
    """identifier, id: by the number that leads it if there is such a trend, else by slug or cluster. Three equi-joins, no disjunction."""
    digits = F.coalesce(F.nullif(F.regexp_extract("identifier", r"^(\d+)-", 1), F.lit("")), F.nullif(F.regexp_extract("identifier", r"^(\d+)$", 1), F.lit("")))
    i = identifiers.withColumn("number", digits.try_cast("long"))
    least = lambda key, name: trends.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_{key}")).agg(F.min("id").alias(name))
    out = i.join(least("id", "by_id"), F.col("number") == F.col("_id"), "left").join(least("slug", "by_slug"), F.col("identifier") == F.col("_slug"), "left").join(least("cluster_id", "by_cluster"), F.col("identifier") == F.col("_cluster_id"), "left")
    numeric = F.col("identifier").rlike(r"^\d+$")
    return out.select("identifier", F.coalesce("by_id", F.when(~numeric, F.least("by_slug", "by_cluster"))).alias("id"))


def log_summary(log: DataFrame) -> DataFrame:
    """Processed, success rate, mean tokens (cut to whole), total cost: costs that are no numbers are skipped."""
    mean = F.avg("input_tokens") + F.avg("output_tokens")
    return log.agg(F.count(F.lit(1)).alias("processed"), F.round(100 * F.count_if(F.col("status") == "Success") / F.count(F.lit(1)), 1).alias("success_rate"), F.floor(mean).cast("long").alias("avg_tokens"), F.round(F.sum(F.col("cost_usd").try_cast("double")), 4).alias("total_cost"))


def log_categories(log: DataFrame) -> DataFrame:
    return log.filter("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "category")


def alerts(scored: DataFrame) -> DataFrame:
    """Trends that have just come to the alert threshold, with the message for the administrator."""
    t = scored.filter(S.crosses(F.col("final_tps"), F.col("previous_tps")))
    return t.select("id", "final_tps", "previous_tps", D.alert(F.coalesce(D.full(F.col("title")), F.lit("?")), F.col("final_tps"), F.col("trajectory")).alias("message"))


def gold(df: DataFrame, path: str) -> None:
    """A served list as a table of JSON lines, refreshed as a whole by whatever triggers it: the cache of the pages."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
