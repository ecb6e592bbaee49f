"""Latest and first rows of groups, joins by membership, upserts, unique slugs, running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import accelerates, confidence, velocity
from ..tables import fresh, kept, numbered


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """One row to a key: that of the greatest order. An aggregate, so that rows of a hot key combine before the shuffle."""
    best = df.groupBy(key).agg(F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("_best"))
    return best.select(key, *(F.col(f"_best.{c}").alias(c) for c in columns))


def top_of_each(df: DataFrame, key: str, order: list[Column], k: int, rank: str = "rn") -> DataFrame:
    """The first k rows of each key. Spark keeps k rows of a key in each task before the shuffle (window group limit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= k)


def unseen(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key old doesn't have, one to a key: that of the least hash of all columns, however rows are dealt out. A null key is never a duplicate."""
    named, anonymous = new.filter(F.col(key).isNotNull()), new.filter(F.col(key).isNull())
    one = fresh(new, "_one")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*(c for c, t in new.dtypes if not t.startswith("map")))))  # one row a key leaves each task
    return named.join(old.select(key), key, "left_anti").withColumn(one, first).filter(F.col(one) == 1).select(*new.columns).unionByName(anonymous)


def upsert(old: DataFrame, changes: DataFrame, key: str, merge: dict[str, Column]) -> DataFrame:
    """A new snapshot: rows of either side. merge gives a column's value where it isn't just the newer one; o and n name the sides."""
    o, n = old.alias("o"), changes.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    value = lambda c: merge[c] if c in merge else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in changes.columns else F.col(f"o.{c}")
    return joined.select(*(value(c).alias(c) for c in old.columns))


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """The latest value of each key."""
    return latest(settings.unionByName(new), "key", ["updated_at", "id"], ["id", "value", "updated_at"]).select("id", "key", "value", "updated_at")


def setting(settings: DataFrame, key: str, default: float) -> DataFrame:
    """One row with the number behind a key, or the default where there is none, or none that reads as a number."""
    return settings.filter(F.col("key") == key).agg(F.coalesce(F.max(F.col("value").try_cast("double")), F.lit(default)).alias("value"))


def unique_slugs(df: DataFrame, slug: str, order: str) -> DataFrame:
    """slug-1, slug-2, ... for all but the first of equal slugs. A suffixed slug that another row has by nature gets its id too.

    What makes the slugs is run once. Only slugs that occur twice are ranked, and only suffixed ones can meet a natural one.
    """
    rows, n, many, taken = kept(df, "slugs"), *(fresh(df, x) for x in ("_n", "_many", "_taken"))
    counts = rows.groupBy(F.col(slug).alias("_slug")).agg(F.count(F.lit(1)).alias(many)).filter(F.col(many) > 1)
    several = kept(rows.join(counts, rows[slug].eqNullSafe(counts["_slug"]), "left_semi"), "equal-slugs")
    alone = rows.join(counts, rows[slug].eqNullSafe(counts["_slug"]), "left_anti").withColumn("unique_slug", F.col(slug))
    ranked = numbered(several, slug, order, n, "slug-ranks").withColumn("unique_slug", F.when(F.col(n) == 0, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), F.col(n))))
    natural = rows.select(F.col(slug).alias("_slug")).distinct().withColumn(taken, F.lit(True))
    ranked = ranked.join(natural, (F.col(n) > 0) & (F.col("unique_slug") == F.col("_slug")), "left")
    ranked = ranked.withColumn("unique_slug", F.when(F.col(taken), F.concat(F.col("unique_slug"), F.lit("-"), F.col(order))).otherwise(F.col("unique_slug")))
    columns = [*df.columns, "unique_slug"]
    return ranked.select(*columns).unionByName(alone.select(*columns))


def buckets(arrivals: DataFrame, ts: str = "timestamp", key: str | None = None, width: str = "5 minutes") -> DataFrame:
    """Arrivals in tumbling windows; empty windows have no row."""
    keys = [key] if key else []
    return arrivals.groupBy(*keys, F.window(ts, width).start.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def running(df: DataFrame, value: str, order: str, key: str, out: str) -> DataFrame:
    """Sums so far within a key. Rows are buckets, so a key has few however many arrivals are behind them."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.sum(value).over(w))


def speeds(arrivals: DataFrame) -> DataFrame:
    g = arrivals.groupBy("trend_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return g.withColumn("velocity", velocity(F.col("n"), F.col("first"), F.col("last")))


def accelerations(arrivals: DataFrame) -> DataFrame:
    """From the last 15 arrivals of each trend."""
    last = top_of_each(arrivals, "trend_id", [F.col("timestamp").desc(), F.col("id").desc()], 15)
    at = lambda k: F.max(F.when(F.col("rn") == k, F.col("timestamp")))
    g = last.groupBy("trend_id").agg(F.count(F.lit(1)).alias("n"), at(1).alias("t1"), at(3).alias("t3"), F.min("timestamp").alias("tn"))
    return g.select("trend_id", accelerates(F.col("n"), F.col("t1"), F.col("t3"), F.col("tn")).alias("acceleration"))


def confidences(news: DataFrame) -> DataFrame:
    """A null source name is a source too. Distinct names are found by an aggregate of their own, so no set grows in one task."""
    names = news.groupBy("trend_id", "source_name").agg(F.min("source_tier").alias("tier"))
    g = names.groupBy("trend_id").agg(F.min("tier").alias("best_tier"), F.count(F.lit(1)).alias("sources"))
    return g.withColumn("confidence", confidence(F.col("best_tier"), F.col("sources")))
