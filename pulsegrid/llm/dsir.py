"""Importance resampling towards a target distribution, by hashed n-grams.

A table of positions holds each word of each document (posexplode). A window over a document's positions leads to the words that
follow, so that the n-gram of each order that starts there is one concatenation and one hash, an integer below 10,000. Counts by
bucket in both collections give each bucket's gain; gains join the positions, and their sum is a document's weight. Gumbel noise from
a hash of doc_id makes the highest scores a sample without replacement, the same on each run.

All of it is DataFrame code. Texts are shuffled once, by row, and the positions of a row stay where they are: neither the window nor
the sums by document shuffle again. Buckets are written once, in 16 bits, and read for counts and for weights. The broadcast tables have
one row a bucket, ``BUCKETS`` at most.

Defined results: null and empty texts and texts without words have no features, weight 0, a score of noise alone, and are never
drawn; a null doc_id draws its noise as the empty string and loses ties to none; rows alike in doc_id and text get the same noise
and are ranked one after the other; an empty target gives each bucket the gain of no occurrence; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, plain_words, ranked, stash, table

BUCKETS, ORDERS, SEED = 10_000, 3, 42
#: Fewest words of a document that may be drawn, and the share that is, in percent.
LEAST_WORDS, PERCENT = 20, 5


def grams(docs: DataFrame, row: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, and for each word the buckets of the n-grams that start there: b1, b2, ...; a document without words has one row of nulls.

    docs (row, doc_id, text), row unlike in all rows.
    """
    at = docs.repartition(row).select(row, "doc_id", F.posexplode_outer(plain_words(F.col("text"))).alias("pos", "w1"))
    following = Window.partitionBy(row).orderBy("pos")
    at = at.select("*", *(F.lead("w1", k).over(following).alias(f"w{k + 1}") for k in range(1, orders)))
    # concat is null, and so is the bucket, where the text ends before the n-gram does
    gram = lambda k: F.concat(*[c for i in range(1, k + 1) for c in ((F.lit(" "), F.col(f"w{i}")) if i > 1 else (F.col("w1"),))])
    bucket = lambda k: (F.crc32(gram(k).cast("binary")) % buckets).cast("short" if buckets <= 1 << 15 else "int").alias(f"b{k}")
    return at.select(row, "doc_id", *map(bucket, range(1, orders + 1)))


def counts(positions: DataFrame, n: str, orders: int = ORDERS) -> DataFrame:
    """bucket, n: occurrences of each bucket, at most one row a bucket."""
    one = [positions.filter(F.col(f"b{k}").isNotNull()).groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count(F.lit(1)).alias(n)) for k in range(1, orders + 1)]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out.groupBy("bucket").agg(F.sum(n).alias(n))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: how much likelier a bucket is in the target, in thousandths of a natural logarithm, for each bucket of the source."""
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c.upper()))
    both = source.join(F.broadcast(target), "bucket", "left").crossJoin(F.broadcast(total(source, "s").withColumnRenamed("S", "all_s"))).crossJoin(F.broadcast(total(target, "t").withColumnRenamed("T", "all_t")))  # one row each
    ratio = ((F.coalesce("t", F.lit(0)) + 1).cast("double") * (F.col("all_s") + buckets)) / ((F.col("s") + 1).cast("double") * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each of docs (doc_id, text); rank is null for those not drawn. target (text)."""
    row = fresh(docs, "_row")
    own = docs.select("doc_id", "text").withColumn(row, F.monotonically_increasing_id())
    positions = stash(grams(own, row, orders, buckets), "dsir-grams")
    aim = stash(grams(target.select(F.monotonically_increasing_id().alias(row), F.lit(None).cast("long").alias("doc_id"), "text"), row, orders, buckets), "dsir-target")
    gain = stash(gains(counts(positions, "s", orders), counts(aim, "t", orders), buckets), "dsir-gains")
    at = positions
    for k in range(1, orders + 1):
        at = at.join(F.broadcast(gain.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    n = sum((F.count(f"b{k}") for k in range(2, orders + 1)), F.count("b1"))
    weight = sum((F.coalesce(F.sum(f"g{k}"), F.lit(0)) for k in range(2, orders + 1)), F.coalesce(F.sum("g1"), F.lit(0)))
    weighed = at.groupBy(row).agg(F.first("doc_id").alias("doc_id"), F.count("b1").alias("n_words"), n.cast("long").alias("n_features"), weight.cast("long").alias("weight"))
    weighed = stash(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "dsir-weights")
    may = weighed.filter(F.col("n_words") >= least).select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("_down"))
    drawn = F.floor(F.lit(percent) * F.count(F.lit(1)) / 100).alias("_drawn")
    placed = ranked(may, [], ["_down", "doc_id", "n_features"], "_at", "dsir-ranks").crossJoin(F.broadcast(may.agg(drawn)))  # one row
    rank = F.when(F.col("_at") < F.col("_drawn"), F.col("_at") + 1).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = weighed.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank"))
    return placed.select(*columns, rank).unionByName(rest)


def op13_dsir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
texts AS (SELECT 0 AS target, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 1, item_id, -row_number() OVER (), text FROM benchmark),
w AS (SELECT target, id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts),
g AS (SELECT r, target, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i]) || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
  || list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM w),
x AS (SELECT gram, hex(encode(gram)) AS h FROM (SELECT DISTINCT gram FROM g)),
b AS (SELECT gram, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda p, q: xor(p >> 8, t[xor(p, q) % 256 + 1])), 4294967295) % 10000 AS bucket FROM x, crc_table),
f AS (SELECT r, target, bucket, count(*) AS n FROM g JOIN b USING (gram) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (target = 1), 0)::DOUBLE AS t FROM f GROUP BY bucket),
k AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM c) + 10000)) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
v AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN k USING (bucket) WHERE target = 0 GROUP BY r),
d AS (SELECT id AS doc_id, r, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN v USING (r) WHERE target = 0),
p AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS rank, count(*) OVER () AS n FROM d WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM d LEFT JOIN p USING (r)
"""
