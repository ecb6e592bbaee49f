"""Mixing sources to target weights by systematic sampling [native: DataFrame functions only].

Each document of a source is expected ``rate = target / source_size`` times. Expected copies are summed over the
source's documents, one random offset is added, and a document is emitted once for each integer that its own part
of the sum crosses. Documents are taken in order of size, so that the emitted words stay within about one document's
size of the target: the sum of copies never strays from its expectation by one, and neighbours are alike in size.

Defined results: null text has size 0 and is sampled like any other; null source is a source of its own, the last;
a source without words has target 0 and gives no copy; repeated rows are rows of their own; ties in size fall by
doc_id, then by a hash of the text; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, ranked, same, stash, table

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """One number in [0, 1) for a source, the same in each run."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s:"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> with target: the share of all sizes by weight, capped, the excess shared anew by weight.

    Sharing anew until none is above its cap ends where every source stands at min(cap, weight * level). In order of
    cap / weight the capped sources come first, so one pass over the sources finds the level. There is one row a source.
    """
    everyone, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "_rn")
    t = sizes.withColumn("_rn", F.row_number().over(by_name))
    t = t.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("_rn") - 1) % len(weights) + 1))
    t = t.withColumns({"_cap": F.lit(cap) * F.col("source_size"), "_all": F.lit(share) * F.sum("source_size").over(everyone)})
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    t = t.withColumns({"_before": F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_rest": F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    t = t.withColumn("_full", F.col("_cap") * F.col("_rest") <= (F.col("_all") - F.col("_before")) * F.col("_w"))
    t = t.withColumns({"_taken": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everyone), "_open": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everyone)})
    level = (F.col("_all") - F.col("_taken")) * F.col("_w") / F.nullif(F.col("_open"), F.lit(0.0))
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(level).alias("target"))


def mix(docs: DataFrame, size: str, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """docs (doc_id, source, a size column, others) with source_size, target and copies, one row per row of docs.

    The three take the place of columns of docs that have their names, unless that is the size column, which is refused.
    """
    added = {"source_size", "target", "copies"}
    if size.lower() in added:
        raise ValueError(f"the size column can't be one that mix() adds: {size}")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    tie, rank = fresh(docs, "_tie"), fresh(docs, "_rank")
    rows = ranked(docs.withColumn(tie, F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if not kind.startswith("map")))), ["source"], [size, "doc_id", tie], rank, "mix")
    per = rows.groupBy("source").agg(F.sum(size).alias("source_size"))
    aims = stash(targets(per, weights, share, cap), "mix-targets")
    rate = F.when(aims["source_size"] > 0, aims["target"] / aims["source_size"]).otherwise(0.0)
    crossed = lambda k: F.floor(k * rate + offset(aims["source"], seed))
    copies = (crossed(rows[rank] + 1) - crossed(rows[rank])).cast("int")
    kept = [rows[c] for c in docs.columns]
    return rows.join(aims, same(rows, aims, ["source"])).select(*kept, aims["source_size"], aims["target"], copies.alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of documents, each as many times as it was drawn, with documents' own columns.

    Draws are made on narrow rows, so that sorting by size moves no text and no task gets all long texts. Rows are told apart
    by doc_id and a hash of their columns; rows alike in both are one row many times over, and share the draws of all of them.
    """
    tie, n = fresh(docs, "_tie"), fresh(docs, "_n")
    rows = docs.withColumn(tie, F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if not kind.startswith("map"))))
    narrow = rows.select("doc_id", "source", words(F.col("text")).alias("size"), F.col(tie).alias("tie"))
    drawn = mix(narrow, "size", **how).groupBy("doc_id", "tie").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("m"))
    drawn = stash(drawn.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_own"), F.floor(F.col("c") / F.col("m")).cast("int").alias("_each"), (F.col("c") % F.col("m")).cast("int").alias("_rest")).filter("_each > 0 OR _rest > 0"), "mix-draws")

    def emitted(copies: str, draws: DataFrame, once: bool = False) -> DataFrame:
        draws = draws.select(F.col("_id"), F.col("_own"), F.col(copies).alias(n)).filter(F.col(n) > 0)
        own = rows.join(draws, (rows[tie] == draws["_own"]) & rows["doc_id"].eqNullSafe(draws["_id"])).select(*(rows[c] for c in rows.columns), draws[n])
        own = own.dropDuplicates(["doc_id", tie]) if once else own
        return own.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)

    out, left = emitted("_each", drawn), drawn.filter("_rest > 0")
    return out if left.isEmpty() else out.unionByName(emitted("_rest", left, once=True))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words(F.col("text")).alias("size"))
    out = mix(docs, "size")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(rn - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, cap * rest <= (total - before) * w AS is_full FROM b),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * w
      / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) END AS target,
      ('0x' || substr(md5('mix-1|' || coalesce('s:' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM f),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, k, u
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (floor(k * rate + u) - floor((k - 1) * rate + u))::BIGINT * size AS taken,
       (floor(k * rate + u) - floor((k - 1) * rate + u))::INT AS copies FROM c
"""
