"""Sharding by jump consistent hashing [native: DataFrame functions only].

The hash walks a key's own random sequence of jumps; the last jump below the number of shards is the shard. It needs
no ring table, and adding a shard moves exactly the keys whose next jump lands on it. The 64-bit multiply-and-add that
drives the walk is done in 32-bit halves, because ANSI SQL arithmetic refuses to wrap.

Defined results: a null doc_id hashes as a key of its own; equal doc_ids share a shard; slots within a shard go by
doc_id, then by size and checksum; null text counts as no bytes; an empty table gives an empty result; other columns are carried along, but shard(), as it says, replaces those named as its own; a third of all
rows under one doc_id or in one shard is no problem, since a shard's slots are counted over many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ranked, table

SHARDS = 24

#: Fixed values of the published algorithm: the multiplier's halves (2862933555777941757).
_MUL_HI, _MUL_LO = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF


def _times32(a: Column, b: int) -> Column:
    """The low 32 bits of a * b for a and b below 2 ** 32."""
    return (a.bitwiseAND(F.lit(_LOW16)) * F.lit(b) + F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(_LOW16)), 16)).bitwiseAND(F.lit(_LOW32))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, next): the shard of a 64-bit key, and the place of its next jump, at or after ``shards``."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(_LOW32)).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = s["hi"], s["lo"]
        low = lo.bitwiseAND(F.lit(_LOW16)) * F.lit(_MUL_LO)
        high = F.shiftright(lo, 16) * F.lit(_MUL_LO)
        total = low + F.shiftleft(high.bitwiseAND(F.lit(_LOW16)), 16) + F.lit(1)
        carry = F.shiftright(total, 32) + F.shiftright(high, 16)
        new_hi = (carry + _times32(hi, _MUL_LO) + _times32(lo, _MUL_HI)).bitwiseAND(F.lit(_LOW32))
        # key >> 33 is the high half without its lowest bit; (b + 1) * 2 ** 31 / (that + 1) is below 2 ** 53
        to = ((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("long")
        new = F.struct(new_hi.alias("hi"), total.bitwiseAND(F.lit(_LOW32)).alias("lo"), s["j"].alias("b"), to.alias("j"))
        return F.when(s["j"] < F.lit(shards), new).otherwise(s)

    # every jump goes at least one shard on, so that many steps always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: F.struct(s["b"].alias("shard"), s["j"].alias("next")))


def stable_key(column: Column) -> Column:
    """A well mixed 64-bit key: the first half of the value's md5. Null has the key of the word null."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("null")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def shard(docs: DataFrame, key: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """docs with shard, slot (0, 1, ... within the shard by key and order) and grown_shard (with one shard more).

    The three take the place of columns of docs that have their names, unless these are key or in order, which is refused.
    """
    added = {"shard", "slot", "grown_shard"}
    if clash := added & {x.lower() for x in (key, *order)}:
        raise ValueError(f"key and order can't be columns that shard() adds: {sorted(clash)}")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in added))
    walk = fresh(docs, "_jump")
    found = docs.withColumn(walk, jump(stable_key(F.col(key)), shards))
    grown = F.when(F.col(walk)["next"] == shards, F.lit(shards)).otherwise(F.col(walk)["shard"])
    found = found.withColumns({"shard": F.col(walk)["shard"].cast("int"), "grown_shard": grown.cast("int")}).drop(walk)
    return ranked(found, ["shard"], [key, *order], "slot", "shards")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard(docs, "doc_id", ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


OP9_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, md5(coalesce(doc_id::VARCHAR, 'null')) AS m FROM documents),
k AS (SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32,
  ('0x' || substr(m, 1, 8))::HUGEINT * 4294967296 + ('0x' || substr(m, 9, 8))::HUGEINT AS key FROM d, crc_table),
walk AS (
  SELECT doc_id, key, -1::BIGINT AS b, 0::BIGINT AS j FROM k
  UNION ALL
  SELECT doc_id, next_key, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((next_key // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next_key FROM walk WHERE j < 24)),
last AS (SELECT doc_id, max(b) AS b, max(j) AS j FROM walk GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, b::INT AS shard, (row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1)::BIGINT AS slot,
       (CASE WHEN j = 24 THEN 24 ELSE b END)::INT AS grown_shard
FROM k JOIN last USING (doc_id)
"""
