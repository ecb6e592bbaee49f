"""An inverted index: postings by term, so that a search reads the postings of its own words and not the texts.

Postings are a table (bucket, term, key) in folders by a hash of the term, in order of term and key within files. A search names its buckets and terms:
Spark leaves out all other folders, and within one all row groups and pages that can't hold a term. Range partitions cut a word that
most texts have over as many files as its postings fill. Terms are stems, found once for each distinct word of a batch, or plain words.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.turkish import stem
from ..tables import kept
from .search import STOP, words

#: Rows that a task sorts at most, about.
ROWS = 2_000_000


def terms(t: Column, stop: frozenset[str]) -> Column:
    """The distinct words of a text, but for stop words."""
    return F.array_except(words(t), F.array(*map(F.lit, sorted(stop)))) if stop else words(t)


def _stemmed(batches):
    for batch in batches:
        lists = batch.column("terms")
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())  # each distinct word once
        rows = pa.table({"row": pc.list_parent_indices(lists).cast(pa.int64()), "term": stems.take(coded.indices)}).group_by(["row", "term"]).aggregate([])
        for part in rows.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([batch.column("key").take(part.column("row")), part.column("term")], ["key", "term"])


def postings(docs: DataFrame, key: str, text: str, stems: bool = True, stop: frozenset[str] = STOP) -> DataFrame:
    """key, term: each term of a text once."""
    own = docs.select(F.col(key).alias("key"), terms(F.col(text), stop).alias("terms"))
    if stems:
        return own.mapInArrow(_stemmed, f"key {docs.schema[key].dataType.simpleString()}, term string")
    return own.select("key", F.explode("terms").alias("term"))


@dataclass(frozen=True)
class Index:
    path: str
    schema: str
    buckets: int
    stems: bool
    stop: frozenset[str]

    def bucket(self, term: Column) -> Column:
        return (F.crc32(term.cast("binary")) % self.buckets).cast("int")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def tasks(rows: DataFrame) -> int:
    """How many tasks rows are dealt to: no fewer than usual, and no more than ROWS to each."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))


def build(docs: DataFrame, key: str, text: str, path: str, buckets: int = 32, stems: bool = True, stop: frozenset[str] = STOP) -> Index:
    """The index of docs, written to a new folder. Terms are found once, as bounds of ranges need a look at them before; there are as many ranges as keep each at ROWS."""
    index = Index(path, f"term string, key {docs.schema[key].dataType.simpleString()}, bucket int", buckets, stems, stop)
    own = kept(postings(docs, key, text, stems, stop), "postings").withColumn("bucket", index.bucket(F.col("term")))
    order = ["bucket", "term", "key"]
    own.repartitionByRange(tasks(own), *order).sortWithinPartitions(*order).select("term", "key", "bucket").write.partitionBy("bucket").parquet(path)
    return index


def query_terms(index: Index, query: str) -> list[str]:
    low = query.replace("İ", "i").replace("I", "ı").lower()
    own = "".join(c if c.isalnum() else " " for c in low).split()
    return sorted({stem(w) if index.stems else w for w in own if w not in index.stop})


def find(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """key of each text that has all terms of the query; none where the query has no term."""
    wanted = query_terms(index, query)
    buckets = sorted({zlib.crc32(t.encode()) % index.buckets for t in wanted})
    own = index.rows(spark).filter(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    return own.select("key") if len(wanted) == 1 else own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("key")


def find_all(index: Index, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """query_id, key for a table of queries at once: postings meet the queries' terms in one join."""
    wanted = postings(queries, query_id, text, index.stems, index.stop).withColumnRenamed("key", "query_id")
    sizes = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    wanted = wanted.join(sizes, "query_id").withColumn("bucket", index.bucket(F.col("term")))
    hits = index.rows(queries.sparkSession).join(wanted, ["bucket", "term"])
    return hits.groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max("n_terms").alias("n_terms")).filter("n = n_terms").select("query_id", "key")
