"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as Parquet in the shared folder and reads
it again for the next. Rejected documents go, of each near-duplicate class the document of the least doc_id stays, secrets in the
texts are replaced by a mark, sources are mixed to their target weights (a document drawn twice stands there twice), and
the texts' token ids are packed into sequences: a row of the last table is a piece of a document, its ids and its place. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import joins, mix, packing, quality, secrets, tokens
from pulsegrid.llm.common import stash, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return joins.deduplicate(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.vocabulary_path())


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.vocabulary_path(), keep_ids=True, words=WORDS)


#: Words that a worker remembers while it packs; the workers of this stage still hold what earlier stages left in them.
WORDS = 100_000

STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources to target weights", source_mix), ("packing", packed)]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return stash(STAGES[-1][1](spark, docs, sf_dir), "pipeline-packed", tokens.FORMAT)
