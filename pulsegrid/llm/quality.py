"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: its words, hashed into buckets and normalised; one feature for the bin of each structure
statistic; and one for the bin of its recorded length. The machine scores bias + linear part + all pairwise interactions, the
interaction of two features being the product of their low-rank factors. Summed over pairs that is half of (sum of v x) ** 2
minus the sum of (v x) ** 2 in each factor, so scoring is linear in the features that are there.

It is fitted on the driver from a bounded sample: at most SAMPLE labelled documents, those with the least hashes of their
ids, none of them held out. Only their features travel, at most BUCKETS + a few dozen numbers each. Scoring is one pass
over the documents without a shuffle.

Defined results: null text scores as empty, and empty text has a score like any other; null n_chars has a bin of its
own; a null doc_id is not held out; labels without a document, or null, are not used, and of several for one document the
least is; without any label every document scores 0.5; equal texts with equal n_chars score alike; repeated rows each
have their row; an empty table gives an empty result; other columns are carried along by accepted(), left out by score().
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table
from .rules import BLANKS, repeated_words, split_words

SAMPLE, BUCKETS, FACTORS, EPOCHS, CUT = 8000, 2048, 6, 12, 0.3
EDGES = (0.0005, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.45, 0.6, 0.8)
STATS = ("symbols", "bangs", "bars", "upper", "digits", "marks", "dup_lines", "repeats", "doubled", "unique", "top_word", "mean_word", "words", "chars")
BINS = 24
SIZE = BUCKETS + len(STATS) * BINS


def bins(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[int]:
    """The bin of each structure statistic, in the order of STATS."""
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    n, solid = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    rate = lambda x, y: bisect_right(EDGES, x / y)
    log = lambda x: min(BINS - 2, int(x).bit_length())
    return [
        rate(int(bytes_[list(b"#*$%&<>")].sum()), solid), rate(int(bytes_[33]), solid), rate(int(bytes_[124]), n), rate(int(bytes_[65:91].sum()), solid), rate(int(bytes_[48:58].sum()), solid),
        rate(int(bytes_[list(b".,;:?")].sum()), n), rate(len(lines) - len(set(lines)), max(1, len(lines))), rate(repeated_words(words), n), rate(sum(a == b for a, b in zip(words, words[1:], strict=False)), n),
        rate(len(counts), n), rate(max(counts.values(), default=0), n), min(BINS - 1, int(2 * sum(map(len, words)) / n)), log(len(words)), BINS - 1 if n_chars is None else log(max(0, n_chars)),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices below SIZE, each once, and their values."""
    text = text or ""
    words = split_words(text)
    counts = Counter(words)
    hashed: dict[int, int] = {}
    for w, c in counts.items():
        k = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        hashed[k] = hashed.get(k, 0) + c
    own = [BUCKETS + i * BINS + b for i, b in enumerate(bins(text, words, counts, n_chars))]
    index = np.array([*hashed, *own], dtype=np.int32)
    value = np.array([*hashed.values(), *([0.0] * len(own))], dtype=np.float32)
    value /= max(1e-9, float(np.sqrt((value**2).sum())))
    value[len(hashed) :] = 1.0 / np.sqrt(len(STATS))
    return index, value


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # SIZE
    factors: np.ndarray  # SIZE x FACTORS

    def raw(self, index: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores before the logistic of rows whose features begin at ``at``; each row has some."""
        vx = self.factors[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, at), np.add.reduceat(vx**2, at)
        return self.bias + np.add.reduceat(self.linear[index] * value, at) + 0.5 * (sums**2 - squares).sum(axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, step: float = 0.15, shrink: float = 2e-4) -> Machine:
    """Minibatch AdaGrad on the logistic loss, with weights shrunk towards 0."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, FACTORS)).astype(np.float32))
    if not len(labels):
        return Machine(0.0, m.linear, np.zeros_like(m.factors))
    mean = float(np.clip(labels.mean(), 0.01, 0.99))
    m.bias = float(np.log(mean / (1 - mean)))
    g_bias, g_linear, g_factors = 1e-3, np.full(SIZE, 1e-3, np.float32), np.full((SIZE, FACTORS), 1e-3, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for some in np.array_split(order, max(1, len(order) // 64)):
            lengths = np.array([len(rows[i][0]) for i in some])
            at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            index, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            vx = m.factors[index] * value[:, None]
            sums = np.add.reduceat(vx, at)
            raw = m.bias + np.add.reduceat(m.linear[index] * value, at) + 0.5 * (sums**2 - np.add.reduceat(vx**2, at)).sum(axis=1)
            slope = (logistic(raw) - labels[some]) / len(some)
            each = np.repeat(slope, lengths) * value
            d_linear = np.bincount(index, each, SIZE).astype(np.float32)
            part = each[:, None] * (np.repeat(sums, lengths, axis=0) - vx)
            d_factors = np.stack([np.bincount(index, part[:, f], SIZE) for f in range(FACTORS)], axis=1).astype(np.float32)
            there = np.unique(index)
            d_linear[there] += shrink * m.linear[there]
            d_factors[there] += shrink * m.factors[there]
            d_bias = float(slope.sum())
            g_bias, g_linear, g_factors = g_bias + d_bias**2, g_linear + d_linear**2, g_factors + d_factors**2
            m.bias -= step * d_bias / g_bias**0.5
            m.linear -= step * d_linear / np.sqrt(g_linear)
            m.factors -= step * d_factors / np.sqrt(g_factors)
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _featured(batches):
    for batch in batches:
        found = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n_chars"), strict=True)]
        columns = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("quality"), *columns], ["_id", "quality", "index", "value"])


def n_chars(docs: DataFrame) -> Column:
    return docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.char_length(docs["text"]).cast("long")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents of docs (doc_id, text, n_chars); of several under one doc_id, on one of them."""
    own = labels.select(F.col("doc_id").cast("string").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id IS NOT NULL AND quality IS NOT NULL")
    own = own.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    named = docs.select(docs["doc_id"].cast("string").alias("_id"), docs["text"], n_chars(docs).alias("n_chars"))
    found = named.join(F.broadcast(own), "_id").mapInArrow(_featured, "_id string, quality int, index binary, value binary")  # the sample's bound is its size
    one = found.groupBy("_id", "quality").agg(F.min(F.struct("index", "value")).alias("x")).select("_id", "quality", "x.*")  # at most ``sample`` rows
    got = sorted((r["_id"], bytes(r["index"]), bytes(r["value"]), r["quality"]) for r in one.collect())
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, i, v, _ in got]
    return fit(rows, np.array([q for *_, q in got], dtype=np.float32))


def _scored(m: Machine, text: str, size: str, out: str):
    """Rows without the columns text and size, and with their score."""

    def run(batches):
        for batch in batches:
            names = [n for n in batch.schema.names if n not in (text, size)]
            scores: list[float] = []
            texts, sizes = batch.column(text), batch.column(size)
            for a in range(0, len(texts), 500):
                found = [features(texts[i].as_py(), sizes[i].as_py()) for i in range(a, min(a + 500, len(texts)))]
                at = np.concatenate(([0], np.cumsum([len(x) for x, _ in found])[:-1])).astype(np.int64)
                scores += logistic(m.raw(np.concatenate([x for x, _ in found]), np.concatenate([v for _, v in found]), at)).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(scores, pa.float64())], [*names, out])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score, in (0, 1): higher where quality 1 is likelier."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].alias("_text"), n_chars(docs).alias("_n")).mapInArrow(_scored(machine, "_text", "_n", "_score"), f"doc_id {kind}, _score double").withColumnRenamed("_score", "score")


def accepted(docs: DataFrame, machine: Machine, cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least ``cut``, all their columns as they were."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    text, size, out = (fresh(docs, c) for c in ("_text", "_n", "_score"))
    scored = docs.withColumns({text: docs["text"], size: n_chars(docs)}).mapInArrow(_scored(machine, text, size, out), StructType([*docs.schema.fields, StructField(out, DoubleType())]))
    return scored.filter(F.col(out) >= cut).drop(out)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
