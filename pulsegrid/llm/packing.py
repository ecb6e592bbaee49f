"""Packing by best-fit decreasing.

A document's ids, with the end id, are cut into full windows first; each full window is a sequence of its own. What is
left of a document is shorter than a window, so best-fit decreasing needs no list of documents: the number of rests
of each length settles it, and there are fewer lengths than a window has tokens. The driver runs best-fit decreasing over that
histogram, whole runs of equal rests and equal windows at a time, with a segment tree indexed by remaining capacity to
find the tightest open window. The plan says for each length which ranks go to which sequences; each task then places
its own rests by their rank among all of their length. Ranks come from counts by partition and length, so no length is
ever gathered in one task, however many documents have it.

Defined results: null text counts as empty and still holds its end id; repeated rows are packed each; an empty table
gives an empty result; columns other than doc_id and text are not used.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import same, stash, table
from .spans import slices
from .tokens import WORDS, encoder, vocabulary_path

WINDOW = 1024


class Capacities:
    """A segment tree over remaining capacities 0..most: how many windows stand open below each node."""

    def __init__(self, most: int) -> None:
        self.width = 1 << most.bit_length()
        self.tree = [0] * (2 * self.width)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.width
        while at:
            self.tree[at] += n
            at //= 2

    def tightest(self, size: int) -> int | None:
        """The least capacity of an open window that holds size."""
        at = size + self.width
        if self.tree[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts[length] rests of each length.

    Gives runs (length, first rank, rests, first sequence, rests a sequence, offset of the first one). Equal rests that meet
    the tightest window fill it as often as they fit, as it stays the tightest; so windows of equal capacity are taken by runs.
    """
    open_, tree, out, opened = {}, Capacities(window), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if (c := tree.tightest(length)) is None:
                c, first, n = window, opened, -(-left // (window // length))
                opened += n
            else:
                first, n = open_[c].pop()
                tree.add(c, -n)
            each = c // length
            used = min(n, -(-left // each))
            if used < n:  # those not needed stay open as they are
                open_.setdefault(c, []).append((first + used, n - used))
                tree.add(c, n - used)
            put = min(left, used * each)
            out.append((length, rank, put, first, each, window - c))
            full, rest = divmod(put, each)
            for at, n_, c_ in ((first, full, c - each * length), (first + full, 1 if rest else 0, c - rest * length)):
                if n_ and c_:
                    open_.setdefault(c_, []).append((at, n_))
                    tree.add(c_, n_)
            rank, left = rank + put, left - put
    return out


def _pieces(path: str, window: int, keep_ids: bool, words: int):
    """Cut documents into pieces; of each, its rank among the partition's full windows or rests of the same length."""

    def run(batches):
        part, enc, seen, rows = TaskContext.get().partitionId(), encoder(path, words), np.zeros(window + 1, dtype=np.int64), 0
        for batch in batches:
            for start, texts in slices(batch.column("text"), 20 * words):
                flat, n = enc.of(texts)
                raw = memoryview(flat.astype("<u4").tobytes())
                windows = -(-n // window)
                doc = np.repeat(np.arange(len(n)), windows)
                at = (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)) * window
                length = np.minimum(window, n[doc] - at)
                first = (np.cumsum(n) - n)[doc] + at
                cuts = list(zip((4 * first).tolist(), (4 * (first + length)).tolist(), strict=True))
                crc = [zlib.crc32(raw[a:b]) for a, b in cuts]
                rank = np.empty(len(doc), dtype=np.int64)
                order = np.argsort(length, kind="stable")
                lengths, begins, counts = np.unique(length[order], return_index=True, return_counts=True)
                rank[order] = np.arange(len(doc)) - np.repeat(begins - seen[lengths], counts)
                seen[lengths] += counts
                total = n[doc]
                own = batch.column("doc_id").slice(start, len(texts)).take(pa.array(doc))
                columns = [own, *map(pa.array, (at, length, crc, total, (part << 33) + rows + doc)), pa.array([part] * len(at), pa.int32()), pa.array(rank)]
                if keep_ids:  # pieces stand in the order of the ids
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))))
                rows += len(n)
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "_part", "_rank"] + ["ids"] * keep_ids)

    return run


def _placed(runs: list[tuple[int, int, int, int, int, int]], window: int, full: int):
    """Give each piece its sequence and offset. The plan is bounded by the window, not by the documents."""
    table_ = np.array(runs, dtype=np.int64).reshape(-1, 6)
    table_ = table_[np.lexsort((table_[:, 1], table_[:, 0]))]

    def run(batches):
        # one ascending key of (length, first rank) finds a piece's run
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = rank.copy(), np.zeros_like(rank)
            for k in np.unique(length[length < window]):
                lo, hi = np.searchsorted(table_[:, 0], [k, k + 1])
                rows = np.flatnonzero(length == k)
                own = table_[lo:hi][np.searchsorted(table_[lo:hi, 1], rank[rows], side="right") - 1]
                i = rank[rows] - own[:, 1]
                sequence[rows] = full + own[:, 3] + i // own[:, 4]
                offset[rows] = own[:, 5] + i % own[:, 4] * k
            keep = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, keep_ids: bool = False, words: int = WORDS) -> DataFrame:
    """Pieces of docs (doc_id, text) with their sequence_id and offset; with keep_ids also their ids (array of int).

    ``words`` bounds what a worker remembers, and with it the memory it takes. ``row`` tells the rows of docs apart: pieces of one row have it in common, copies of a document don't.
    """
    kind, more = docs.schema["doc_id"].dataType.simpleString(), ", ids array<int>" * keep_ids
    columns = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long"
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_pieces(path, window, keep_ids, words), f"{columns}, _part int, _rank long{more}"), "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stash(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))), "piece-counts")
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `window` rows
    full = lengths.pop(window, 0)
    joined = pieces.join(counts, same(pieces, counts, ["_part", "length"])).select(*(pieces[c] for c in pieces.columns if c not in ("_rank", "_part")), (pieces["_rank"] + counts["_base"]).alias("_rank"))
    return joined.mapInArrow(_placed(plan(lengths, window), window, full), f"{columns}{more}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), vocabulary_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
