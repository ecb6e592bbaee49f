"""Nearest neighbours by cosine: exact in blocks, or in the nearest cells of an index; related trends, novelty, leader clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..tables import kept, names, new_path
from .relational import latest

#: Values in a block of vectors (65,536 vectors of 64); a task compares one block of queries with one of the base. Each block of one side meets all blocks of the other
#: within a cell, so that a side is shuffled as many times as the other has blocks: they are as large as a task's memory bears well (32 MB in double precision).
VALUES = 1 << 22
#: Distances that a task holds at a time.
TILE = 1 << 21
#: An index has at most so many cells, and is fitted on at most so many vectors.
CELLS, SAMPLE = 1024, 20_000


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _local(k: int, exclude_self: bool, hours: float | None):
    """The k nearest of one block for each query of another: a task adds at most k rows a query to the merge."""

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and base.num_rows:
            base = base.take(pa.array(np.argsort(base["id"].to_numpy(), kind="stable")))  # so that of equal distances the first has the least id
            ids, own = queries["id"].to_numpy(), base["id"].to_numpy()
            q, m = matrix(queries["embedding"].combine_chunks()), matrix(base["embedding"].combine_chunks()).T
            n = min(k, len(own))
            step = max(1, TILE // len(own))
            for a in range(0, len(ids), step):
                some = ids[a : a + step]
                distance = 1 - q[a : a + step] @ m
                if exclude_self:
                    first, end = np.searchsorted(own, some), np.searchsorted(own, some, "right")
                    for i in np.flatnonzero(first < end):
                        distance[i, first[i] : end[i]] = np.inf
                if hours is not None:
                    distance[base["ts"].to_numpy()[None, :] < queries["ts"].to_numpy()[a : a + step, None] - hours * 3600] = np.inf
                rows, places, found = _least(distance, n)
                out.append((some[rows], own[places], found))
        return pa.table(dict(zip(("query_id", "id", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _least(distance: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places and values of the n least finite values of each row, of equal ones the first places. Only what isn't above the n-th least is sorted."""
    bound = np.partition(distance, n - 1, axis=1)[:, n - 1]
    rows, places = np.nonzero((distance <= bound[:, None]) & np.isfinite(distance))
    found = distance[rows, places]
    order = np.lexsort((places, found, rows))
    rows, places, found = rows[order], places[order], found[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])[: len(rows)]
    within = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    return rows[within < n], places[within < n], found[within < n]


def _in_cells(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool, hours: float | None, block: int | None, cells: int) -> DataFrame:
    """query_id, id, distance, rank within shared cells: a query looks into all of its ``cells``, a vector of base is in the first of its own.

    A cell of any size is cut into blocks, and each pair of blocks is a task's. Vectors are written once, with their cells beside them.
    """
    spark, path = base.sparkSession, new_path(base.sparkSession, "base")
    base.write.parquet(path)
    b = spark.read.schema(base.schema).parquet(path)
    q = spark.read.schema(base.schema).parquet(path) if queries is base else kept(queries, "queries")  # one table where both sides are one
    columns = ["id", "embedding"] + ["ts"] * (hours is not None)
    q, b = q.select(*columns, F.explode("cells").alias("cell")), b.select(*columns, F.get("cells", F.lit(0)).alias("cell")).filter("cell IS NOT NULL")
    spread = -(-spark.sparkContext.defaultParallelism // max(1, cells))  # where cells are fewer than cores they are cut finer, so that there is a block for each core
    rows = F.lit(block) if block else F.greatest(F.lit(1), F.floor(VALUES / F.max(F.size("embedding"))))
    blocks = lambda df, name, least: df.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / rows), least(F.count(F.lit(1)))).cast("int").alias(name))
    sizes = blocks(q, "nq", lambda _: F.lit(1)).join(blocks(b, "nb", lambda n: F.least(F.lit(spread), F.ceil(n / 512))), "cell")
    sizes = F.broadcast(sizes)  # at most CELLS rows
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, "cell").select("cell", place("nq").alias("qb"), every("nb").alias("bb"), *columns)
    b = b.join(sizes, "cell").select("cell", every("nq").alias("qb"), place("nb").alias("bb"), *columns)
    keys = ["cell", "qb", "bb"]
    found = q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_local(k, exclude_self, hours), "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, base: DataFrame, k: int, exclude_self: bool = True, block: int | None = None, hours: float | None = None) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of base (id, embedding) for each of queries. Exact, ties by id.

    With hours, both sides have ts in seconds, and only vectors at most so old as the query allows are considered. Blocks of both
    sides meet on the executors; no vector passes through the driver.
    """
    columns = ["id", "embedding"] + ["ts"] * (hours is not None)
    one = F.array(F.lit(0)).alias("cells")
    b = base.select(*columns, one)
    return _in_cells(b if queries is base else queries.select(*columns, one), b, k, exclude_self, hours, block, 1)


def centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centres of cells, by spherical k-means over at most ``sample`` vectors, the ones of the least hashes of their ids."""
    some = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(min(sample, SAMPLE)).toArrow()  # bounded
    m = matrix(some["embedding"].combine_chunks())
    if not len(m):
        return np.zeros((0, 0))
    found = m[:: max(1, len(m) // min(cells, CELLS))][: min(cells, CELLS)].copy()
    for _ in range(rounds):
        own = np.argmax(m @ found.T, axis=1)
        for c in range(len(found)):
            if (own == c).any():
                mean = m[own == c].sum(axis=0)
                found[c] = mean / (np.linalg.norm(mean) or 1.0)
    return found


def _celled(found: np.ndarray, probes: int):
    def run(batches):
        for batch in batches:
            m = matrix(batch.column("embedding"))
            near = np.argsort(-(m @ found.T), axis=1, kind="stable")[:, :probes] if len(m) and len(found) else np.zeros((len(m), 0), np.int64)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), cells], ["id", "embedding", "cells"])

    return run


def indexed_nearest(queries: DataFrame, base: DataFrame, k: int, cells: int, probes: int, exclude_self: bool = True, block: int | None = None) -> DataFrame:
    """As nearest(), but each query looks only into the ``probes`` cells with the nearest centres. Every vector of base is in one cell."""
    found, schema = centres(base, cells), "id long, embedding array<float>, cells array<int>"
    q = queries.select("id", "embedding").mapInArrow(_celled(found, probes), schema)
    b = q if queries is base else base.select("id", "embedding").mapInArrow(_celled(found, 1), schema)
    return _in_cells(q, b, k, exclude_self, None, block, len(found))


def nearest_sql(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The same as one declarative join, for tables so small that all pairs may be looked at in one plan."""
    q = queries.select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = base.select("id", "embedding").join(q, F.col("id") != F.col("query_id")).select("query_id", "id", (1 - cosine(F.col("q"), F.col("embedding"))).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_where(vectors: DataFrame, key: str, *conditions, columns: tuple[str, ...] = ("document",)) -> DataFrame:
    """Of each key the oldest vector (least timestamp, then greatest of the columns) whose metadata meet all conditions; the filters reach the scan."""
    some = vectors
    for c in conditions:
        some = some.filter(c)
    return latest(some.withColumn("_age", -F.col("timestamp")), key, ["_age"], list(columns))


def related(neighbours: DataFrame, clusters: DataFrame, limit: int) -> DataFrame:
    """For each query the nearest clusters other than its own, one row to a cluster. Takes place after the cut to the neighbours."""
    of = clusters.select(F.col("id").alias("_id"), "cluster_id")
    mine = clusters.select(F.col("id").alias("query_id"), F.col("cluster_id").alias("own"))
    best = neighbours.join(of, F.col("id") == F.col("_id")).join(mine, "query_id").filter("cluster_id <> own").groupBy("query_id", "cluster_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "cluster_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


Match = Callable[[str | None, str | None], bool]


def shared_words(a: str | None, b: str | None, least: float = 0.3) -> bool:
    """Default stand-in for a model that says whether two texts tell of one event: Jaccard of their words."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    return bool(x and y) and len(x & y) >= least * len(x | y)


def _earlier(m: np.ndarray, times: np.ndarray, seconds: float, k: int):
    """For each row in order: those before it that are at most so many seconds older, none of them beyond the k-th nearest, and their distances. Rows are in order of time."""
    for a in range(0, len(m), 256):
        b = min(len(m), a + 256)
        lo = int(np.searchsorted(times, times[a] - seconds))
        own, some = np.arange(a, b)[:, None], np.arange(lo, b)[None, :]
        distance = 1 - m[a:b] @ m[lo:b].T
        distance[~((some < own) & (times[some] >= times[own] - seconds))] = np.inf
        bound = np.partition(distance, k - 1, axis=1)[:, k - 1] if b - lo > k else np.full(b - a, np.inf)
        rows, places = np.nonzero((distance <= bound[:, None] + 1e-9) & np.isfinite(distance))  # a little more, as products in blocks differ in the last digits
        ends = np.searchsorted(rows, np.arange(b - a + 1))
        for r in range(b - a):
            j = places[ends[r] : ends[r + 1]] + lo
            yield j, 1 - (m[j] * m[a + r]).sum(axis=1)


def resolve(batch: pd.DataFrame, match: Match, auto: float, far: float, hours: float, k: int) -> pd.DataFrame:
    """Leader clustering of one batch in order of (ts, id). near holds each item's k nearest in the state: (distance, cluster, reference).

    What a batch holds of its own is searched by products of blocks of rows; only the k nearest of an item, and what is as near as the last of them, are looked at one by one.
    """
    batch = batch.sort_values(["ts", "id"]).reset_index(drop=True)
    m, times = np.array(batch["embedding"].tolist(), dtype=np.float64).reshape(len(batch), -1), batch["ts"].to_numpy()
    chosen = np.zeros(len(batch), np.int64)
    reference: dict[int, str | None] = {}
    for i, (row, (j, distances)) in enumerate(zip(batch.itertuples(index=False), _earlier(m, times, hours * 3600, k), strict=True)):
        near = [] if row.near is None else row.near
        for n in near:
            reference.setdefault(int(n["cluster_id"]), n["reference"])
        first = np.lexsort((chosen[j], distances))[:k]
        both = [(float(n["distance"]), int(n["cluster_id"])) for n in near] + list(zip(distances[first].tolist(), chosen[j[first]].tolist(), strict=True))
        found, seen = None, set()
        for distance, cluster in sorted(both)[:k]:
            if cluster in seen or distance > far:
                continue
            seen.add(cluster)
            if distance < auto or match(reference[cluster], row.document):
                found = cluster
                break
        chosen[i] = row.id if found is None else found
        reference.setdefault(int(chosen[i]), row.document)
    return pd.DataFrame({"id": batch["id"], "cluster_id": chosen, "is_duplicate": chosen != batch["id"].to_numpy()})


def assign(batch: DataFrame, state: DataFrame, match: Match = shared_words, auto: float = 0.07, far: float = 0.42, hours: float = 48, k: int = 5) -> DataFrame:
    """id, cluster_id, is_duplicate for a batch (id, embedding, ts, document), in order of arrival.

    An item joins the cluster of the first of its k nearest within ``hours`` (one look at each cluster, nearest first) that is
    nearer than ``auto``, or not beyond ``far`` with a reference document that matches; else it founds one. state
    (id, embedding, ts, cluster_id, reference) is searched on the executors; the batch, which the trigger or BATCH bounds, is then put in
    order by one task that sees itself and k neighbours an item.
    """
    found = nearest(batch, state, k, hours=hours).select("query_id", "id", "distance")
    near = found.join(state.select("id", "cluster_id", "reference"), "id").groupBy("query_id").agg(F.collect_list(F.struct("distance", "cluster_id", "reference")).alias("near"))
    rows = batch.select("id", "embedding", "ts", "document").join(near, F.col("id") == F.col("query_id"), "left").drop("query_id").withColumn("one", F.lit(1))
    return rows.groupBy("one").applyInPandas(lambda pdf: resolve(pdf, match, auto, far, hours, k), "id long, cluster_id long, is_duplicate boolean")


STATE = "id long, embedding array<float>, ts double, cluster_id long, reference string"


def added(state: DataFrame, batch: DataFrame, assigned: DataFrame) -> DataFrame:
    """What a batch adds to the state; a cluster's reference is its founder's document, which every item of it carries."""
    own = batch.select("id", "embedding", "ts", "document").join(assigned, "id")
    founders = own.filter("NOT is_duplicate").select("cluster_id", F.col("document").alias("reference"))
    known = state.groupBy("cluster_id").agg(F.max("reference").alias("reference"))
    founders = founders.unionByName(known).groupBy("cluster_id").agg(F.max("reference").alias("reference"))
    return own.select("id", "embedding", "ts", "cluster_id").join(founders, "cluster_id", "left").select("id", "embedding", "ts", "cluster_id", "reference")


#: Rows of a batch that leader_clusters() puts in order at a time, about.
BATCH = 20_000


def leader_clusters(items: DataFrame, batches: int | None = None, hours: float = 48, **how) -> DataFrame:
    """Leader clusters of a whole table by way of batches in order of arrival, each meeting what is live of those before.

    There are as many batches as keep each at about BATCH rows; many rows of one time stay in one batch.
    """
    spark = items.sparkSession
    items = kept(items.select("id", "embedding", "ts", "document"), "items")  # what makes them is run once
    batches = batches or max(1, -(-items.count() // BATCH))
    edges = items.select(F.percentile_approx("ts", [i / batches for i in range(1, batches)] or [1.0], 10000).alias("e")).first()["e"] or []
    edges = sorted(set(edges)) if batches > 1 else []
    path = new_path(spark, "item-batches")  # so that a batch reads its own rows only
    number = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("ts"))) if edges else F.lit(0)
    items.withColumn("_batch", number).write.partitionBy("_batch").parquet(path)
    states: list[tuple[int, DataFrame]] = []
    out = spark.createDataFrame([], "id long, cluster_id long, is_duplicate boolean")
    for i in sorted(int(n.partition("=")[2]) for n in names(spark, path) if n.startswith("_batch=")):
        part = spark.read.schema(items.schema).parquet(f"{path}/_batch={i}")
        since = edges[i - 1] - hours * 3600 if i else None
        live = spark.createDataFrame([], STATE)
        for j, s in states:
            if edges[j] >= since:  # a batch has nothing later than its edge
                live = live.unionByName(s.filter(F.col("ts") >= since))
        got = kept(assign(part, live, hours=hours, **how), "clusters")
        out = out.unionByName(got)
        states.append((i, kept(added(live, part, got), "cluster-state")))
    return out
