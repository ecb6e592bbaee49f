"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Equal texts form one node, so copies cost one row in all that follows.
2. A node's MinHash values, in 48 bands of six, name the buckets it falls in. A pair of similarity 0.8 shares no
   bucket once in two million times; there are no caps on buckets.
3. Each bucket is a star around its least member, found by an aggregate; connected components of the stars gather
   all nodes that may be linked. No pair is written out.
4. Each component's texts meet in one task, or, where they are many, in one task for each pair of its chunks. There
   every pair is compared: MinHash values 32 at a time, dropping pairs whose posterior probability of reaching 0.8 (from a
   uniform prior) is below TOLERANCE; the rest are verified by their shingle sets, compared as 64-bit hashes.
5. A task reports for each node its number of links and a root within the task, which is linear in its nodes;
   connected components of these give the classes.

Defined results: texts of one to four words have one shingle, all their words; texts without words, null among them,
are linked to equal texts only, null counting as empty; repeated rows are documents of their own; a class is named by its
least doc_id; an empty table gives an empty result; other columns are left out by the join and carried along by deduplicate().
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stash, fresh, stash, table

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-7
BANDS, ROWS, STEP = 48, 6, 32
HASHES = BANDS * ROWS
#: A task's chunk of a component, in nodes and in shingles.
CHUNK_NODES, CHUNK_SHINGLES = 768, 1_000_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_BAND = _rng.integers(0, 2**63, (ROWS,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS = _rng.integers(0, 2**63, (SHINGLE,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers of an odd base and of its inverse modulo 2 ** 64: the hash of any stretch of bytes from two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in ascending order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edge = np.diff(np.concatenate(([True], _BLANK[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    width = min(SHINGLE, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out += words[k : k + len(out)] * _WORDS[k]
    return np.unique(mixed(out + np.uint64(width)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of a set that isn't empty."""
    low, best = (hashes >> np.uint64(32)).astype(np.uint32), None
    for a in range(0, len(low), 1024):
        some = ((low[None, a : a + 1024] ^ _FLIP[:, None]) * _MULTIPLY[:, None]).min(axis=1)
        best = some if best is None else np.minimum(best, some)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band; a key tells the band as well."""
    parts = sig.astype(np.uint64).reshape(BANDS, ROWS)
    return mixed((mixed(parts + np.uint64(1)) * _BAND[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each STEP values, the least number of equal ones at which a pair is still kept.

    With m of n values equal and a uniform prior the similarity is Beta(m + 1, n - m + 1), so the probability that it reaches
    the threshold t is that of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Places of the rows of ``others`` that incremental comparison with ``one`` does not drop."""
    left, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, least in enumerate(least_matches()):
        if not len(left):
            break
        at = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (others[left, at] == one[at]).sum(axis=1)
        keep = equal >= least
        left, equal = left[keep], equal[keep]
    return left


class Links:
    """The links among some nodes: counts, and a forest of roots."""

    def __init__(self, n: int) -> None:
        self.up, self.links = list(range(n)), np.zeros(n, np.int64)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def linked(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray) -> Links:
    """Compare nodes: all pairs if side is 0 throughout, or else those of one node of each side."""
    n, sizes, both = len(sets), np.array([len(s) for s in sets]), bool(side.any())
    found, sigs = Links(n), np.stack([signature(s) for s in sets])
    owner, flat = np.repeat(np.arange(n), sizes), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in range(n):
        later = np.arange(i + 1, n)
        if both:
            later = later[side[later] != side[i]]
        later = later[(sizes[later] >= THRESHOLD * sizes[i] - 1e-9) & (sizes[i] >= THRESHOLD * sizes[later] - 1e-9)]
        later = later[survivors(sigs[i], sigs[later])]
        if not len(later):
            continue
        if len(later) <= 8:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in later])
        else:  # all at once, over the postings of this node's shingles
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            long = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(long.sum())
            common = np.bincount(owner[at], minlength=n)[later]
        whole = sizes[i] + sizes[later] - common
        for j in later[common >= THRESHOLD * whole - 1e-9].tolist():
            found.links[i] += copies[j]
            found.links[j] += copies[i]
            found.join(i, j)
    return found


# --- The plan around them --------------------------------------------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the key of each text, its md5; null counts as empty."""
    return docs.withColumn("key", F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))))


def _signed(batches):
    for batch in batches:
        sizes, keys = [], []
        for x in batch.column("text"):
            own = shingles(x.as_py())
            sizes.append(len(own))
            keys.append(band_keys(signature(own)) if len(own) else np.zeros(0, np.int64))
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), lists], ["doc_id", "key", "shingles", "bands"])


def nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, key) and nodes (key, rep, copies, shingles, bands), one to a text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stash(keyed(docs.select("doc_id", "text")).mapInArrow(_signed, f"doc_id {kind}, key binary, shingles long, bands array<long>"), "signatures")
    one = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands"))
    return rows.select("doc_id", "key"), stash(one, "nodes")


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, root: the least node of each node's component. edges: a, b, of one type that has an order.

    Each round points every node at its least neighbour, follows pointers to their ends by doubling, and moves the edges to
    the ends. At most half of the nodes remain, so there are few rounds; each is an aggregate and joins without hot sums.
    """
    edges = stash(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), name)
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            jumped = stash(up.join(over, "root", "left").select("node", F.coalesce("further", "root").alias("root"), (F.col("further") != F.col("root")).alias("moved")), name)
            drop_stash(up)
            up = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if found is None:
            found = up
        else:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
            found = stash(found.join(over, "root", "left").select("node", F.coalesce("further", "root").alias("root")), name)
        a, b = (up.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        moved = edges.join(a, "a").join(b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = stash(moved, name)
        if edges.isEmpty():
            return found


def candidates(of: DataFrame) -> DataFrame:
    """id, root: nodes that share a bucket with others, by the first half of their keys, and their component."""
    ids = of.filter("shingles > 0").select(short_id(F.col("key")).alias("id"), F.explode("bands").alias("band"))
    full = ids.groupBy("band").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b <> most").select("band", "b")
    stars = ids.join(stash(full, "buckets"), "band").select(F.col("id").alias("a"), "b")
    return components(stars, "candidates").withColumnRenamed("node", "id")


def short_id(key):
    return F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("long")


def _compared(batches):
    """Rows come sorted by root, ca, cb, so a group ends where these change; a group is held at a time."""
    schema = pa.schema([("key", pa.binary()), ("to", pa.binary()), ("links", pa.int64())])

    def close(at, group):
        if len(group) < 2:
            return None
        keys = sorted(group)
        sets, copies, side = (list(x) for x in zip(*(group[k] for k in keys), strict=True))
        # where one of two chunks has no node, the other's pairs are those of its own task
        if at[1] != at[2] and len(set(side)) < 2:
            return None
        found = linked(sets, np.array(copies), np.array(side))
        rows = [(k, keys[found.root(i)], int(n)) for i, (k, n) in enumerate(zip(keys, found.links, strict=True)) if n]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else None

    now, group = None, {}
    for batch in batches:
        names = ("root", "ca", "cb", "side", "key", "copies", "text")
        for at, (root, ca, cb, side, key, copies, text) in enumerate(zip(*(batch.column(n) for n in names), strict=True)):
            here = (root.as_py(), ca.as_py(), cb.as_py())
            if here != now:
                if (out := close(now, group)) is not None:
                    yield out
                now, group = here, {}
            # one of two chunks compared with each other only counts pairs across
            group.setdefault(key.as_py(), (shingles(text.as_py()), copies.as_py(), side.as_py()))
    if (out := close(now, group)) is not None:
        yield out


def links(docs: DataFrame, of: DataFrame) -> DataFrame:
    """key, to, links: for each node and task its links, counted in documents, and the least node it is joined to there."""
    near = candidates(of)
    some = of.select("key", "rep", "copies", "shingles", short_id(F.col("key")).alias("id")).join(near, "id").drop("id")
    some = stash(some, "near-nodes")
    sizes = some.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_NODES), F.ceil(F.sum("shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    some = some.join(stash(sizes, "near-sizes"), "root")
    at = lambda key, doc_id: F.xxhash64(key, doc_id)
    texts = keyed(docs.select("doc_id", "text")).withColumn("at", at("key", "doc_id"))
    some = some.withColumn("at", at("key", "rep")).withColumnRenamed("key", "own")
    met = texts.join(some, (texts["at"] == some["at"]) & (texts["key"] == some["own"]) & texts["doc_id"].eqNullSafe(some["rep"]))
    met = met.select("root", "key", "copies", "text", "chunks", F.pmod(F.xxhash64("key"), "chunks").cast("int").alias("c"))
    met = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("root", F.least("c", "k").alias("ca"), F.greatest("c", "k").alias("cb"), (F.col("c") > F.col("k")).cast("int").alias("side"), "key", "copies", "text")
    group = ["root", "ca", "cb"]
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compared, "key binary, to binary, links long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, key), and root, key, rep, n_links, class_rep for each text: root names its class, class_rep is the least doc_id there."""
    members, of = nodes(docs)
    found = stash(links(docs, of), "links")
    roots = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")), "classes").withColumnsRenamed({"node": "key"})
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    all_ = of.select("key", "rep", "copies").join(roots, "key", "left").join(counts, "key", "left")
    all_ = stash(all_.select("key", "rep", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "class-nodes")
    least = all_.groupBy("root").agg(F.min("rep").alias("class_rep"))
    return members, all_.join(least, "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links (documents it is linked to, copies among them)."""
    members, of = classes(docs)
    return members.join(of, "key").select("doc_id", F.col("class_rep").alias("class_id"), "n_links")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of its least doc_id; all columns as they were.

    Of rows alike in doc_id and text the one with the least hash of all columns stays, however rows are dealt out.
    """
    _, of = classes(docs)
    keep = of.filter(F.col("rep").eqNullSafe(F.col("class_rep")))
    # texts of a class may share its least doc_id: the least key of them stays; classes may share it as well, null above all
    one = stash(keep.groupBy("root", "rep").agg(F.min("key").alias("key")), "kept")
    key, at = fresh(docs, "_key"), fresh(docs, "_at")
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))))
    rows = rows.withColumn(at, F.xxhash64(key, "doc_id"))
    one = one.select(F.col("key").alias("_one"), F.col("rep").alias("_rep"), F.xxhash64("key", "rep").alias("_there"))
    kept = rows.join(one, (rows[at] == one["_there"]) & (rows[key] == one["_one"]) & rows["doc_id"].eqNullSafe(one["_rep"]), "left_semi")
    place, whole = fresh(docs, "_place"), [c for c, t in docs.dtypes if not t.startswith("map")]
    first = Window.partitionBy(at, key).orderBy(F.xxhash64(*whole))  # one row a key leaves each task
    return kept.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(at, key, place)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
p AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 5 * k >= 4 * (x.n + y.n - k)
      UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.t = y.t AND x.doc_id < y.doc_id),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, min(root) AS class_id, coalesce(any_value(n_links), 0) AS n_links FROM r LEFT JOIN l USING (doc_id) GROUP BY doc_id
"""
