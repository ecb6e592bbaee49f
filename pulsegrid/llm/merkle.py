"""Merkle manifest of a dataset: a leaf for each row, a tree for each group of rows, a tree over the groups' roots.

Leaves are hashed where rows are read. A group's leaves are numbered by their order over range partitions, and cut into
aligned blocks of ``fanout ** height``. A block is a contiguous matrix of hex digests: reshaped by the fanout, a row is what one parent
hashes, so levels and siblings are index arithmetic. The tops of blocks are the leaves of the next round, until each group has one
node: a task holds one block, however many rows a group has. Proofs are put together from the top down: few rows first, leaves last.

Defined results: a null column hashes as ``-``, unlike an empty one. In a group rows ascend by doc_id, nulls first, then by leaf; rows alike in
all columns get proofs of their own. A run with fewer nodes than the fanout, even one, hashes to its parent; a group's only leaf is its root.
Null is a group of its own, before the others. An empty table gives an empty result. Columns beyond those named are neither hashed nor returned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, stash, table

FANOUT, HEIGHT = 2, 10
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<before:string,after:string>>"
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

Step = tuple[str, str]


# --- Blocks ------------------------------------------------------------------------------------------------------------


def matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode(), np.uint8).reshape(len(digests), HEX)


def strings(nodes: np.ndarray) -> list[str]:
    text = nodes.tobytes().decode()
    return [text[i : i + HEX] for i in range(0, len(text), HEX)]


def hashed(rows: np.ndarray) -> np.ndarray:
    """The hex digest of each row's bytes."""
    data, width = rows.tobytes(), rows.shape[1]
    return matrix([hashlib.sha256(data[i : i + width]).hexdigest() for i in range(0, len(data), width)])


def parents(level: np.ndarray, fanout: int) -> np.ndarray:
    full = len(level) // fanout * fanout
    out = [hashed(level[:full].reshape(-1, fanout * HEX))] if full else []
    if full < len(level):
        out.append(hashed(level[full:].reshape(1, -1)))
    return np.concatenate(out)


def levels(leaves: np.ndarray, number: int, fanout: int, height: int) -> list[np.ndarray]:
    """A block's nodes from its leaves to its top. A first block that isn't full is a whole tree, which ends at its root."""
    out = [leaves]
    whole = number == 0 and len(leaves) < fanout**height
    while len(out) <= height and not (whole and len(out[-1]) == 1):
        out.append(parents(out[-1], fanout))
    return out


def steps(block: list[np.ndarray], fanout: int) -> list[list[Step]]:
    """For each level below the top and each node there, what is hashed before and after it."""
    out = []
    for level in block[:-1]:
        text = level.tobytes().decode()
        at = np.arange(len(level))
        start = at - at % fanout
        end = np.minimum(start + fanout, len(level))
        out.append([(text[a * HEX : i * HEX], text[(i + 1) * HEX : b * HEX]) for i, a, b in zip(at.tolist(), start.tolist(), end.tolist(), strict=True)])
    return out


def way(block: list[list[Step]], i: int, fanout: int) -> list[Step]:
    return [level[i // fanout**j] for j, level in enumerate(block)]


def fold(digest: str, path: list[Step]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in path:
        digest = hashlib.sha256((before + digest + after).encode()).hexdigest()
    return digest


# --- Rounds ------------------------------------------------------------------------------------------------------------


def _blocks(nodes: DataFrame, fanout: int, height: int):
    return nodes.withColumn("block", F.floor(F.col("idx") / fanout**height)).groupBy("grp", "block")


def _tops(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """The top of each block, as a node of the next round."""

    def run(t: pa.Table) -> pa.Table:
        t, number = t.sort_by("idx"), t.column("block")[0].as_py()
        top = levels(matrix(t.column("digest").to_pylist()), number, fanout, height)[-1]
        return pa.table({"grp": t.column("grp").slice(0, 1).cast(pa.string()), "idx": pa.array([number], pa.int64()), "digest": strings(top)})

    return _blocks(nodes.select("grp", "idx", "digest"), fanout, height).applyInArrow(run, "grp string, idx long, digest string")


def _own_steps(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """Each node's way to the top of its block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        block = steps(levels(matrix(t.column("digest").to_pylist()), t.column("block")[0].as_py(), fanout, height), fanout)
        path = pa.array([[{"before": a, "after": b} for a, b in way(block, i, fanout)] for i in range(len(t))], _STEPS)
        return pa.table({"grp": t.column("grp").cast(pa.string()), "idx": t.column("idx"), "path": path})

    return _blocks(nodes.select("grp", "idx", "digest"), fanout, height).applyInArrow(run, f"grp string, idx long, path {STEPS}")


def climbed(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """nodes (grp, idx, digest) and the rounds above them; the last has one node a group."""
    rounds = [nodes]
    while True:
        rounds.append(stash(_tops(rounds[-1], fanout, height), "merkle-tops"))
        if not rounds[-1].agg(F.max("idx")).first()[0]:
            return rounds


def ways(rounds: list[DataFrame], fanout: int, height: int, first: int) -> DataFrame:
    """grp, idx, path, root: the way of each node of a round to its group's root."""
    up = rounds[-1].select("grp", "idx", F.lit(None).cast(STEPS).alias("path"), F.col("digest").alias("root"))
    for nodes in reversed(rounds[first:-1]):
        own = _own_steps(nodes, fanout, height).alias("o")
        up = own.join(up.alias("u"), (F.col("o.grp") == F.col("u.grp")) & (F.floor(F.col("o.idx") / fanout**height) == F.col("u.idx")))
        up = up.select("o.grp", "o.idx", F.concat("o.path", F.coalesce("u.path", F.array().cast(STEPS))).alias("path"), "u.root")
    return up.withColumn("path", F.coalesce("path", F.array().cast(STEPS)))


def _proven(leaves: DataFrame, tops: DataFrame, kind: str, fanout: int, height: int, with_paths: bool) -> DataFrame:
    size = fanout**height
    extra, schema = ([("path", _STEPS)], f", path {STEPS}") if with_paths else ([], "")

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        if not len(t):
            return out_schema.empty_table()
        t = t.sort_by("idx")
        number, digests, claimed = t.column("block")[0].as_py(), t.column("digest").to_pylist(), t.column("claimed").to_pylist()
        above = [(s["before"], s["after"]) for s in up.column("path")[0].as_py()]
        rest = "".join(a + b for a, b in above)
        block = steps(levels(matrix(digests), number, fanout, height), fanout)
        reached: dict[tuple[int, int, str], str] = {}

        def root_of(i: int, digest: str) -> str:
            """fold(), where nodes that were already followed to the root end the walk."""
            seen = []
            for j, level in enumerate(block):
                p = i // fanout**j
                if (j, p, digest) in reached:
                    break
                seen.append((j, p, digest))
                digest = fold(digest, [level[p]])
            else:
                j, p = len(block), 0
                if (j, p, digest) not in reached:
                    reached[j, p, digest] = fold(digest, above)
            root = reached[j, p, digest]
            reached.update(dict.fromkeys(seen, root))
            return root

        paths = [way(block, i, fanout) for i in range(len(digests))]
        siblings = ["".join(a + b for a, b in p) + rest for p in paths]
        n = len(t)
        columns = {
            "doc_id": t.column("doc_id"), "idx": t.column("idx"), "leaf": digests, "subroot": [up.column("subroot")[0].as_py()] * n, "root": [up.column("root")[0].as_py()] * n,
            "proof_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in siblings], "folded_root": [root_of(i, d) for i, d in enumerate(claimed)],
        }
        if with_paths:
            columns["path"] = pa.array([[{"before": a, "after": b} for a, b in p + above] for p in paths], _STEPS)
        return pa.table(columns).cast(out_schema)

    doc_id = leaves.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    texts = [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    out_schema = pa.schema([("doc_id", to_arrow_type(doc_id)), ("idx", pa.int64()), *texts, *extra])
    left = leaves.withColumn("block", F.floor(F.col("idx") / size)).groupBy("grp", "block")
    right = tops.withColumnRenamed("idx", "block").groupBy("grp", "block")
    return left.cogroup(right).applyInArrow(run, f"doc_id {kind}, idx long, leaf string, subroot string, root string, proof_sha256 string, folded_root string{schema}")


# --- Manifest ----------------------------------------------------------------------------------------------------------


def leaf(values: list[Column]) -> Column:
    """H of the values: each ``-`` if null, else its UTF-8 byte count, a colon, and itself."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(part, values)), 256)


def manifest(leaves: DataFrame, fanout: int = FANOUT, height: int = HEIGHT, with_paths: bool = False) -> DataFrame:
    """leaves (doc_id, grp, digest, claimed) with subroot, root, the hash of the proof, and the root that the claimed digest folds to.

    grp is any string, null allowed; its groups come in UTF-8 order, null first. with_paths adds the proof itself: at each
    level what is hashed before and after the node.
    """
    kind = leaves.schema["doc_id"].dataType.simpleString()
    grp = F.coalesce(F.concat(F.lit("+"), "grp"), F.lit(""))  # groups as keys that aren't null, in the same order
    rows = stash(leaves.select("doc_id", grp.alias("grp"), "digest", "claimed"), "merkle-leaves")
    rows = stash(ranked(rows, ["grp"], ["doc_id", "digest", "claimed"], "idx", "merkle-ranks"), "merkle-order")
    rounds = climbed(rows, fanout, height)
    subroots = ranked(rounds[-1].select(F.col("grp").alias("name"), "digest"), [], ["name"], "idx", "merkle-groups").select(F.lit("").alias("grp"), "idx", "digest", "name")
    subroots = stash(subroots, "merkle-subroots")
    above = ways(climbed(subroots, fanout, height), fanout, height, 0)
    above = subroots.join(above, "idx").select(F.col("name").alias("grp"), F.col("path").alias("_above"), above["root"].alias("_root"))
    tops = ways(rounds, fanout, height, 1).join(above, "grp")
    tops = tops.select("grp", "idx", F.concat("path", "_above").alias("path"), F.col("root").alias("subroot"), F.col("_root").alias("root"))
    return _proven(rows, stash(tops, "merkle-ways"), kind, fanout, height, with_paths)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    plain = [F.col(c) for c in COLUMNS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    changed = [more if c == "n_chars" else F.col(c) for c in COLUMNS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", F.col("lang").alias("grp"), leaf(plain).alias("digest"), F.when(chosen, leaf(changed)).alias("_changed"))
    out = manifest(leaves.select("doc_id", "grp", "digest", F.coalesce("_changed", "digest").alias("claimed")))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
d AS (SELECT *, row_number() OVER () AS r, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  coalesce(strlen(text) || ':' || text, '-') AS z, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)::BIGINT), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
    lambda p, q: xor(p >> 8, t[xor(p, q) % 256 + 1])), 4294967295) % 7 = 0, false) AS chosen FROM documents, crc_table),
leaves AS (SELECT r, doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
  CASE WHEN chosen THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) END AS changed FROM d),
own AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (SELECT lang, 0 AS lvl, i, n, leaf AS h FROM own
  UNION ALL SELECT lang, lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 2),
groups AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 1000 AS lvl, i, n, h FROM groups
  UNION ALL SELECT lvl + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY lvl, i // 2),
climb AS (SELECT o.r, x.lvl, (o.i >> x.lvl) AS p, s.h FROM own o JOIN (SELECT DISTINCT lang, lvl, n FROM nodes WHERE n > 1) x ON o.lang IS NOT DISTINCT FROM x.lang
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM x.lang AND s.lvl = x.lvl AND s.i = xor(o.i >> x.lvl, 1)
  UNION ALL SELECT o.r, x.lvl, (g.i >> (x.lvl - 1000)), s.h FROM own o JOIN groups g ON o.lang IS NOT DISTINCT FROM g.lang CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) x
    LEFT JOIN tops s ON s.lvl = x.lvl AND s.i = xor(g.i >> (x.lvl - 1000), 1)),
way AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS step FROM climb),
walk AS (SELECT r, 0::BIGINT AS step, coalesce(changed, leaf) AS h FROM own
  UNION ALL SELECT w.r, y.step, sha256(CASE WHEN y.p % 2 = 1 THEN coalesce(y.h, '') || w.h ELSE w.h || coalesce(y.h, '') END) FROM walk w JOIN way y ON y.r = w.r AND y.step = w.step + 1),
folded AS (SELECT r, arg_max(h, step) AS h FROM walk GROUP BY r),
proofs AS (SELECT r, string_agg(coalesce(h, ''), '' ORDER BY lvl) AS p FROM climb GROUP BY r),
root AS (SELECT h FROM tops WHERE n = 1)
SELECT o.doc_id, o.leaf, g.h AS subroot, root.h AS root, sha256(coalesce(proofs.p, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root.h AS verified
FROM own o JOIN groups g ON o.lang IS NOT DISTINCT FROM g.lang JOIN folded USING (r) LEFT JOIN proofs USING (r) CROSS JOIN root
"""
