import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import merkle

from .helpers import ODD, clashing, folder, plain


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """All levels, one node at a time."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(levels, i, fanout):
    path = []
    for level in levels[:-1]:
        a = i - i % fanout
        path.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
        i //= fanout
    return path


def expected(rows, fanout=2):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf((doc_id, source, lang, n_chars, text))
        tampered = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        claimed = leaf((doc_id, source, lang, n_chars + 1, text)) if tampered else own
        groups.setdefault(lang, []).append((doc_id, own, claimed))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[1] for x in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for g in names}
    top = tree([trees[g][-1][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for i, (doc_id, own, claimed) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            path = climb(trees[g], i, fanout) + climb(top, k, fanout)
            end = claimed
            for a, b in path:
                end = h(a, end, b)
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], h(*(a + b for a, b in path)), end, end == top[-1][0]))
    return sorted(out, key=repr)


MANY = [(i, f"text {i % 7}", f"l{i % 3}" if i % 5 else None, "s" if i % 4 else None, i if i % 6 else None) for i in range(150)]


@pytest.mark.parametrize("rows", [ODD, [], ODD[:1], MANY], ids=["odd", "none", "one", "many"])
def test_query(spark, tmp_path, rows):
    assert plain(merkle.op11_merkle(spark, folder(spark, tmp_path, rows))) == expected(rows)


def test_clashing_columns(spark, tmp_path):
    got = merkle.op11_merkle(spark, folder(spark, tmp_path, *clashing(["grp", "idx", "Digest", "block", "path", "_changed"])))
    assert plain(got) == expected(ODD)


@pytest.mark.parametrize(("fanout", "height"), [(2, 1), (2, 3), (3, 2), (5, 1)])
def test_blocks_of_any_size(spark, fanout, height):
    """Groups of 1 to 40 leaves, many of them more than a block, some exactly one; paths lead to the root by the plain fold."""
    leaves = [(g * 100 + i, f"g{g:02d}" if g else None, h(str(g), str(i))) for g in range(6) for i in range((1, 2, 8, 9, 40, 25)[g])]
    df = spark.createDataFrame(leaves, "doc_id long, grp string, digest string").withColumn("claimed", F.when(F.col("doc_id") % 3 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    got = merkle.manifest(df, fanout, height, with_paths=True).collect()
    trees = {g: tree([x[2] for x in leaves if x[1] == g], fanout) for g in {x[1] for x in leaves}}
    names = sorted(trees, key=lambda g: g or "")
    top = tree([trees[g][-1][0] for g in names], fanout)
    assert len(got) == len(leaves)
    where = {x[0]: (x[1], x[2]) for x in leaves}
    for r in got:
        g, own = where[r.doc_id]
        path = climb(trees[g], r.doc_id % 100, fanout) + climb(top, names.index(g), fanout)
        assert [tuple(s) for s in r.path] == path and r.leaf == own and r.root == top[-1][0] and r.subroot == trees[g][-1][0]
        assert merkle.fold(own, path) == r.root
        assert r.folded_root == merkle.fold(own[::-1] if r.doc_id % 3 == 0 else own, path)
