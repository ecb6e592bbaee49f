import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.llm import joins

from .helpers import ODD, SCHEMA, clashing, folder, plain


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """Class and links of each row, by comparing all pairs."""
    sets = [slow_shingles(r[1]) for r in rows]
    up, n_links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or (a and b and len(a & b) >= 0.8 * len(a | b)):
                n_links[i] += 1
                n_links[j] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return sorted(((r[0], min(least[root(i)], default=None), n_links[i]) for i, r in enumerate(rows)), key=repr)


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice("xyzuvw") + str(rng.randrange(99))
    return out


def planted():
    rng, rows = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    for _ in range(40):
        words = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            rows.append(near(rng, words, rng.choice([0, 0, 1, 2, 4])))
    shared = [word() for _ in range(60)]
    rows += [[word() for _ in range(80)] + shared for _ in range(20)]
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(w), "en", "a", 1) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    return rows


def test_posterior():
    # a pair at the threshold is dropped about once in ten million comparisons; one at 0.3 soon goes
    rng, least = np.random.default_rng(0), joins.least_matches()
    assert least == sorted(least) and len(least) == joins.HASHES // joins.STEP
    for s, most in ((0.8, 0), (0.3, 20)):
        equal = (rng.random((2000, joins.HASHES)) < s).astype(np.uint32)
        left = joins.survivors(np.ones(joins.HASHES, np.uint32), equal)
        assert len(left) == 2000 if not most else len(left) < most


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        x = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
        n = int(len(x) * share)
        a, b = x[: (len(x) + n) // 2], np.concatenate((x[:n], x[(len(x) + n) // 2 :]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((joins.signature(a) == joins.signature(b)).mean() - true) < 0.09


@pytest.mark.parametrize("query", ["sf", "planted", "chunks", "odd", "clash", "none"])
def test_op8_against_brute_force(spark, sf, tmp_path, query, monkeypatch):
    if query == "chunks":
        from pyspark.sql import functions as F  # noqa: F401

        monkeypatch.setattr(joins, "CHUNK_NODES", 2)
    path = {"sf": lambda: sf, "planted": lambda: folder(spark, tmp_path, planted()), "chunks": lambda: folder(spark, tmp_path, planted()), "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(["key", "rep", "links", "root", "at"])), "none": lambda: folder(spark, tmp_path, [])}[query]()
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in joins.op8_jaccard(spark, path).collect()), key=repr)
    assert got == brute(rows)


def test_op8_long_texts_leave_chunks_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "CHUNK_SHINGLES", 300)
    rng, rows = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [" ".join(near(rng, words, 2)) for _ in range(rng.choice([2, 3]))]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(rows)]
    got = sorted((tuple(r) for r in joins.op8_jaccard(spark, folder(spark, tmp_path, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_deduplicate_keeps_one_row_of_each_class(spark):
    rows, schema = clashing(["_key", "_at", "rep"])
    docs = spark.createDataFrame([*rows, *rows], schema)
    out = joins.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 2, 5, 6, 7, 8, None], key=repr)
    many = spark.createDataFrame(planted(), SCHEMA)
    assert {r.doc_id for r in joins.deduplicate(many).collect()} == {c for _, c, _ in brute([tuple(r) for r in many.collect()])}


def test_deduplicate_keeps_classes_that_share_their_least_doc_id(spark):
    rng, word = random.Random(3), "w{}".format
    texts = [[word(rng.randrange(10**6)) for _ in range(60)] for _ in range(12)]
    ids = [None] * 5 + [7] * 5 + [8, 9]
    rows = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, rows[0][1]), (7, rows[5][1]), (7, " ".join([*texts[6], "more"])), (3, rows[10][1]), (None, rows[11][1])]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in joins.deduplicate(docs).collect()]
    # of the two near texts under doc_id 7 either may stay; null is no least where there is another doc_id
    assert sorted((t.removesuffix(" more") for _, t in got)) == sorted(" ".join(t) for t in texts)
    assert sorted((i for i, _ in got), key=repr) == sorted([None] * 5 + [7] * 5 + [3, 9], key=repr)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in joins.components(edges, "chain").collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_the_row_that_stays_does_not_depend_on_partitions(spark):
    text = "one text of more than five words that all rows share"
    docs = spark.createDataFrame([(7, text, "en", f"s{i}", i) for i in range(8)] + [(None, text[::-1], "en", f"s{i}", i) for i in range(5)], "doc_id long, text string, lang string, _Place string, n_chars long")
    kept = [plain(joins.deduplicate(docs.repartition(n, "n_chars"))) for n in (1, 3, 8)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2
