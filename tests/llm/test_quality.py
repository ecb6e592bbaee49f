import zlib

import numpy as np
import pytest

from pulsegrid.llm import quality

from .helpers import ODD, clashing, folder

LABELS = ([(1, 1, 0), (3, 0, 0), (7, 0, 1), (7, 1, 0), (99, 1, 0), (8, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.FACTORS)))
    index, value = np.array([3, 700, 2050]), np.array([0.5, -1.0, 2.0])
    pairs = sum(m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert np.isclose(m.raw(index, value, np.array([0]))[0], 0.3 + m.linear[index] @ value + pairs)


@pytest.mark.parametrize("query", ["odd", "clash", "none", "unlabelled"])
def test_op1_rows(spark, tmp_path, query):
    rows = {"odd": (ODD,), "clash": clashing(["_text", "score", "quality"]), "none": ([],), "unlabelled": (ODD,)}[query]
    path = folder(spark, tmp_path, *rows, labels=([], LABELS[1]) if query == "unlabelled" else LABELS)
    got = quality.op1_quality(spark, path).collect()
    assert len(got) == len(rows[0])
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    if query == "unlabelled":
        assert {r.score for r in got} == {0.5}


def test_op1_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op1_quality(spark, sf).collect()}
    own = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(own) > 40 and sum(r.predicted == q for r, q in own) / len(own) > 0.93
    good, poor = ([r.score for r, q in own if q == k] for k in (1, 0))
    assert sum(g > p for g in good for p in poor) / (len(good) * len(poor)) > 0.97


@pytest.mark.parametrize("names", [["_text", "_n", "_score"], ["_Text", "_N", "_SCORE"]])
def test_accepted_keeps_columns(spark, names):
    rows, schema = clashing(names)
    docs = spark.createDataFrame(rows, schema)
    blank = quality.Machine(0.0, np.zeros(quality.SIZE), np.zeros((quality.SIZE, quality.FACTORS)))
    out = quality.accepted(docs, blank)
    assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))


def test_scores_of_the_query_are_sums_over_pairs(spark, tmp_path):
    """Each score again from the fitted machine, pair of features by pair of features."""
    path = folder(spark, tmp_path, [r for r in ODD if r[0] != 7], labels=([(1, 1, 0), (3, 0, 0), (8, 0, 0)], LABELS[1]))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    m = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    want = []
    for r in docs.collect():
        index, value = quality.features(r.text, r.n_chars)
        raw = m.bias + sum(m.linear[i] * v for i, v in zip(index, value, strict=True))
        raw += sum(float(m.factors[index[a]] @ m.factors[index[b]]) * value[a] * value[b] for a in range(len(index)) for b in range(a))
        want.append((r.doc_id, 1 / (1 + np.exp(-raw))))
    got = [(r.doc_id, r.score) for r in quality.op1_quality(spark, path).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for (a, x), (b, y) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == b and abs(x - y) < 1e-4
