import math
from collections import Counter, defaultdict

import pytest

from pulsegrid.llm import mix, shards

from .helpers import ODD, SCHEMA, clashing, folder, plain


def fill(sizes, share=1.5, cap=2.0):
    """Share by weight, cap, share the excess anew until none is above: as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.remove(s)
    return target


@pytest.mark.parametrize("query", ["sf", "odd", "clash", "none"])
def test_op6_meets_targets(spark, sf, tmp_path, query):
    path = {"sf": lambda: sf, "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(["size", "_rank", "target", "copies"])), "none": lambda: folder(spark, tmp_path, [])}[query]()
    source = Counter()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "source", "text").collect()
    import re

    size = [len(re.findall(mix.WORD, r.text or "")) for r in docs]
    for r, n in zip(docs, size, strict=True):
        source[r.source] += n
    target = fill(source)
    got = mix.op6_mix(spark, path).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d.doc_id, n) for d, n in zip(docs, size, strict=True))
    name = {(d.doc_id, n): d.source for d, n in zip(docs, size, strict=True)}
    taken, largest = Counter(), Counter()
    for r in got:
        s = name[r.doc_id, r.size]
        assert r.source_size == source[s] and math.isclose(r.target, target[s], abs_tol=1e-6)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in source:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    assert plain(mix.op6_mix(spark, path)) == sorted((tuple(r) for r in got), key=repr)


def test_mixed_draws_what_mix_says(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 4}", i) for i in range(60)] + [(100, "same words here", "en", "s1", 1)] * 7 + [(None, "x y", "en", None, 1)] * 3 + [(100, "other words here", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in mix.mix(docs.withColumn("size", mix.words(docs["text"])), "size").collect():
        want[tuple(r)[:5]] += r.copies
    got = Counter(map(tuple, mix.mixed(docs).collect()))
    # rows alike share the draws of all of them; others have their own
    assert got == +want and sum(got.values()) > 60


def test_mixed_returns_documents(spark):
    rows, schema = clashing(["copies", "target", "_words"])
    docs = spark.createDataFrame(rows, schema)
    out = mix.mixed(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {r[0] for r in ODD}


def jump_hash(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_one(spark):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(5, 3000, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 24, 100):
        assert {r.k: r.s for r in df.select("k", shards.jump(F.col("k"), n)["shard"].alias("s")).collect()} == {k: jump_hash(k % 2**64, n) for k in keys}


@pytest.mark.parametrize("query", ["sf", "odd", "clash", "none"])
def test_op9_law_and_slots(spark, sf, tmp_path, query):
    import zlib

    path = {"sf": lambda: sf, "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(["shard", "slot", "size", "_at"])), "none": lambda: folder(spark, tmp_path, [])}[query]()
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    got = shards.op9_shards(spark, path).collect()
    want = Counter((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, of = defaultdict(list), {}
    for r in got:
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        assert of.setdefault(r.doc_id, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shard_and_mix_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(i, "a", i + 1, "w", "x", "y", "z", "v") for i in range(40)], "doc_id long, source string, size long, _jump string, shard string, slot string, Target string, copies string")
    out = shards.shard(docs, "doc_id", ["size"])
    assert sorted(out.columns) == sorted([*docs.columns, "grown_shard"]) and {(r._jump, r.Target) for r in out.collect()} == {("w", "z")}
    assert [dict(out.dtypes)[c] for c in ("shard", "slot")] == ["int", "bigint"]
    out = mix.mix(docs, "size")
    assert sorted(out.columns) == sorted([c for c in docs.columns if c != "Target"] + ["source_size", "target"]) and {r.slot for r in out.collect()} == {"y"}
    for wrong in (lambda: shards.shard(docs, "slot", []), lambda: mix.mix(docs, "copies")):
        with pytest.raises(ValueError):
            wrong()
