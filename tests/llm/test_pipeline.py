import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import decoders

from pulsegrid.llm import mix, secrets, tokens

from .helpers import ODD, SCHEMA, folder
from .test_joins import brute
from .test_quality import LABELS

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def stages(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(f(spark, docs, path), "test")
        out.append(docs)
    return out


def check(spark, path, alone=False):
    """``alone``: no two different texts of the table are alike, so that each distinct row is a class."""
    given, good, single, clean, mixed, packed = stages(spark, path)
    for df in (good, single, clean, mixed):
        assert df.columns == given.columns
    rows = lambda df: Counter(map(tuple, df.collect()))
    assert not rows(good) - rows(given)
    own = [tuple(r) for r in good.select("doc_id", "text").collect()]
    assert not rows(single) - rows(good)
    if alone:
        assert rows(single) == Counter(set(rows(good)))
    else:
        assert sorted((r.doc_id for r in single.collect()), key=repr) == sorted({c for _, c, _ in brute(own)}, key=repr)
    vocabulary = secrets.ranks(secrets.vocabulary_path())
    want = Counter()
    for r in single.collect():
        text = secrets.blank(r.text, secrets.scan_text(r.text, vocabulary))
        want[(r.doc_id, text, r.lang, r.source, None if text is None else len(text), *r[5:])] += 1
    assert rows(clean) == want
    drawn = Counter()
    for r in mix.mix(clean.withColumn("size", mix.words(clean["text"])), "size").collect():
        if r.copies:
            drawn[tuple(r[: len(given.columns)])] += r.copies
    if alone:  # rows alike in doc_id and size are told apart by a hash, which differs between the two calls
        assert sum(rows(mixed).values()) == sum(drawn.values()) and not set(rows(mixed)) - set(rows(clean))
    else:
        assert rows(mixed) == drawn
    # the ids themselves, put together by row, are the library's for each row of the mix, and give its text back
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary_path())
    library.decoder = decoders.ByteLevel()
    want = Counter((r.doc_id, (*library.encode(r.text or "", add_special_tokens=False).ids, 0)) for r in mixed.collect())
    whole, used = defaultdict(list), defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.row, r.start)):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == sum(map(len, whole[r.row, r.doc_id]))
        whole[r.row, r.doc_id].append(r.ids)
        used[r.sequence_id].append((r.offset, r.length))
    got = Counter((doc, tuple(x for ids in lists for x in ids)) for (_, doc), lists in whole.items())
    assert got == want
    assert Counter((doc, library.decode(ids[:-1], skip_special_tokens=False)) for doc, ids in got.elements()) == Counter((r.doc_id, r.text or "") for r in mixed.collect())
    for spans in used.values():
        assert [a for a, _ in sorted(spans)] == [0, *np.cumsum([n for _, n in sorted(spans)])[:-1].tolist()] and sum(n for _, n in spans) <= 1024
    return packed


def test_each_stage_against_brute_force(spark, sf):
    assert check(spark, sf).count()


def test_odd_and_empty_tables(spark, tmp_path):
    check(spark, folder(spark, tmp_path, ODD, labels=LABELS))
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], labels=LABELS)).count() == 0


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    texts = [f"{a} document number {a} with {b} of its own {a}{b} and some more plain words that nobody else has said {b}{b}" for a in ("red", "blue", "green") for b in ("river", "table", "cloud", "stone")]
    ids = [None, None, None, 1, 1, 1, 5, 5, 6, 7, 8, 9]
    rows = [(i, t, "en", "a", len(t), "x", "y", "z") for i, t in zip(ids, texts, strict=True)]
    path = folder(spark, tmp_path, rows * 2, SCHEMA + ", _found string, row string, ids string", labels=LABELS)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    single = corpus_pipeline.near_duplicates(spark, docs, path)
    assert Counter(map(tuple, single.collect())) == Counter(rows)
    check(spark, path, alone=True)


def test_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "packing"]
