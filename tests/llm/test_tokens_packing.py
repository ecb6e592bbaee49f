import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import packing, spans, tokens

from .helpers import ODD, clashing, folder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


TEXTS = ["a  b", "a \n b", "a\t b  c", "x <|endoftext|> y", "<|endoftext|>", "\n\n\n  x   ", "  ", "don't we'll  's 'll", "é ü x", " \n \n x", "...  ...\n\n!\n", "a\n b", "a \nb", "日本 語\n\n", "x² ½ a", "naïve ×÷ ªº", "a ", " a", "", None, "'re''s'd x'LL"]


def ids_of(enc, texts):
    out = []
    for _, part in spans.slices(pa.array(texts, pa.string()), 300):
        flat, sizes = enc.of(part)
        out += [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    return out


def test_ids_are_the_librarys(library):
    for enc in (tokens.Encoder(tokens.vocabulary_path(), 5), tokens.Encoder(tokens.vocabulary_path())):
        for _ in range(2):
            assert ids_of(enc, TEXTS) == [[*library(x), 0] for x in TEXTS]


def test_ids_of_random_texts(library):
    rng, enc = random.Random(3), tokens.Encoder(tokens.vocabulary_path(), 20)
    bits = ["a", "the", "S", "é", "'s", "'", "1", " ", " ", " ", "\n", "\n", "\n\n", "!", ".", ",", "?!", "ing", "\t", "日", "foo, ", "x. "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for text, got in zip(texts, ids_of(enc, texts), strict=True):
        assert got == [*library(text), 0], text


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("query", ["sf", "odd", "clash", "none"])
def test_op2_against_brute_force(spark, sf, tmp_path, library, query):
    extra = ["part", "ids", "n_tokens", "start", "base"]
    path = {"sf": lambda: sf, "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(extra)), "none": lambda: folder(spark, tmp_path, [])}[query]()
    docs = sorted(((r[0], r[1]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0]))
    want, at = [], 0
    for doc, text in docs:
        ids = [*library(text), 0]
        want.append((doc, at, len(ids), crc(ids)))
        at += len(ids)
    got = [tuple(r) for r in tokens.op2_tokens(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_files_keep_order_encoding_and_page_index(spark, sf):
    import pyarrow.parquet as pq

    t = tokens.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), tokens.vocabulary_path())
    for f in t.inputFiles():
        m = pq.ParquetFile(f.removeprefix("file:"))
        own = m.read(columns=["doc_id"])["doc_id"].to_pylist()
        assert own == sorted(own)
        for g in range(m.metadata.num_row_groups):
            group = m.metadata.row_group(g)
            by = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["doc_id"].has_column_index and by["doc_id"].has_offset_index
    assert "ids" not in tokens.starts(t).columns


def test_documents_are_read_by_pages(spark, library):
    texts = [f"word {i} " + "x y z " * (i % 7) for i in range(30_000)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "none"), (70, "again")], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        t = tokens.write_tokens(docs, tokens.vocabulary_path())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for asked, most in ([70, 71, 70], 8_000), ([29_999, None, 5], 30_002), (list(range(20_000, 20_030)), 8_000), ([-1, 10**9], 30_002), ([], 0):
        some = tokens.of_documents(t, asked)
        want = [(i, [*library(x), 0]) for i, x in [*enumerate(texts), (None, "none"), (70, "again")] if i in asked]
        assert sorted(((r.doc_id, r.ids) for r in some.select("doc_id", "ids").collect()), key=repr) == sorted(want, key=repr)
        read = some.select("doc_id", "ids")
        read.collect()
        leaf = read._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert not asked or leaf.metrics().apply("numOutputRows").value() <= most


def test_a_doc_id_may_fill_several_files(spark):
    rows = [(7, f"copy {i}") for i in range(600)] + [(None, f"none {i}") for i in range(600)] + [(i, f"own {i}") for i in range(300)] + [(8, "same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n in (1, 9):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            t = tokens.write_tokens(docs, tokens.vocabulary_path())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        got = [(r.part, r.part_start, r.doc_id, tuple(r.ids)) for r in t.collect()]
        assert len(got) == len(rows)
        order = [(d is not None, d) for _, _, d, _ in sorted(got, key=lambda r: r[:2])]
        assert order == sorted(order)
        files = {d: {r[0] for r in got if r[2] == d} for d in (7, None)}
        assert all(len(f) == 1 if n == 1 else len(f) >= 2 for f in files.values())


def test_long_batches_are_cut(spark, library, monkeypatch):
    kind = np.dtype("<u2")
    rows = [[5, 0], [0], [*range(1, 40), 0], [7, 8, 0], [0]]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4, 5], "tie": [0] * 5, "width": pa.array([2] * 5, pa.int8()), "packed": pa.array([np.array(x, kind).tobytes() for x in rows], pa.binary())})
    monkeypatch.setattr(tokens.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 3})()))
    for most in (1, 4, 1000):
        monkeypatch.setattr(tokens, "BATCH_IDS", most)
        out = [r for b in tokens._placed([batch.slice(1), batch.slice(0, 0), batch]) for r in b.to_pylist()]
        both = rows[1:] + rows
        assert [r["ids"] for r in out] == both and [r["n_tokens"] for r in out] == [len(x) for x in both]
        assert [r["part_start"] for r in out] == [sum(map(len, both[:i])) for i in range(len(both))] and {r["part"] for r in out} == {3}


def best_fit(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in room if c >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    return sorted(room)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(150):
        window = rng.choice([8, 64, 1024])
        lengths = [rng.randint(1, window - 1) for _ in range(rng.randint(0, 300))] + [rng.randint(1, window - 1)] * rng.choice([0, 200])
        fill = defaultdict(list)
        for length, rank, n, first, each, offset in packing.plan(Counter(lengths), window):
            for i in range(n):
                fill[first + i // each].append((offset + i % each * length, length))
        for pieces in fill.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= window
        assert sorted(window - sum(n for _, n in p) for p in fill.values()) == best_fit(lengths, window)


@pytest.mark.parametrize("query", ["sf", "odd", "clash", "none"])
def test_op5_packs_every_id_once(spark, sf, tmp_path, library, query):
    path = {"sf": lambda: sf, "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(["start", "length", "_rank", "ids"])), "none": lambda: folder(spark, tmp_path, [])}[query]()
    docs = [(r[0], [*library(r[1]), 0]) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.op5_packing(spark, path).collect()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    want = Counter((d, a, len(ids[a : a + 1024]), crc(ids[a : a + 1024]), len(ids)) for d, ids in docs for a in range(0, len(ids), 1024))
    assert pieces == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(by) == list(range(len(by)))
    rests = [len(ids) % 1024 for _, ids in docs if len(ids) % 1024]
    assert len(by) == sum(len(ids) // 1024 for _, ids in docs) + len(best_fit(rests, 1024))


def test_pack_keeps_ids(spark, library):
    docs = spark.createDataFrame([(r[0], r[1]) for r in ODD], "doc_id long, text string")
    whole = {r[0]: [*library(r[1]), 0] for r in ODD}
    rows = packing.pack(docs, tokens.vocabulary_path(), 16, keep_ids=True).collect()
    for r in rows:
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length] and crc(r.ids) == r.ids_crc32
    assert len({r.row for r in rows}) == len(ODD) and len({(r.row, r.start) for r in rows}) == len(rows)
