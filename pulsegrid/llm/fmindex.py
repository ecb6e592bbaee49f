"""Benchmark decontamination: an FM-index for each shard of the training texts, searched for the phrases of the benchmark.

A shard is a few megabytes of texts, as they are read, in words. Its suffix array comes from doubling the compared length, where only
suffixes that still tie are sorted again; the Burrows-Wheeler transform goes into a wavelet matrix with bit-packed ranks, and every 16th text
position keeps its place. All phrases are searched backwards together, a step each a word, and the rows found walk back
to the next sampled position. Where phrases occur, the words covered are merged to spans, which is what is to be removed.

Phrases come in blocks of at most ``BLOCK`` windows, so that what is broadcast at once is bounded; a benchmark of any size is a number
of blocks, and each shard's index is built once for all of them. Nothing is shuffled. A text longer than a shard is cut into
pieces that overlap by one word less than a window, so no occurrence is lost and a task's memory is bounded by a shard's and a text's size.

Defined results: words and windows as in the contract, A-Z lowered; an item with fewer words than a window is one window, one without words has none. A null
or empty text has no words and no hits; an item without id is listed as an empty name; items alike in id are one; equal texts get equal results;
no benchmark, no hits; an empty table gives an empty result. Other columns are carried along by decontaminate() and left out by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import fresh, plain_words, ranked, stash, table

WINDOW, BLOCK, SHARD, SAMPLE = 10, 100_000, 6 << 20, 16
SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


# --- Index -------------------------------------------------------------------------------------------------------------


def _starts(key: np.ndarray) -> np.ndarray:
    """Where a sorted key differs from the one before."""
    out = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=out[1:])
    return out


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """The order of the suffixes of s, whose last symbol occurs nowhere else; symbols below sigma."""
    n, bits = len(s), max(1, int(sigma).bit_length())
    h = max(1, 62 // bits)
    key = s.astype(np.int64)
    for j in range(1, h):
        key <<= bits
        key[: max(0, n - j)] |= s[j:]
    sa = np.argsort(key)
    new = _starts(key[sa])
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = ~(new & np.append(new[1:], True))
    rows = np.flatnonzero(tied)
    while len(rows):
        sub = sa[rows]
        key = rank[sub] * n + rank[sub + h]
        order = np.argsort(key)
        sub, key = sub[order], key[order]
        sa[rows] = sub
        new = _starts(key)
        rank[sub] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rows = rows[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class Bits:
    """Bits with the count of ones before each place."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        whole = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        whole[: len(packed)] = packed
        self.words = whole.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class FmIndex:
    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        """s: symbols below sigma; the last occurs nowhere else."""
        sa = suffix_array(s, sigma)
        self.n, self.depth = len(s), max(1, int(sigma - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])  # rows that start with a lesser symbol
        sampled = sa % sample == 0
        self.marked, self.samples = Bits(sampled), sa[sampled]
        last, self.levels = s[sa - 1], []
        del sa
        for bit in reversed(range(self.depth)):
            ones = (last >> bit) & 1 != 0
            self.levels.append(Bits(ones))
            last = np.concatenate([last[~ones], last[ones]])
        self.first = np.zeros(sigma, np.int64)  # where a symbol's run begins below the last level
        runs = np.flatnonzero(_starts(last))
        self.first[last[runs]] = runs

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [lo, hi) that start with each phrase; phrases stand at the right of their rows."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            own = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(own):
                break
            c = phrases[own, phrases.shape[1] - 1 - step]
            ends = np.concatenate([lo[own], hi[own]])
            both = np.concatenate([c, c])
            for j, level in enumerate(self.levels):
                ones = (both >> (self.depth - 1 - j)) & 1 != 0
                r = level.rank(ends)
                ends = np.where(ones, level.zeros + r, ends - r)
            ends += (self.before[:-1] - self.first)[both]
            lo[own], hi[own] = ends[: len(own)], ends[len(own) :]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows."""
        out, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(rows):
            there = self.marked.get(rows)
            out[at[there]] = self.samples[self.marked.rank(rows[there])] + steps
            at, rows = at[~there], rows[~there]
            symbol = np.zeros(len(rows), np.int64)
            for level in self.levels:
                ones, r = level.get(rows), level.rank(rows)
                symbol = symbol << 1 | ones
                rows = np.where(ones, level.zeros + r, rows - r)
            rows = rows + self.before[symbol] - self.first[symbol]
            steps += 1
        return out


# --- Shards of texts ---------------------------------------------------------------------------------------------------


class Words:
    """The words of consecutive texts: where they are in the bytes, and which are each text's."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets = offsets
        inside = _IN_WORD[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
        self.starts, self.ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        ends = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        self.words = pa.Array.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOW[data[inside]])])

    def index(self) -> tuple[FmIndex, pa.Array, np.ndarray]:
        """The index, the words that its symbols stand for, and where the texts end in it, each with a symbol of its own."""
        coded = self.words.dictionary_encode()
        counts = np.diff(self.first)
        counts = counts[counts > 0]
        ends = np.cumsum(counts) + np.arange(len(counts))
        s = np.empty(len(self.starts) + len(counts), np.int32)
        inside = np.ones(len(s), bool)
        inside[ends] = False
        s[inside] = coded.indices.to_numpy(zero_copy_only=False)
        s[ends] = len(coded.dictionary) + np.arange(len(counts))
        return FmIndex(s, len(coded.dictionary) + len(counts)), coded.dictionary, ends


def shards(texts: pa.Array, limit: int, overlap: int) -> Iterator[tuple[int, int, int, np.ndarray, Words]]:
    """Consecutive texts of up to ``limit`` bytes, or pieces of one text: its first text, the words and bytes of that text before it, bytes, words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        own = data[offsets[a] : offsets[b]]
        if len(own) <= limit:
            yield a, 0, 0, own, Words(own, offsets[a : b + 1] - offsets[a])
        else:  # one text
            at, words, size = 0, 0, limit
            while at < len(own):
                end = min(len(own), at + size)
                while end < len(own) and _IN_WORD[own[end - 1]] and _IN_WORD[own[end]]:
                    gaps = np.flatnonzero(~_IN_WORD[own[end : end + limit]])
                    end = end + int(gaps[0]) if len(gaps) else min(len(own), end + limit)
                piece = Words(own[at:end], np.array([0, end - at]))
                n = len(piece.starts)
                if end < len(own) and 0 < n <= 2 * overlap:
                    size *= 2  # of long words, a piece needs more than its share of bytes
                    continue
                yield a, words, at, own[at:end], piece
                if end == len(own):
                    break
                words, at, size = words + max(0, n - overlap), at + int(piece.starts[n - overlap]) if n else end, limit
        a = b


class Phrases:
    """A block of windows (words, item), all of them distinct; windows come in order, so that equal ones stand together."""

    def __init__(self, windows: list[str], items: list[str]) -> None:
        split = [w.encode().split(b" ") for w in windows]
        coded = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
        new = [i for i, w in enumerate(windows) if not i or w != windows[i - 1]]
        self.vocabulary, self.items = coded.dictionary, items
        self.items_from = np.array([*new, len(windows)], np.int64)
        lengths = np.array([len(ws) for ws in split], np.int64)
        ends = np.cumsum(lengths)
        ids = coded.indices.to_numpy(zero_copy_only=False)
        width = int(lengths.max(initial=1))
        self.lengths, self.table = lengths[new], np.full((len(new), width), -1, np.int64)
        for row, i in enumerate(new):
            self.table[row, width - lengths[i] :] = ids[ends[i] - lengths[i] : ends[i]]

    def found(self, index: FmIndex, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The phrase and the position of each occurrence."""
        known = pc.fill_null(pc.index_in(self.vocabulary, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        table = np.append(known, 0)[self.table]  # what stands before a short phrase is never read
        there = np.flatnonzero((table >= 0).all(axis=1))
        lo, hi = index.search(table[there], self.lengths[there])
        n = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        return np.repeat(there, n), index.locate(rows)


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(first word, word after the last, first byte, byte after the last), those that touch as one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, x, y in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2], y)
        else:
            out.append((a, b, x, y))
    return out


class Found:
    """Of each text: how many words it has, which words are covered, and by which items."""

    def __init__(self, texts: pa.Array, blocks: list[Phrases | Broadcast], limit: int = SHARD) -> None:
        n = len(texts)
        self.n_words, self.spans, self.items = np.zeros(n, np.int64), [[] for _ in range(n)], [set() for _ in range(n)]
        for doc, words_before, bytes_before, _, words in shards(texts, limit, WINDOW - 1):
            docs = len(words.first) - 1
            self.n_words[doc : doc + docs] = np.maximum(self.n_words[doc : doc + docs], words_before + np.diff(words.first))
            if len(words.starts) and blocks:
                self._search(words, blocks, doc, words_before, bytes_before)
        self.spans = [merged(s) if s else s for s in self.spans]

    def _search(self, words: Words, blocks: list, doc: int, words_before: int, bytes_before: int) -> None:
        index, dictionary, ends = words.index()
        cover = np.zeros(len(words.starts) + 1, np.int64)
        for block in blocks:
            phrases = block.value if isinstance(block, Broadcast) else block
            which, at = phrases.found(index, dictionary)
            at -= np.searchsorted(ends, at)  # words before, without the ends of texts
            cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + phrases.lengths[which], minlength=len(cover))
            pairs = np.unique(np.stack([np.searchsorted(words.first, at, "right") - 1, which]), axis=1)
            for d, p in pairs.T.tolist():
                self.items[doc + d].update(phrases.items[phrases.items_from[p] : phrases.items_from[p + 1]])
        hit = np.cumsum(cover[:-1]) > 0
        if not hit.any():
            return
        begins, stops = hit.copy(), hit.copy()
        begins[1:] &= ~hit[:-1]
        stops[:-1] &= ~hit[1:]
        inner = words.first[(words.first > 0) & (words.first < len(hit))]  # a span ends where its text ends
        begins[inner] = hit[inner]
        stops[inner - 1] = hit[inner - 1]
        a, b = np.flatnonzero(begins), np.flatnonzero(stops)
        d = np.searchsorted(words.first, a, "right") - 1
        for k, x, y in zip(d.tolist(), a.tolist(), b.tolist(), strict=True):
            w = words_before - int(words.first[k])
            z = bytes_before - int(words.offsets[k])
            self.spans[doc + k].append((x + w, y + 1 + w, int(words.starts[x]) + z, int(words.ends[y]) + z))

    def n_hit(self) -> list[int]:
        return [sum(b - a for a, b, _, _ in s) for s in self.spans]


# --- Tables ------------------------------------------------------------------------------------------------------------


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, phrase: the distinct windows of items (item_id, text)."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), plain_words(F.col("text")).alias("ws")).filter("ws IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("ws", i, window), " "))).alias("phrase")).distinct()


def phrase_blocks(items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> list[Broadcast]:
    """The windows of items as broadcasts of at most ``block`` windows each; one block at a time passes through the driver."""
    context = items.sparkSession.sparkContext
    numbered = stash(ranked(windows(items, window), [], ["phrase", "item"], "at", "fm-windows"), "fm-phrases")
    n, out = numbered.count(), []
    for first in range(0, n, block):
        rows = numbered.filter(F.col("at").between(first, first + block - 1)).orderBy("at").collect()
        out.append(context.broadcast(Phrases([r.phrase for r in rows], [r.item for r in rows])))
    return out


def _code_points(text: str, spans: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    raw = text.encode()
    if len(raw) == len(text):
        return [{"start": x, "end": y} for _, _, x, y in spans]
    at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"start": int(at[x]), "end": int(at[y])} for _, _, x, y in spans]


def _scanned(blocks: list[Broadcast], limit: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = Found(texts, blocks, limit)
            spans = [_code_points(texts[i].as_py(), s) if s else [] for i, s in enumerate(found.spans)]
            items = [sorted(x) for x in found.items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.n_words), pa.array(found.n_hit(), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as strings, sorted) and spans (of code points, end exclusive) for each of docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scanned(phrase_blocks(items, window, block), shard), f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans {SPANS}")


def _cleaned(blocks: list[Broadcast], limit: int, out: str):
    def run(batches):
        for batch in batches:
            texts, left = batch.column("text"), []
            for text, spans in zip(texts, Found(texts, blocks, limit).spans, strict=True):
                text = text.as_py()
                if spans:
                    raw, at, parts = text.encode(), 0, []
                    for _, _, x, y in spans:
                        parts.append(raw[at:x])
                        at = y
                    text = b"".join([*parts, raw[at:]]).decode()
                left.append(text)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(left, pa.string())], [*names, out])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """docs, all rows and columns, without the words that any window of items covers."""
    out = fresh(docs, "_left")
    rest = [f for f in docs.schema.fields if f.name != "text"]
    cleaned = docs.mapInArrow(_cleaned(phrase_blocks(items, window, block), shard, out), StructType([*rest, StructField(out, StringType())]))
    return cleaned.withColumnRenamed(out, "text").select(*docs.columns)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH texts AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, id, r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts),
p AS (SELECT DISTINCT id, least(len(ws), 10) AS k, unnest(list_transform(range(1, greatest(len(ws) - 8, 2)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS phrase FROM w WHERE kind = 'b' AND len(ws) > 0),
o AS (SELECT r, k, unnest(range(1, len(ws) - k + 2)) AS i, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w CROSS JOIN (SELECT DISTINCT k FROM p) WHERE kind = 'd' AND len(ws) >= k),
f AS (SELECT DISTINCT o.r, o.i, o.k, p.id FROM o JOIN p ON o.phrase = p.phrase AND o.k = p.k),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT r, i, k FROM f)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id::VARCHAR AS id FROM f) GROUP BY r)
SELECT id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (r) LEFT JOIN n USING (r) WHERE kind = 'd'
"""
