import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import fmindex as fm

from .helpers import ODD, clashing, folder, plain

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, window=10):
    """Each window of each item against each place of each text."""
    found = []
    for doc_id, text in docs:
        low = lower(text)
        spans = [m.span() for m in WORD.finditer(low)]
        ws = [low[a:b] for a, b in spans]
        hit, ids = set(), set()
        for item_id, item in items:
            own = WORD.findall(lower(item))
            for i in range(max(1, len(own) - window + 1) if own else 0):
                w = own[i : i + window]
                for j in range(len(ws) - len(w) + 1):
                    if ws[j : j + len(w)] == w:
                        hit |= set(range(j, j + len(w)))
                        ids.add("" if item_id is None else str(item_id))
        merged = []
        for x in sorted(hit):
            if merged and merged[-1][1] == x:
                merged[-1][1] = x + 1
            else:
                merged.append([x, x + 1])
        found.append((doc_id, len(ws), len(hit), sorted(ids), [(spans[a][0], spans[b - 1][1]) for a, b in merged]))
    return found


def random_texts(seed, n, letters="ab", most=60):
    r = random.Random(seed)
    texts = [r.choice([" ", ", ", "-", "\n"]).join(r.choice(letters).upper() if r.random() < 0.2 else r.choice(letters) for _ in range(r.randrange(most))) for _ in range(n)]
    return texts + texts[: n // 3]


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_ranks_and_places(seed):
    r = np.random.default_rng(seed)
    sigma = int(r.integers(2, 70))
    s = np.append(np.tile(r.integers(0, sigma - 1, int(r.integers(1, 40))), int(r.integers(1, 9))), sigma - 1).astype(np.int32)
    text = s.tolist()
    assert fm.suffix_array(s, sigma).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    index = fm.FmIndex(s, sigma, sample=4)
    assert sorted(index.locate(np.arange(len(s))).tolist()) == list(range(len(s)))
    phrases = [text[a : a + k] for k in (1, 2, 5) for a in range(0, len(text) - k, 3)] + [[0, 0, 0, 0]]
    table = np.full((len(phrases), 5), -1)
    for i, p in enumerate(phrases):
        table[i, 5 - len(p) :] = p
    lo, hi = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + len(p)] == p]


@pytest.mark.parametrize("limit", [7, 50, 400, 1 << 20])
@pytest.mark.parametrize("letters", ["ab", ["a", "é", "日本", "x1"], "abcdefghij"])
def test_found_against_brute_force(letters, limit):
    """Texts cut into pieces of any size give the same words, hits, items and spans; blocks of phrases too."""
    texts = [*random_texts(3, 60, letters), "", None, " - ", "One", "ünï cödé a"]
    items = list(enumerate([*random_texts(8, 12, letters, 30), "One", "", None, "never to be found"])) + [(None, texts[0])]
    want = brute(enumerate(texts), items, 4)
    pairs = sorted({(" ".join(ws[i : i + 4]), "" if k is None else str(k)) for k, t in items for ws in [WORD.findall(lower(t))] if ws for i in range(max(1, len(ws) - 3))})
    blocks = [fm.Phrases([p for p, _ in part], [k for _, k in part]) for part in (pairs[:10], pairs[10:]) if part]
    array = pa.array(["left out", *texts], pa.string()).slice(1)
    found = fm.Found(array, blocks, limit)
    got = [(i, int(n), h, sorted(x), [(s["start"], s["end"]) for s in fm._code_points(t or "", sp)]) for i, (t, n, h, x, sp) in enumerate(zip(texts, found.n_words, found.n_hit(), found.items, found.spans, strict=True))]
    assert got == want


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
BENCH = [(1, PASSAGE), (2, "The quick, brown fox"), (2, "one"), (3, ""), (4, None), (None, "word " * 12), (10, PASSAGE.upper())]
DOCS = [*ODD, (20, f"before {PASSAGE.replace(' ', ', ')} after {PASSAGE}", "en", "a", 1), (21, PASSAGE[6:-3], "en", "a", 1), (22, "alpha beta gamma", "en", "a", 1)]


@pytest.mark.parametrize("case", ["odd", "clash", "none", "no items"])
def test_query(spark, tmp_path, case):
    rows, schema = {"clash": lambda: clashing(["Items", "spans", "N_words", "_left", "at"])}.get(case, lambda: ([] if case == "none" else DOCS, "doc_id long, text string, lang string, source string, n_chars long"))()
    items = [] if case == "no items" else BENCH
    path = folder(spark, tmp_path, rows, schema, benchmark=(items, ITEMS))
    want = [(d, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for d, n, h, x, _ in brute([r[:2] for r in rows], items)]
    assert plain(fm.op12_fm_index(spark, path)) == sorted(want, key=repr)


def test_blocks_and_removal(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long").withColumnRenamed("source", "_Left")
    items = spark.createDataFrame(BENCH, ITEMS)
    one, many = fm.scan(docs, items), fm.scan(docs, items, block=7, shard=20_000)
    assert plain(one) == plain(many)
    left = {r.doc_id: r for r in fm.decontaminate(docs, items).collect()}
    assert left[20].text == "before  after " and left[21].text == "" and left[22].text == "alpha beta gamma" and left[2].text is None
    assert left[1].text == " jumps over the lazy dog near the river bank" and left[1].asDict().keys() == set(docs.columns)
