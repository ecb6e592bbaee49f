import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from pulsegrid.llm import dsir

from .helpers import ODD, clashing, folder, plain

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def features(text, orders=3):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % 10000 for k in range(1, orders + 1) for i in range(len(ws) - k + 1)]


def brute(docs, items):
    own, aim = [features(t) for _, t in docs], Counter(b for _, t in items for b in features(t)[1])
    s = Counter(b for _, f in own for b in f)
    S, T = s.total(), aim.total()
    gain = {b: math.floor(1000 * math.log(((aim[b] + 1) * (S + 10000)) / ((s[b] + 1) * (T + 10000)))) for b in s}
    rows = []
    for (doc_id, _), (n, f) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((n, doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is not None, r[1] or 0, r[2]))
    drawn = 5 * len(may) // 100
    return sorted([(*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(may)] + [(*r[1:], None) for r in rows if r[0] < 20], key=repr)


LONG = [(i, " ".join(f"W{(i * i + j * i) % 23}" + ("é" if j % 9 == i % 9 else "") for j in range(15 + i % 12)), "en", "a", 1) for i in range(100, 240)]
TIED = [(5, "tie " * 25, "en", "a", 1)] * 30 + [(None, "null id " * 15, "en", "b", 1)] * 30
BENCH = [(1, "The quick brown fox, w1 w2 w3"), (1, "w5 W6 w7 w8"), (2, None), (3, ""), (None, "tie tie tie")]


@pytest.mark.parametrize("case", ["odd", "tied", "clash", "none", "no items"])
def test_query(spark, tmp_path, case):
    rows, schema = {"clash": lambda: clashing(["_Row", "pos", "w1", "b1", "Bucket", "_at"]), "none": lambda: ([], None), "tied": lambda: (LONG + TIED, None)}.get(case, lambda: (ODD + LONG, None))()
    schema = schema or "doc_id long, text string, lang string, source string, n_chars long"
    items = [] if case == "no items" else BENCH
    path = folder(spark, tmp_path, rows, schema, benchmark=(items, ITEMS))
    got = plain(dsir.op13_dsir(spark, path))
    assert got == brute([r[:2] for r in rows], items)
    if case in ("odd", "tied"):
        assert sum(r[-1] is not None for r in got) > 0


def test_the_target_is_drawn_more_often(spark):
    docs = spark.createDataFrame([(i, ("like the target text here " if i % 10 == 0 else "something that is quite unlike ") * 8) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([("like the target text here",)] * 20, "text string")
    drawn = dsir.resample(docs, target, percent=10).filter("rank IS NOT NULL").collect()
    assert len(drawn) == 40 and all(r.doc_id % 10 == 0 for r in drawn)
