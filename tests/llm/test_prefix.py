import random

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import prefix
from pulsegrid.llm.tokens import vocabulary_path

from .helpers import clashing, folder
from .test_tokens_packing import TEXTS, library  # noqa: F401


@pytest.fixture(scope="module")
def counts():
    return prefix.Prefixes(vocabulary_path(), 50)


def test_every_prefix(counts, library):  # noqa: F811
    rng = random.Random(5)
    bits = ["a", "the", "S", "é", "'s", "'ll", "'re", "'v", "e", "'", "1", "23", " ", " ", "  ", "\n", "!", "ing", "\t", ". ", ", ", "\n\n", "日", "\U0001f600", "tion", "<|endoftext|>", "<|end"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(700)] + ["x" * 300, "ab" * 200, "qwkjzx8fhq" * 20]
    flat, sizes = counts.of(pa.array(texts))
    for text, steps in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        steps = steps.tobytes()
        assert len(steps) == len(text.encode())
        for n in range(1, len(text) + 1):
            assert prefix.count_at(steps, len(text[:n].encode())) == len(library(text[:n])), text[:n]


def test_budget_without_encoding(counts, library):  # noqa: F811
    text = "the quick brown fox's den is 12345 miles away, isn't it?  yes\n\n no" * 5
    steps = counts.of(pa.array([text]))[0].tobytes()
    for budget in (0, 1, 7, 50, 1000):
        fits = [n for n in range(len(text) + 1) if len(library(text[:n])) <= budget]
        assert prefix.longest_within(steps, budget) == max(fits)


@pytest.mark.parametrize("query", ["sf", "odd", "clash", "none"])
def test_op7_against_library(spark, sf, tmp_path, library, query):  # noqa: F811
    path = {"sf": lambda: sf, "odd": lambda: folder(spark, tmp_path), "clash": lambda: folder(spark, tmp_path, *clashing(["steps", "n_tokens"])), "none": lambda: folder(spark, tmp_path, [])}[query]()
    want = [(r[0], len((r[1] or "").encode()), n := len(library(r[1])), n > 1024) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r)[:4] for r in prefix.op7_token_counts(spark, path).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
