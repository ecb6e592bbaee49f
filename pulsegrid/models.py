"""Calls of models outside, in batches: one model to a Python worker, and an item that fails costs only its own answer."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A model answers a list of texts with as many answers.
Model = Callable[[list[str]], list[str | None]]


def tried(model: Model, texts: list[str]) -> list[str | None]:
    """The model's answers. A call that fails, or gives too few, is made again for each half, so that only single items that fail get none."""
    try:
        out = list(model(texts))
        if len(out) == len(texts):
            return out
    except Exception:  # a model may fail in any way; what it costs is the item's answer
        pass
    half = len(texts) // 2
    return [*tried(model, texts[:half]), *tried(model, texts[half:])] if half else [None]


def answers(text: Column, make: Callable[[], Model], batch: int = 16) -> Column:
    """The answers of the model that make() loads, once a worker, to a column of texts; null without text, and where it fails."""

    def load():
        model = make()

        def run(texts: np.ndarray) -> np.ndarray:
            out = np.full(len(texts), None, object)
            asked = [i for i, t in enumerate(texts) if t]
            if asked:
                out[asked] = tried(model, [str(texts[i]) for i in asked])
            return out

        return run

    return predict_batch_udf(load, return_type=StringType(), batch_size=batch)(F.coalesce(text, F.lit("")))


def editor() -> Model:
    """Stand-in for the summariser's model: headline and summary from the first lines, a category by length, as JSON with what it cost."""

    def one(text: str) -> str:
        lead = text.removeprefix("- ")
        summary = lead[:300]
        category = ("Siyaset", "Spor", "Sanat")[len(text) % 3]
        return json.dumps({"headline": lead[:40], "summary": summary, "category": category, "is_relevant_to_turkey": len(text) % 7 != 0, "input_tokens": len(text) // 4, "output_tokens": len(summary) // 4}, ensure_ascii=False)

    return lambda texts: [one(t) for t in texts]
