"""Stand-ins for models outside: same signatures, deterministic, replaceable."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, StringType

from .operators.vectors import shared_words

DIMENSIONS = 64


def embed_one(text: str | None) -> list[float]:
    """Hashed word counts, to unit length; zeros for no words."""
    v = np.zeros(DIMENSIONS)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % DIMENSIONS] += 1 if h & 1 << 30 else -1
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(embed_one)


@F.pandas_udf(BooleanType())
def same_event(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_words(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(StringType())
def summary(texts: pd.Series) -> pd.Series:
    """The first sentence; null, which closes the trend, where there is none."""
    return texts.map(lambda t: ((t or "").split(".")[0].strip() + ".") if (t or "").split(".")[0].strip() else None)
