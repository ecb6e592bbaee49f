"""Full-text match: every word of the query, stemmed and without stop-words, must be among a text's stems."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import folded
from ..functions.turkish import stem

STOP = frozenset("ve veya ile bir bu şu o da de ki mi mı mu mü için gibi ama en çok daha ne ya".split())
WORD = re.compile(r"[^\W_]+")


def stems_of(text: str | None) -> list[str]:
    low = (text or "").replace("İ", "i").replace("I", "ı").lower()
    return sorted({stem(w) for w in WORD.findall(low) if w not in STOP})


@F.pandas_udf(ArrayType(StringType()))
def stems(texts: pd.Series) -> pd.Series:
    return texts.map(stems_of)


def words(t: Column) -> Column:
    """Without stems: folded runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(folded(t), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def matches(t: Column, query: str) -> Column:
    """All of the query's words are words of t. JVM-side; the plain form of the match."""
    low = query.replace("İ", "i").replace("I", "ı").lower()
    wanted = [w for w in WORD.findall(low) if w not in STOP]
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), words(t))) == 0 if wanted else F.lit(False)


def matches_stemmed(t: Column, query: str) -> Column:
    wanted = stems_of(query)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), stems(t))) == 0 if wanted else F.lit(False)
