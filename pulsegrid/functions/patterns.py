"""Many words looked for at once: an automaton over Arrow batches goes through a text once, however many words there are."""

from __future__ import annotations

from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


@lru_cache(32)
def automaton(words: tuple[str, ...]):
    """Finds each word by its place in words; one to a Python worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, w in enumerate(words):
        out.add_word(w, i)
    out.make_automaton()
    return out


def sums(t: Column, groups: list[dict[str, int]]) -> Column:
    """For each group of words with weights, the sum over those that t contains, each once: an array in the groups' order. Null contains nothing."""
    words = tuple(sorted({w for g in groups for w in g}))
    weights = np.array([[g.get(w, 0) for g in groups] for w in words], np.int32).reshape(len(words), len(groups))

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), len(groups)), np.int32)
        found = automaton(words).iter if words else lambda _: ()
        for i, text in enumerate(texts):
            if text:
                own = set(map(itemgetter(1), found(text)))
                if own:
                    out[i] = weights[list(own)].sum(axis=0)
        return pd.Series(list(out))

    return run(t)
