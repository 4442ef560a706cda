"""Pluggable models. All are optional: without one, operators degrade as documented, and the offline defaults are deterministic."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A batch of texts in, a batch of vectors (or of scores, or of answers) out.
Batch = Callable[[list], list]


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The offline embedder: counts of hashed lower-case words, by built-in functions."""
    slots = F.transform(F.filter(F.split(F.lower(text), "\\W+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def embedder(load: Callable[[], Batch]) -> Callable[[Column], Column]:
    """An embedding model as a vectorised function; load runs once a Python worker."""
    held: list[Batch] = []

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series(held[0](texts.fillna("").tolist()))

    return embed


def pair_scorer(load: Callable[[], Batch], most_chars: int = 512) -> Callable[[Column, Column], Column]:
    """A cross-encoder or NLI model as a vectorised function of two texts, each cut to most_chars for the model."""
    held: list[Batch] = []

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        if not held:
            held.append(load())
        return pd.Series(held[0](list(zip(a.str[:most_chars], b.str[:most_chars], strict=True))), dtype=float)

    return score
