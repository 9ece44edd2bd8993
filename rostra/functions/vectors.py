"""Vectors as arrays of numbers, worked on in the JVM with double accumulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    size = norm(v) + 1e-12
    return F.transform(v, lambda x: x / size)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def soft_jaccard(tau: float = 0.72):  # noqa: ANN201
    """Pandas UDF over two lists of unit vectors: pairs matched greedily in the order of the first list at a cosine of tau."""

    def one(a, b) -> float:  # noqa: ANN001
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        sims = np.stack([np.asarray(x, float) for x in a]) @ np.stack([np.asarray(x, float) for x in b]).T
        free, met = np.ones(len(b), bool), 0
        for row in sims:
            best = int(np.argmax(np.where(free, row, -np.inf)))
            if free[best] and row[best] >= tau:
                free[best] = False
                met += 1
        return met / (len(a) + len(b) - met)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def hashed_embedding(size: int = 64):  # noqa: ANN201
    """Pandas UDF: a deterministic embedding of words by signed hashing, for tests and for runs without a model."""
    import xxhash

    def one(text: str | None) -> list[float]:
        v = np.zeros(size)
        for w in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(w)
            v[h % size] += 1.0 if h >> 32 & 1 else -1.0
        return (v / (np.linalg.norm(v) + 1e-12)).tolist()

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run
