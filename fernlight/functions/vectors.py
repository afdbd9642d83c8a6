"""Cosine similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Over the dimensions both have; 0 where one is empty or of length 0. In the JVM."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when((n > 0) & (norm > 0), _dot(x, y) / norm).otherwise(0.0)


def cosine_to(vector: list[float]):
    """A column function for one query vector, by Arrow batches: for many dimensions."""
    query = np.asarray(vector, np.float64)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column))
        for i, v in enumerate(column):
            if v is not None and len(v) and len(query):
                n = min(len(v), len(query))
                x, y = np.asarray(v[:n], np.float64), query[:n]
                norm = np.sqrt(x @ x) * np.sqrt(y @ y)
                out[i] = x @ y / norm if norm > 0 else 0.0
        return pd.Series(out)

    return score


def parse_vector(c: Column) -> Column:
    """An array from a JSON text, null if it is none."""
    return F.from_json(c, "array<double>")
