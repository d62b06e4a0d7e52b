"""Distances as functions of two array columns, and a registry of them by name.

Every metric is a built-in expression, so that it is evaluated in the JVM. A metric of one's own is
either such a function of two columns, or a vectorised one over numpy arrays (``vectorised``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _differences(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_differences(a, b))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_differences(a, b))


def minkowski(p: float) -> Metric:
    """Lp for p >= 1; below 1 it would not be a metric."""
    if p < 1:
        raise ValueError("p must be at least 1")
    return lambda a, b: F.pow(_sum(F.transform(_differences(a, b), lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


METRICS: dict[str, Metric] = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev}


def metric(which: str | Metric, p: float | None = None) -> Metric:
    """A metric by name ("minkowski" takes ``p``), or a function of two columns as it is."""
    if callable(which):
        return which
    if which == "minkowski":
        if p is None:
            raise ValueError("minkowski takes p")
        return minkowski(p)
    if which not in METRICS:
        raise ValueError(f"no metric {which!r}; there are {sorted(METRICS)} and minkowski")
    return METRICS[which]


def vectorised(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Metric:
    """A metric from ``f`` (rows of a, rows of b) -> distances, over Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(np.stack(a.to_numpy()), np.stack(b.to_numpy()))) if len(a) else pd.Series([], dtype=float)

    return lambda a, b: run(a, b)


def perturbation(idx: Column, magnitude: float, seed: int = 0) -> Column:
    """A small repeatable number in [0, magnitude) for each row, to order ties by."""
    return F.lit(float(magnitude)) * F.pmod(F.pmod(idx, F.lit(1_000_003)) * F.lit(7919) + F.lit(seed), F.lit(1_000_003)) / F.lit(1_000_003.0)
