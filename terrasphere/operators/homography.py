"""Projective 4 x 4 maps fitted to five point pairs per group."""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasphere.functions.vec import V3, ratio
from terrasphere.operators.ordered import top_k

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PAIRS = 5


def null_space(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Row-major 16-vector m with dst ~ M src for five pairs (N, 5, 3): the null direction
    of the 15 equations row_j(M) . s - d_j * row_3(M) . s = 0."""
    n = len(src)
    s = np.concatenate([src, np.ones((n, PAIRS, 1))], 2)
    a = np.zeros((n, PAIRS, 3, 4, 4))
    for j in range(3):
        a[:, :, j, j] = s
        a[:, :, j, 3] = -dst[:, :, j, None] * s
    return np.linalg.svd(a.reshape(n, 15, 16))[2][:, -1]


@cache
def _fit():
    def fit(pairs: pd.Series) -> pd.Series:
        rows = [np.array([[*p["s"].values(), *p["d"].values()] for p in five], dtype=float) for five in pairs]
        if not rows:
            return pd.Series([], dtype=object)
        r = np.stack(rows)
        return pd.Series(list(null_space(r[:, :, :3], r[:, :, 3:])))

    return F.pandas_udf(fit, "array<double>")


def fit_homography(pairs: DataFrame, key: list[str], order: str) -> DataFrame:
    """One map per key from its first five pairs (s* -> d*); keys with fewer have none.

    Only five rows per key are gathered; the fit itself is a narrow vectorised function.
    """
    five = top_k(pairs, key, [F.col(order)], PAIRS).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("rank", V3.of("s").struct().alias("s"), V3.of("d").struct().alias("d")))).alias("_p"))
    five = five.where(F.size("_p") == PAIRS)
    return five.select(*key, _fit()(F.col("_p")).alias("m"))


def apply_homography(p: V3, m: Column) -> V3:
    row = lambda i: m[4 * i] * p.x + m[4 * i + 1] * p.y + m[4 * i + 2] * p.z + m[4 * i + 3]
    w = row(3)
    return V3(ratio(row(0), w), ratio(row(1), w), ratio(row(2), w))
