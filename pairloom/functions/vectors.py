"""Distances, correlations and moments of arrays of doubles, as higher-order built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .sets import EPS


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a.cast("double") * b))


def norm(x: Column) -> Column:
    return F.sqrt(_sum(F.transform(x, lambda a: a.cast("double") * a)))


def _diff(x: Column, y: Column, f) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: f(a.cast("double") - b)))


def cosine_guarded(x: Column, y: Column) -> Column:
    """x y / (|x| |y| + eps)."""
    return dot(x, y) / (norm(x) * norm(y) + EPS)


def cosine(x: Column, y: Column) -> Column:
    """x y / (|x| |y|); null for a zero vector."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def manhattan(x: Column, y: Column) -> Column:
    return _diff(x, y, F.abs)


def sum_difference(x: Column, y: Column) -> Column:
    """|sum(x - y)|: the square root of the squared sum, not of the sum of squares."""
    return F.abs(_diff(x, y, lambda d: d))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_diff(x, y, lambda d: d * d))


def minkowski3(x: Column, y: Column) -> Column:
    return F.pow(_diff(x, y, lambda d: F.abs(d) * d * d), F.lit(1 / 3))


def canberra(x: Column, y: Column) -> Column:
    """sum |a - b| / (|a| + |b|), where 0 / 0 is 0."""
    part = lambda a, b: F.coalesce(F.try_divide(F.abs(a.cast("double") - b), F.abs(a.cast("double")) + F.abs(b)), F.lit(0.0))
    return _sum(F.zip_with(x, y, part))


def _mean(x: Column) -> Column:
    return F.try_divide(_sum(x), F.size(x))


def _centred(x: Column) -> Column:
    # the mean is computed once: the array is bound beside it
    return F.flatten(F.transform(F.array(F.struct(x.alias("x"), _mean(x).alias("m"))), lambda s: F.transform(s["x"], lambda v: v.cast("double") - s["m"])))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null if a side is constant."""
    return cosine(_centred(x), _centred(y))


def ranks(x: Column) -> Column:
    """Ranks from 1, the mean rank for ties."""
    below = lambda v: F.size(F.filter(x, lambda w: w < v))
    same = lambda v: F.size(F.filter(x, lambda w: w == v))
    return F.transform(x, lambda v: below(v) + (same(v) + 1) / 2)


def spearman(x: Column, y: Column) -> Column:
    return pearson(ranks(x), ranks(y))


@F.pandas_udf(DoubleType())
def kendall(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Kendall's tau-b; null for a constant or missing side. Rows of one length are one matrix."""
    for x, y in batches:
        out = np.full(len(x), np.nan)
        sizes = np.array([len(a) if a is not None and b is not None and len(a) == len(b) else 0 for a, b in zip(x, y)], dtype=int)
        for n in set(sizes[sizes > 1].tolist()):
            i, j = np.triu_indices(n, 1)
            rows = np.flatnonzero(sizes == n)
            for at in np.array_split(rows, -(-len(rows) * len(i) // 4_000_000)):  # signs of at most some 4,000,000 pairs at a time
                a, b = (np.sign(v[:, i] - v[:, j]) for v in (np.array([s.iloc[r] for r in at], dtype=float) for s in (x, y)))
                with np.errstate(invalid="ignore"):
                    out[at] = (a * b).sum(axis=1) / np.sqrt((a != 0).sum(axis=1).astype(float) * (b != 0).sum(axis=1))
        yield pd.Series(out).astype("object").where(~np.isnan(out), None)


SIMILARITIES = ["cosine_guarded", "manhattan", "sum_difference", "pearson", "spearman", "kendall"]


def _similarities(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The measures of :data:`SIMILARITIES` of the rows of two matrices, a column for each; NaN for a correlation with a constant side."""

    def centred_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        return np.where(flat, np.nan, (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)))

    def order(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        above = (a[:, :, None] > a[:, None, :]).view(np.int8)
        sign = above - above.transpose(0, 2, 1)
        # n numbers less those above and below are the same; ties have the mean rank
        return sign, (sign.sum(axis=2, dtype=np.int64) + a.shape[1] + 1) / 2

    flat = (np.ptp(x, axis=1) == 0) | (np.ptp(y, axis=1) == 0)
    (sx, rx), (sy, ry) = order(x), order(y)
    both, one, other = (v.sum(axis=(1, 2), dtype=np.int64) for v in (sx * sy, sx != 0, sy != 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine_ = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)) + EPS)
        tau = np.where(flat, np.nan, both / np.sqrt(one.astype(float) * other))
        return np.column_stack([cosine_, np.abs(x - y).sum(axis=1), np.abs((x - y).sum(axis=1)), centred_cosine(x, y), centred_cosine(rx, ry), tau])


@F.arrow_udf(StructType([StructField(f, DoubleType()) for f in SIMILARITIES]))
def similarities(x: pa.Array, y: pa.Array) -> pa.Array:
    """All of :data:`SIMILARITIES` at once, for many pairs of arrays; null for a missing side or different lengths. Rows of one length are one matrix."""
    out = np.full((len(x), len(SIMILARITIES)), np.nan)
    m, n = (pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False) for v in (x, y))
    for size in set(m[(m == n) & (m > 0)].tolist()):
        rows = np.flatnonzero((m == size) & (n == size))
        for at in np.array_split(rows, -(-len(rows) * size * size // 4_000_000)):
            a, b = (pc.list_flatten(v.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size) for v in (x, y))
            out[at] = _similarities(a, b)
    return pa.StructArray.from_arrays([pa.array(c, from_pandas=True) for c in out.T], SIMILARITIES)


def _moment(c: Column, k: int) -> Column:
    return _mean(F.transform(c, lambda v: F.pow(v, F.lit(k))))


def skewness(x: Column) -> Column:
    """m3 / m2^1.5 of the population; null for a constant array."""
    c = _centred(x)
    return F.try_divide(_moment(c, 3), F.pow(_moment(c, 2), F.lit(1.5)))


def kurtosis(x: Column) -> Column:
    """m4 / m2^2 - 3 of the population; null for a constant array."""
    c = _centred(x)
    return F.try_divide(_moment(c, 4), F.pow(_moment(c, 2), F.lit(2.0))) - 3
