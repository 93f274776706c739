"""Distances of float32 vectors, as native columns and as a NumPy twin that gives the same bits.

Products and differences are taken and summed in double precision, and each sum is narrowed to
float32 before the root or the quotient.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatchError, UndefinedDistanceError
from nearfield.types import DistanceMetric, parse_metric, to_vector



def _inf() -> Column:
    return F.lit(float("inf")).cast("float")


def _reduce(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    terms = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).cast("float")


def l2_squared(a: Column, b: Column) -> Column:
    return _reduce(a, b, lambda x, y: (x - y) * (x - y))


def dot(a: Column, b: Column) -> Column:
    return _reduce(a, b, lambda x, y: x * y)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b)).cast("float")


def norm_squared(a: Column) -> Column:
    return dot(a, a)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cos, within 0 to 2; infinite for a zero vector or where the quotient is undefined. Squared norms may be given."""
    return _cosine(dot(a, b), norm_squared(a) if norm_a is None else norm_a, norm_squared(b) if norm_b is None else norm_b)


def _cosine(raw: Column, na: Column, nb: Column) -> Column:
    scale = (F.sqrt(na).cast("float") * F.sqrt(nb).cast("float")).cast("float")
    quotient = F.when(scale != 0, (raw / F.when(scale != 0, scale)).cast("float"))
    value = F.greatest(F.least((F.lit(1.0).cast("float") - quotient).cast("float"), F.lit(2.0).cast("float")), F.lit(0.0).cast("float"))
    return F.when((na == 0) | (nb == 0) | quotient.isNull() | F.isnan(quotient), _inf()).otherwise(value)


def distance(metric: DistanceMetric | str, a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The metric's value, never NaN: undefined values are infinite, so they come last."""
    metric = parse_metric(metric)
    if metric is DistanceMetric.Euclidean:
        return euclidean(a, b)
    if metric is DistanceMetric.Cosine:
        return cosine(a, b, norm_a, norm_b)
    raw = dot(a, b)
    return F.when(F.isnan(raw), _inf()).otherwise(raw)


#: Up to so many components a distance to one query is written out term by term, so that it runs as compiled code and not as an interpreted array function.
WRITTEN_OUT = 128


def _terms(a: Column, f: Callable[[Column, int], Column], n: int) -> Column:
    total = F.lit(0.0)
    for i in range(n):
        total = total + f(F.get(a, F.lit(i)).cast("double"), i)
    return total.cast("float")


def distance_to(metric: DistanceMetric | str, a: Column, query: np.ndarray) -> Column:
    """:func:`distance` of the column ``a`` to one query, with the same bits."""
    metric, n, q = parse_metric(metric), len(query), query.astype(np.float64).tolist()
    if n > WRITTEN_OUT:
        return distance(metric, a, literal(query), norm_b=F.lit(float(np_dot(query, query))).cast("float"))
    if metric is DistanceMetric.Euclidean:
        return F.sqrt(_terms(a, lambda x, i: (x - q[i]) * (x - q[i]), n)).cast("float")
    raw = _terms(a, lambda x, i: x * q[i], n)
    if metric is DistanceMetric.Cosine:
        return _cosine(raw, _terms(a, lambda x, i: x * x, n), F.lit(float(np_dot(query, query))).cast("float"))
    return F.when(F.isnan(raw), _inf()).otherwise(raw)


def first_non_finite(vector: Column) -> Column:
    """Place from 0 of the first component that is null, NaN or infinite; -1 if none is."""
    bad = F.transform(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == _inf()))
    return F.coalesce(F.array_position(bad, True).cast("int") - 1, F.lit(-1))


def literal(vector: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")


def _sums(terms: np.ndarray) -> np.ndarray:
    """Sums along the last axis from left to right, as a loop would add them."""
    return np.cumsum(terms, axis=-1)[..., -1] if terms.shape[-1] else np.zeros(terms.shape[:-1])


def np_l2_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a.astype(np.float64) - b.astype(np.float64)
    with np.errstate(over="ignore"):
        return _sums(diff * diff).astype(np.float32)


def np_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _sums(a.astype(np.float64) * b.astype(np.float64)).astype(np.float32)


def np_distance(metric: DistanceMetric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same values as :func:`distance` for arrays that broadcast along all but the last axis."""
    with np.errstate(all="ignore"):
        if metric is DistanceMetric.Euclidean:
            return np.sqrt(np_l2_squared(a, b))
        raw = np_dot(a, b)
        if metric is DistanceMetric.Cosine:
            na, nb = np_dot(a, a), np_dot(b, b)
            quotient = raw / (np.sqrt(na) * np.sqrt(nb))
            value = np.clip(np.float32(1) - quotient, np.float32(0), np.float32(2))
            raw = np.where((na == 0) | (nb == 0) | np.isnan(value), np.float32(np.inf), value)
        return np.where(np.isnan(raw), np.float32(np.inf), raw).astype(np.float32)


def pair_distance(a, b, metric: DistanceMetric | str) -> float:
    """Distance of two vectors; raises where it is undefined."""
    metric, x, y = parse_metric(metric), to_vector(a), to_vector(b)
    if len(x) != len(y):
        raise DimensionMismatchError(f"vectors have {len(x)} and {len(y)} components")
    if metric is DistanceMetric.Cosine and (np_dot(x, x) == 0 or np_dot(y, y) == 0):
        raise UndefinedDistanceError("cosine distance of a zero vector")
    return float(np_distance(metric, x, y))
