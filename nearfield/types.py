"""Metrics, index kinds, schemas, and conversion of vectors and metadata."""

from __future__ import annotations

import math
import numbers
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from enum import Enum

import numpy as np

from nearfield.errors import InvalidArgumentError, InvalidMetricError

MAX_DIMENSIONALITY = 65_536
MAX_NAME_BYTES = 255
MAX_BATCH = 10_000

#: Metadata: null is absent and an empty map is present. ``t`` tells the type: 0 string, 1 integer, 2 double, 3 boolean.
META = "map<string,struct<t:tinyint,s:string,i:bigint,d:double,b:boolean>>"
RECORD = f"id string, vector array<float>, meta {META}"


class DistanceMetric(Enum):
    Euclidean = 0
    Cosine = 1
    DotProduct = 2


class IndexType(Enum):
    NONE = 0
    HNSW = 1
    IVF = 2


#: The names that callers use.
METRIC_NAMES = {
    "euclidean": DistanceMetric.Euclidean,
    "l2": DistanceMetric.Euclidean,
    "cosine": DistanceMetric.Cosine,
    "dot": DistanceMetric.DotProduct,
    "dot_product": DistanceMetric.DotProduct,
    "dotproduct": DistanceMetric.DotProduct,
    "ip": DistanceMetric.DotProduct,
}
INDEX_NAMES = {"hnsw": IndexType.HNSW, "ivf": IndexType.IVF, "none": IndexType.NONE}


def parse_metric(name: str | DistanceMetric) -> DistanceMetric:
    if isinstance(name, DistanceMetric):
        return name
    found = METRIC_NAMES.get(name.lower()) if isinstance(name, str) else None
    if found is None:
        raise InvalidMetricError(f"unknown metric '{name}'")
    return found


def parse_index_type(name: str | IndexType) -> IndexType:
    if isinstance(name, IndexType):
        return name
    found = INDEX_NAMES.get(name.lower()) if isinstance(name, str) else None
    if found is None:
        raise InvalidArgumentError(f"unknown index type '{name}'")
    return found


@dataclass(frozen=True)
class IndexParams:
    """Parameters of an index; the seed's default is a fixed value."""

    m: int = 16
    ef_construction: int = 200
    nlist: int = 0
    seed: int = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class CollectionInfo:
    name: str
    dimensionality: int
    metric: DistanceMetric
    record_count: int


def to_vector(values) -> np.ndarray:
    """A float32 vector of any sequence of numbers; TypeError names the first element that is none."""
    if isinstance(values, (str, bytes, Mapping)) or not (isinstance(values, (Sequence, np.ndarray)) or (hasattr(values, "__len__") and hasattr(values, "__getitem__"))):
        raise TypeError(f"vector must be a sequence of numbers, not {type(values).__name__}")
    if isinstance(values, np.ndarray) and values.ndim == 1 and values.dtype.kind in "fiub":
        with np.errstate(over="ignore"):
            return values.astype(np.float32)
    out = np.empty(len(values), np.float64)
    for i, x in enumerate(values):
        if isinstance(x, complex) or not isinstance(x, (numbers.Real, np.bool_)):
            raise TypeError(f"vector element {i} is not a number: {type(x).__name__}")
        try:
            out[i] = x
        except OverflowError:
            out[i] = math.inf
    with np.errstate(over="ignore"):
        return out.astype(np.float32)


def encode_meta(meta) -> dict | None:
    """Typed cells of a metadata dict in key order; None stays None."""
    if meta is None:
        return None
    if not isinstance(meta, dict):
        raise TypeError("metadata must be a dict or None")
    out = {}
    for key in meta:
        if not isinstance(key, str):
            raise TypeError("metadata keys must be strings")
    for key in sorted(meta, key=lambda k: k.encode()):
        v = meta[key]
        if isinstance(v, (bool, np.bool_)):
            out[key] = (3, None, None, None, bool(v))
        elif isinstance(v, str):
            out[key] = (0, v, None, None, None)
        elif isinstance(v, (int, np.integer)):
            if not -(1 << 63) <= int(v) < 1 << 63:
                raise TypeError(f"metadata value of '{key}' does not fit 64 bits")
            out[key] = (1, None, int(v), None, None)
        elif isinstance(v, (float, np.floating)):
            out[key] = (2, None, None, float(v), None)
        else:
            raise TypeError(f"metadata value of '{key}' must be str, int, float or bool, not {type(v).__name__}")
    return out


def decode_meta(cells: Mapping | None) -> dict | None:
    if cells is None:
        return None
    return {k: c[c[0] + 1] for k, c in sorted(cells.items(), key=lambda x: x[0].encode())}
