"""A vector search engine on PySpark DataFrames."""

from nearfield.collection import Collection
from nearfield.engine import Engine
from nearfield.errors import (
    AllocationFailureError,
    CorruptionError,
    DeletionFailedError,
    DimensionMismatchError,
    InvalidArgumentError,
    InvalidDimensionalityError,
    InvalidIdentifierError,
    InvalidMetricError,
    InvalidNameError,
    InvalidParameterError,
    InvalidValueError,
    NameConflictError,
    NearfieldError,
    NotFoundError,
    SnapshotNotFoundError,
    UndefinedDistanceError,
    UnsupportedVersionError,
    WriteFailureError,
)
from nearfield.functions.distance import pair_distance
from nearfield.types import CollectionInfo, DistanceMetric, IndexType

__version__ = "0.1.1"


def version() -> str:
    return __version__


__all__ = [
    "AllocationFailureError", "Collection", "CollectionInfo", "CorruptionError", "DeletionFailedError", "DimensionMismatchError", "DistanceMetric", "Engine", "IndexType", "InvalidArgumentError", "InvalidDimensionalityError",
    "InvalidIdentifierError", "InvalidMetricError", "InvalidNameError", "InvalidParameterError", "InvalidValueError", "NameConflictError", "NearfieldError", "NotFoundError", "SnapshotNotFoundError", "UndefinedDistanceError",
    "UnsupportedVersionError", "WriteFailureError", "pair_distance", "version",
]
