"""Errors of the engine. Each category's message is ``Category: cause``."""

from __future__ import annotations


class NearfieldError(Exception):
    """Base of all errors of the engine."""

    category = "Error"

    def __init__(self, cause: str):
        super().__init__(f"{self.category}: {cause}")
        self.cause = cause

    def __str__(self) -> str:  # KeyError would show the representation
        return f"{self.category}: {self.cause}"


def _kind(name: str, *bases: type) -> type:
    return type(f"{name}Error", (NearfieldError, *bases), {"category": name, "__module__": __name__})


NameConflictError = _kind("NameConflict")
InvalidNameError = _kind("InvalidName", ValueError)
InvalidDimensionalityError = _kind("InvalidDimensionality")
InvalidMetricError = _kind("InvalidMetric")
DeletionFailedError = _kind("DeletionFailed")
NotFoundError = _kind("NotFound", KeyError)
DimensionMismatchError = _kind("DimensionMismatch")
InvalidValueError = _kind("InvalidValue")
InvalidIdentifierError = _kind("InvalidIdentifier")
InvalidParameterError = _kind("InvalidParameter")
InvalidArgumentError = _kind("InvalidArgument")
UndefinedDistanceError = _kind("UndefinedDistance")
AllocationFailureError = _kind("AllocationFailure", MemoryError)
WriteFailureError = _kind("WriteFailure", OSError)
SnapshotNotFoundError = _kind("SnapshotNotFound", FileNotFoundError)
UnsupportedVersionError = _kind("UnsupportedVersion")
CorruptionError = _kind("Corruption")
