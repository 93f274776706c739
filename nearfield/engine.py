"""The registry of collections."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.collection import Collection
from nearfield.errors import AllocationFailureError, DeletionFailedError, InvalidDimensionalityError, InvalidNameError, NameConflictError, NotFoundError
from nearfield.operators.records import storage
from nearfield.types import MAX_DIMENSIONALITY, MAX_NAME_BYTES, CollectionInfo, parse_metric


class Engine:
    """Creates, finds, lists, deletes, saves and loads collections.

    ``deletion_fault`` may be set to a test of a name; where it holds, deletion fails and the
    collection stays as it is. ``quota`` bounds the bytes of vectors of all collections, in blocks
    of whole 64 bytes; a write that would exceed it stores nothing. By default there is no bound.
    """

    def __init__(self, spark: SparkSession | None = None, quota: int | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.quota = quota
        self.deletion_fault: Callable[[str], bool] | None = None
        self._collections: dict[str, Collection] = {}
        self._lock = threading.RLock()

    def create_collection(self, name: str, dim: int, metric) -> Collection:
        kind = parse_metric(metric)
        if not 1 <= len(name.encode()) <= MAX_NAME_BYTES:
            raise InvalidNameError(f"a collection's name must have 1 to {MAX_NAME_BYTES} bytes")
        if not 1 <= dim <= MAX_DIMENSIONALITY:
            raise InvalidDimensionalityError(f"dimensionality must be from 1 to {MAX_DIMENSIONALITY}, not {dim}")
        with self._lock:
            if name in self._collections:
                raise NameConflictError(f"collection '{name}' exists already")
            made = self._collections[name] = Collection(self.spark, name, dim, kind, self._reserve)
            return made

    def _reserve(self, coll: Collection, more: int) -> None:
        """Raise unless ``more`` records of ``coll`` fit the quota beside all that is stored."""
        if self.quota is None:
            return
        with self._lock:
            used = sum(c.count() * c.block_bytes for c in self._collections.values())
        if used + more * coll.block_bytes > self.quota:
            raise AllocationFailureError(f"{more} records of {coll.block_bytes} bytes do not fit: {used} of {self.quota} bytes are used")

    def get_collection(self, name: str) -> Collection:
        with self._lock:
            if name not in self._collections:
                raise NotFoundError(f"collection '{name}' does not exist")
            return self._collections[name]

    def list_collections(self) -> list[CollectionInfo]:
        """One entry for each collection, by name."""
        with self._lock:
            return [self._collections[n].info() for n in sorted(self._collections, key=str.encode)]

    def collections_table(self) -> DataFrame:
        rows = [(c.name, c.dimensionality, c.metric.name, c.record_count) for c in self.list_collections()]
        return self.spark.createDataFrame(rows, "name string, dimensionality int, metric string, record_count long")

    def delete_collection(self, name: str) -> None:
        with self._lock:
            found = self.get_collection(name)
            if self.deletion_fault and self.deletion_fault(name):
                raise DeletionFailedError(f"collection '{name}' could not be deleted")
            del self._collections[name]
            found._scratch.drop()

    def allocation_stats(self) -> dict[str, int]:
        """Bytes of vectors by collection, in blocks of whole 64 bytes."""
        with self._lock:
            return {n: storage(c.table()).first()["bytes"] for n, c in self._collections.items()}

    def _install(self, made: Collection) -> Collection:
        with self._lock:
            if made.name in self._collections:
                raise NameConflictError(f"collection '{made.name}' exists already")
            self._reserve(made, made.count())
            made._reserve = self._reserve
            self._collections[made.name] = made
            return made

    def save(self, name: str, path: str) -> None:
        """Write a collection to one snapshot file; a failure leaves what was there."""
        from nearfield.sources.snapshot import save

        save(self.get_collection(name), path)

    def load(self, path: str) -> Collection:
        from nearfield.sources.snapshot import load

        return self._install(load(self.spark, path))

    def save_table(self, name: str, uri: str) -> None:
        """Write a collection of any size to a folder of Parquet files with a manifest."""
        from nearfield.sources.tables import save_table

        save_table(self.get_collection(name), uri)

    def load_table(self, uri: str) -> Collection:
        from nearfield.sources.tables import load_table

        return self._install(load_table(self.spark, uri))
