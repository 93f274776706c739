"""Inverted-file index: k-means cells, of which a query scans the nearest.

Cells are always formed and chosen by squared Euclidean distance, whatever the metric.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import np_l2_squared
from nearfield.operators.knn import knn
from nearfield.types import DistanceMetric

ITERATIONS = 12
#: Centroids are a model on the driver: their bytes are checked against this before a build. Half a gigabyte holds the default nlist of a billion records of 4,096 components.
MOST_BYTES = 512 << 20


def effective_nlist(nlist: int, count: int) -> int:
    """0 stands for the root of the count; the result is within 1 and the count."""
    wanted = nlist or math.isqrt(count)
    return max(1, min(wanted, count))


def initial_centroids(records: DataFrame, nlist: int, seed: int) -> np.ndarray:
    """Vectors of the ``nlist`` first records in the order of a seeded digest of the id."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id")))
    first = records.select("id", "vector", order.alias("o")).orderBy("o", "id").limit(nlist)
    return np.array([r["vector"] for r in first.orderBy("o", "id").collect()], np.float32)


def nearest_cells(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; of equals the lowest cell.

    A matrix product estimates all distances, and only those within its error of the least are
    computed exactly.
    """
    out = np.empty(len(x), np.int64)
    b = centroids.astype(np.float64)
    bb = (b * b).sum(axis=1)
    step = max(1, (1 << 22) // max(1, len(centroids), centroids.shape[1]))
    for i in range(0, len(x), step):
        some = x[i : i + step]
        a = some.astype(np.float64)
        with np.errstate(all="ignore"):
            size = (a * a).sum(axis=1)[:, None] + bb
            guess, error = size - 2 * (a @ b.T), 4e-6 * size
            sure = size.max(initial=0) < 1e36 and size.min(initial=1) > 1e-30
        keep = guess - error <= (guess + error).min(axis=1, keepdims=True) if sure else np.ones(guess.shape, bool)
        row, cell = np.nonzero(keep)
        d = np.concatenate([np_l2_squared(some[row[j : j + 65_536]], centroids[cell[j : j + 65_536]]) for j in range(0, len(row), 65_536)]) if len(row) else np.zeros(0, np.float32)
        order = np.lexsort((cell, d, row))
        first = order[np.searchsorted(row[order], np.arange(len(some)))]
        out[i : i + step] = cell[first]
    return out


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)


def _means(records: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the mean of each cell's members; an empty cell keeps its centroid.

    Each partition sends its sums, one row for each cell, so the exchange has as many rows as
    cells and partitions, however many records there are.
    """
    held = records.sparkSession.sparkContext.broadcast(centroids)
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim)), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, 0)
                cells = nearest_cells(x, held.value)
                np.add.at(sums, cells, x.astype(np.float64))
                counts += np.bincount(cells, minlength=k)
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(counts[on]), pa.array(list(sums[on]), pa.list_(pa.float64()))], ["cell", "n", "sums"])

    partial = records.select("vector").mapInArrow(run, "cell long, n long, sums array<double>")
    total = partial.select("cell", "n", F.posexplode("sums").alias("at", "s")).groupBy("cell", "at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    got = total.toArrow()  # as many rows as the model has components
    cell, at, s, n = (got.column(c).to_numpy() for c in ("cell", "at", "s", "n"))
    out = centroids.copy()
    out[cell, at] = (s / n).astype(np.float32)
    held.unpersist()
    return out


@dataclass
class IvfModel:
    """``assigned``: the centroids by which records were last dealt out; ``centroids``: the means of these cells."""

    assigned: np.ndarray
    centroids: np.ndarray
    iterations: int


def train(records: DataFrame, nlist: int, seed: int, iterations: int = ITERATIONS) -> IvfModel:
    """Lloyd's rounds from the seeded start until the means stay, at most ``iterations``.

    A model's size is known before any of it comes to the driver: ``nlist`` vectors. One of more than ``MOST_BYTES`` is refused.
    """
    dim = (records.select(F.max(F.size("vector"))).first()[0] or 0) if nlist > MOST_BYTES // (4 * 65_536) else 0
    if 4 * nlist * dim > MOST_BYTES:
        raise MemoryError(f"{4 * nlist * dim} bytes of centroids exceed {MOST_BYTES}; ask for a smaller nlist")
    now = initial_centroids(records, nlist, seed)
    for k in range(1, iterations + 1):
        before, now = now, _means(records, now)
        if np.array_equal(before, now):
            break
    return IvfModel(before, now, k)


def assign(records: DataFrame, model: IvfModel) -> DataFrame:
    """``records`` with their ``cell``."""
    held = records.sparkSession.sparkContext.broadcast(model.assigned)
    at = records.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest_cells(_matrix(batch, at), held.value) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], [*batch.schema.names, "cell"])

    from pyspark.sql.types import IntegerType, StructField, StructType

    return records.mapInArrow(run, StructType([*records.schema.fields, StructField("cell", IntegerType())]))


def centroid_rows(model: IvfModel) -> list[tuple[int, list[float]]]:
    return [(k, [float(x) for x in c]) for k, c in enumerate(model.centroids)]


def probe(model: IvfModel, query: np.ndarray, nprobe: int) -> list[int]:
    """The ``nprobe`` cells whose centroids are nearest to the query, nearest first."""
    d = np_l2_squared(model.centroids, query[None])
    return np.lexsort((np.arange(len(d)), d))[: max(1, min(nprobe, len(d)))].tolist()


def in_cells(cells: list[int]) -> Column:
    """A filter on ``cell``; on postings that are stored by cell it prunes partitions."""
    return F.col("cell").isin(cells)


def search(postings: DataFrame, model: IvfModel, query: np.ndarray, k: int, nprobe: int, metric: DistanceMetric) -> DataFrame:
    """``id, distance`` of the ``k`` nearest members of the probed cells."""
    return knn(postings.filter(in_cells(probe(model, query, nprobe))), query, k, metric)
