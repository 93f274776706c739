"""Exact nearest neighbours, one query or many, and exact ranking of an index's candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.distance import distance_to, np_distance
from nearfield.types import DistanceMetric, parse_metric

#: Queries and records of one block, of which a matrix product estimates all distances.
QUERY_BLOCK, RECORD_BLOCK = 256, 2048
#: A batch of up to so many queries is one broadcast; more are run block by block of partitions.
BROADCAST_QUERIES = 4096


def knn(records: DataFrame, query: np.ndarray, k: int, metric: DistanceMetric | str) -> DataFrame:
    """``id, distance`` of the ``k`` nearest of ``records``, by distance then id."""
    scored = records.select("id", distance_to(metric, F.col("vector"), query).alias("distance"))
    return scored.orderBy("distance", "id").limit(k)


def _top(k: int, by: str = "query_id") -> Window:
    return Window.partitionBy(by).orderBy("distance", "id")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, id, distance`` of the first ``k`` of each query; the limit is applied before the exchange too."""
    ranked = scored.withColumn("rank", F.row_number().over(_top(k))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "distance")


def knn_batch(records: DataFrame, queries: DataFrame, k: int, metric: DistanceMetric | str) -> DataFrame:
    """The ``k`` nearest of ``records(id, vector)`` for each of ``queries(query_id, vector)``.

    Queries come in blocks. Each partition of records keeps a block's best ``k``, so that what
    moves is ``k`` rows for each query and partition and never the products.
    """
    metric = parse_metric(metric)
    rows = queries.select("query_id", "vector")
    n = rows.count()
    if n <= BROADCAST_QUERIES:
        return top_k(_scored(records, rows.collect(), k, metric, dict(queries.dtypes)["query_id"]), k)
    parts = -(-n // BROADCAST_QUERIES)
    dealt = rows.withColumn("__p", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    out = None
    for p in range(parts):
        part = top_k(_scored(records, dealt.filter(F.col("__p") == p).drop("__p").collect(), k, metric, dict(queries.dtypes)["query_id"]), k)
        out = part if out is None else out.unionByName(part)
    return out


def _scored(records: DataFrame, queries: list, k: int, metric: DistanceMetric, key: str) -> DataFrame:
    """Each record partition's best ``k`` of each of the ``queries``, whose number the caller bounds."""
    schema = f"query_id {key}, id string, distance float"
    if not queries:
        return records.sparkSession.createDataFrame([], schema)
    keys = np.array([q["query_id"] for q in queries], dtype=object)
    held = records.sparkSession.sparkContext.broadcast(np.array([q["vector"] for q in queries], np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(keys), k)
        for batch in batches:
            for start in range(0, batch.num_rows, RECORD_BLOCK):
                part = batch.slice(start, RECORD_BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(part.num_rows, -1)
                for i in range(0, len(keys), QUERY_BLOCK):
                    at, row, dist = near_pairs(metric, x, held.value[i : i + QUERY_BLOCK], k)
                    best.add(at + i, part.column(0).take(pa.array(row)).to_numpy(zero_copy_only=False), dist)
        at, ids, dist = best.done()
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].tolist()), pa.array(ids.tolist(), pa.string()), pa.array(dist)], ["query_id", "id", "distance"])

    return records.select("id", "vector").mapInArrow(run, schema)


def near_pairs(metric: DistanceMetric, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row numbers and exact distances of all pairs that can be among a query's ``k`` nearest rows.

    A matrix product estimates all distances. Only pairs within the estimate's error of the
    ``k``-th are computed exactly; where the estimate overflows, all are.
    """
    with np.errstate(all="ignore"):
        a, b = x.astype(np.float64), q.astype(np.float64)
        dots, aa, bb = b @ a.T, (a * a).sum(axis=1), (b * b).sum(axis=1)[:, None]
        scale = np.sqrt(aa * bb)
        if metric is DistanceMetric.Euclidean:
            guess, error = aa + bb - 2 * dots, 4e-6 * (aa + bb)
        elif metric is DistanceMetric.Cosine:
            guess, error = np.where(scale > 0, 1 - dots / np.where(scale > 0, scale, 1), np.inf), np.full_like(dots, 1e-5)
        else:
            guess, error = dots, 1e-6 * scale
        doubtful = not (scale.max(initial=0) < 1e36 and (aa > 1e-30).all() and (bb > 1e-30).all())
    if k >= len(x) or doubtful:
        keep = np.ones(guess.shape, bool)
    else:
        keep = guess - error <= np.partition(guess + error, k - 1, axis=1)[:, k - 1 : k]
    at, row = np.nonzero(keep)
    dist = np.empty(len(at), np.float32)
    for i in range(0, len(at), 65_536):
        some = slice(i, i + 65_536)
        dist[some] = np_distance(metric, x[row[some]], q[at[some]])
    return at, row, dist


class _Best:
    """The ``k`` best pairs of each query so far, by distance then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.most, self.held = k, max(8 * queries * k, 100_000), [(np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, np.float32))]

    def add(self, at: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.held.append((at, ids, dist))
        if sum(len(h[0]) for h in self.held) > self.most:
            self.held = [self.done()]

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, ids, dist = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((dist, at))
        at, ids, dist = at[order], ids[order], dist[order]
        first = np.searchsorted(at, at)
        keep = np.arange(len(at)) - first < self.k
        # Where equal distances straddle the limit, the least ids stay.
        last = first + self.k - 1
        cut = np.flatnonzero(keep & (np.arange(len(at)) == last) & (np.arange(len(at)) + 1 < len(at)))
        for i in cut[(at[cut] == at[cut + 1]) & (dist[cut] == dist[cut + 1])].tolist():
            lo, hi = np.searchsorted(dist[first[i] : i + 1], dist[i]) + first[i], i + 1
            while hi < len(at) and at[hi] == at[i] and dist[hi] == dist[i]:
                hi += 1
            keep[lo:hi] = False
            keep[sorted(range(lo, hi), key=lambda j: ids[j].encode())[: i + 1 - lo]] = True
        return at[keep], ids[keep], dist[keep]


def rerank(records: DataFrame, candidates: DataFrame, query: np.ndarray, k: int, metric: DistanceMetric | str) -> DataFrame:
    """The ``k`` best of the live records among ``candidates(id)``, by exact distance. Stale and repeated ids drop out.

    Candidates that Spark estimates to be few are broadcast, as those of one query are; others meet the records by exchange.
    """
    live = records.join(candidates.select("id").dropDuplicates(["id"]), "id", "left_semi")
    return knn(live, query, k, metric)
