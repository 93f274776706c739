"""Choice of the path of a query: exact scan or index, with the scan where the index falls short."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import distance
from nearfield.operators import hnsw, ivf
from nearfield.operators.knn import knn, knn_batch, rerank, top_k
from nearfield.operators.sizes import broadcast_if_small
from nearfield.sources.shared import Scratch
from nearfield.types import DistanceMetric, IndexType

#: Queries of a batch that go to an index together.
QUERIES = 4_096
#: So many changed records, or this share of all, are ranked beside an index's graphs; beyond it the graphs that they touch are built anew.
MOST_CHANGED, CHANGED_SHARE = 1_000, 0.05
#: Spark's limit is a signed 32-bit number.
MOST_K = (1 << 31) - 1


def uses_index(kind: IndexType, k: int, count: int) -> bool:
    """An index serves only queries that leave some record out; others are exact scans."""
    return kind is not IndexType.NONE and k < count


def with_fallback(found: DataFrame, records: DataFrame, query: np.ndarray, k: int, count: int, metric: DistanceMetric) -> list[tuple[str, float]]:
    """``found``, or an exact scan if it has fewer than the ``k`` (or ``count``) live records that it should."""
    rows = found.collect()
    if len(rows) < min(k, count):
        rows = knn(records, query, k, metric).collect()
    return [(r["id"], float(r["distance"])) for r in sorted(rows, key=lambda r: (r["distance"], r["id"].encode()))]


def must_refresh(changed: int, count: int) -> bool:
    return changed > max(MOST_CHANGED, CHANGED_SHARE * count)


def hnsw_query(records: DataFrame, graphs: DataFrame, changed: DataFrame | None, extra: int, query: np.ndarray, k: int, ef: int, metric: DistanceMetric) -> DataFrame:
    """Exact ranking of the graphs' candidates and of the records ``changed`` since they were built.

    ``extra`` more candidates than ``k`` are taken, as many as may be stale; the collection builds
    graphs anew before these are many. What was changed is broadcast within a checked size.
    """
    found = hnsw.search(graphs, query[None], ["q"], k + extra, max(ef, k, 1)).orderBy("distance", "id").limit(k + extra).select("id")
    if changed is not None:
        fresh = knn(records.join(broadcast_if_small(changed), "id", "left_semi"), query, k, metric).select("id")
        found = found.unionByName(fresh)
    return rerank(records, found, query, k, metric)


def ivf_batch(postings: DataFrame, model: ivf.IvfModel, queries: list[tuple], k: int, nprobe: int, metric: DistanceMetric) -> DataFrame:
    """The ``k`` best members of each query's probed cells: an equi-join of queries and postings on the cell."""
    spark = postings.sparkSession
    rows = [(key, cell, [float(x) for x in q]) for key, q in queries for cell in ivf.probe(model, np.asarray(q, np.float32), nprobe)]
    probes = spark.createDataFrame(rows, "query_id string, cell int, q array<float>")
    scored = postings.join(probes, "cell").select("query_id", "id", distance(metric, F.col("vector"), F.col("q")).alias("distance"))
    return top_k(scored, k)


def hnsw_batch(records: DataFrame, graphs: DataFrame, queries: list[tuple], k: int, ef: int, metric: DistanceMetric) -> DataFrame:
    """The ``k`` best of the graphs' candidates for each query, by exact distance; short queries are scanned exactly."""
    spark = records.sparkSession
    keys, vectors = [q[0] for q in queries], np.array([q[1] for q in queries], np.float32)
    # Written down, since what follows reads it several times and the graphs would be searched anew each time.
    found = Scratch(spark).table(hnsw.search(graphs, vectors, keys, k, max(ef, k, 1)).dropDuplicates(["query_id", "id"]), "found")
    asked = spark.createDataFrame([(a, [float(x) for x in b]) for a, b in queries], "query_id string, q array<float>")
    exact = found.select("query_id", "id").join(records.select("id", "vector"), "id").join(broadcast_if_small(asked), "query_id")
    ranked = top_k(exact.select("query_id", "id", distance(metric, F.col("vector"), F.col("q")).alias("distance")), k)
    full = ranked.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = asked.join(full, "query_id", "left_anti").withColumnRenamed("q", "vector")
    return ranked.join(full, "query_id", "left_semi").unionByName(knn_batch(records, short, k, metric))
