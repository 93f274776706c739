"""Navigable small-world graphs, one for each shard of the records.

Inserting into a graph is sequential, so the records are dealt into shards of bounded size, each
shard's graph is built by one task, and a query searches all of them. Candidates are ranked
exactly afterwards, so what a caller sees is recall, not the shape of a graph.
"""

from __future__ import annotations

import heapq
import itertools
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.distance import np_distance
from nearfield.operators.knn import near_pairs
from nearfield.types import DistanceMetric, IndexParams

#: Records of a shard, about. A graph of this size is built in some seconds.
SHARD = 5_000
#: Nodes whose distances to all before them are computed at a time.
BLOCK = 256
#: Each record's so many nearest are found by a search of this breadth from its own vector, or else get links; after so many rounds beyond the bound on a node's links.
NEAREST, BREADTH, ROUNDS = 10, 50, 8
GRAPHS = "shard int, graph binary"


def level_of(record_id: str, seed: int, m: int) -> int:
    """A layer drawn from the geometric law with mean 1 / ln m, by a digest of seed and id: the order of insertion doesn't matter."""
    from xxhash import xxh64_intdigest

    u = (xxh64_intdigest(f"{seed}:{record_id}") + 1) / (1 << 64)
    return int(-math.log(min(u, 1.0)) / math.log(m))


@dataclass
class Graph:
    """Ids in ascending order, their vectors and top layers, and for each node the neighbours in each of its layers."""

    ids: list[str]
    vectors: np.ndarray
    levels: list[int]
    links: list[list[list[int]]]
    entry: int = -1
    metric: DistanceMetric = DistanceMetric.Euclidean

    def far(self, query: np.ndarray, nodes: list[int]) -> list[float]:
        return np_distance(self.metric, self.vectors[nodes], query).tolist()

    def layer(self, far: Callable[[list[int]], list[float]], starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        """Best-first search of one layer by the distances ``far``: up to ``ef`` nodes by distance then number."""
        seen = {n for _, n in starts}
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, -n) for d, n in starts]
        heapq.heapify(best)
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= ef and (-d, -n) < best[0]:
                break
            new = [x for x in self.links[n][layer] if x not in seen] if layer < len(self.links[n]) else []
            if not new:
                continue
            seen.update(new)
            for e, x in zip(far(new), new, strict=True):
                if len(best) < ef or (-e, -x) > best[0]:
                    heapq.heappush(todo, (e, x))
                    heapq.heappush(best, (-e, -x))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def diverse(self, near: np.ndarray, found: np.ndarray, most: int) -> list[int]:
        """Of nodes ``found`` in order of their distances ``near`` to a base, those that lie nearer to it than to every one taken before; free places go to the nearest others."""
        between = matrix(self.metric, self.vectors[found], self.vectors[found])
        taken, least, at = [], np.full(len(found), np.inf), 0
        while len(taken) < most:
            open_ = near[at:] < least[at:]
            if not open_.any():
                break
            at += int(open_.argmax())
            taken.append(int(found[at]))
            least = np.minimum(least, between[at])
            at += 1
        for other in found.tolist() if len(taken) < most else ():
            if other not in taken:
                taken.append(other)
                if len(taken) == most:
                    break
        return taken

    def add(self, node: int, near: np.ndarray, members: list[np.ndarray], m: int, ef: int) -> None:
        """Link ``node`` in each of its layers to diverse ones of the ``ef`` nearest nodes before it, given its distances ``near`` to all of them, and those back to it."""
        top = self.levels[node]
        self.links[node] = [[] for _ in range(top + 1)]
        if self.entry < 0:
            self.entry = node
            return
        for layer in range(min(top, self.levels[self.entry]), -1, -1):
            before = members[layer][: np.searchsorted(members[layer], node)]
            if len(before) > ef:
                before = before[np.argpartition(near[before], ef - 1)[:ef]]
            before = before[np.lexsort((before, near[before]))]
            own = self.diverse(near[before], before, m)
            self.links[node][layer] = own
            most = 2 * m if layer == 0 else m
            for other in own:
                back = self.links[other][layer]
                back.append(node)
                if len(back) > most:
                    found = np.array(back)
                    far = matrix(self.metric, self.vectors[other : other + 1], self.vectors[found])[0]
                    order = np.lexsort((found, far))
                    self.links[other][layer] = self.diverse(far[order], found[order], most)
        if top > self.levels[self.entry]:
            self.entry = node

    def nodes(self, far: Callable[[list[int]], list[float]], ef: int) -> list[tuple[float, int]]:
        """Up to ``ef`` nodes that a search from the top meets, by their distance ``far`` then number."""
        if self.entry < 0:
            return []
        near = list(zip(far([self.entry]), [self.entry], strict=True))
        for layer in range(self.levels[self.entry], 0, -1):
            near = self.layer(far, near, 1, layer)[:1]
        return self.layer(far, near, ef, 0)

    def search(self, query: np.ndarray, k: int, ef: int) -> list[tuple[float, str]]:
        return [(d, self.ids[n]) for d, n in self.nodes(lambda nodes: self.far(query, nodes), max(ef, k, 1))[:k]]

    def mend(self, most: int) -> None:
        """Link what searches from the records' own vectors lose.

        Records that are nobody's nearest, such as long vectors among short ones, lose the links back to
        them to nearer nodes. Each vector's ``NEAREST`` nodes are computed exactly, itself among them; one
        that a search of breadth ``BREADTH`` doesn't meet gets a link from the nearest node met that has
        fewer than ``most``, or else in place of that node's longest link, which it takes over. Links that
        give way may lose others, so after ``ROUNDS`` rounds none does and a node may get more than ``most``:
        each round then only adds links, which ends. Rounds end once all are met. A broader search meets all
        that a narrower one does, so a record is found from its own vector at any breadth of ``BREADTH`` or more.
        """
        if not self.ids:
            return
        _, own = np.unique(self.vectors.view(np.uint8).reshape(len(self.ids), -1), axis=0, return_index=True)
        wanted: dict[int, list[int]] = {}
        for start in range(0, len(own), BLOCK):
            some = own[start : start + BLOCK]
            at, row, dist = near_pairs(self.metric, self.vectors, self.vectors[some], NEAREST)
            order = np.lexsort((row, dist, at))
            for node, found in zip(some.tolist(), np.split(row[order], np.searchsorted(at[order], np.arange(1, len(some)))), strict=True):
                wanted[node] = found[:NEAREST].tolist()
        todo = list(wanted)
        for turn in itertools.count():
            bound = most if turn < ROUNDS else len(self.ids)
            lossy = [node for node in todo if self._link_lost(node, wanted[node], bound)]
            if not lossy and len(todo) == len(wanted):
                break
            # New links may lead other searches astray, so in the end all are run again.
            todo = lossy or list(wanted)

    def _link_lost(self, node: int, wanted: list[int], most: int) -> bool:
        """Whether the search from ``node``'s vector lost any of ``wanted`` that then got links; of distances that are no numbers it may lose some for good."""
        row = np_distance(self.metric, self.vectors, self.vectors[node]).tolist()
        met = np.array([n for _, n in self.nodes(lambda nodes: [row[n] for n in nodes], BREADTH)])
        lost, linked = [n for n in wanted if n not in met], False
        for n in lost:
            far = matrix(self.metric, self.vectors[n : n + 1], self.vectors[met])[0]
            near = [x for x in met[np.lexsort((met, far))].tolist() if n not in self.links[x][0]]
            free = next((x for x in near if len(self.links[x][0]) < most), None)
            if free is None and near:
                free = near[0]
                held = np.array(self.links[free][0])
                longest = int(held[matrix(self.metric, self.vectors[free : free + 1], self.vectors[held])[0].argmax()])
                self.links[free][0].remove(longest)
                if longest not in self.links[n][0] and longest != n and len(self.links[n][0]) < most:
                    self.links[n][0].append(longest)
            if free is not None:
                self.links[free][0].append(n)
                linked = True
        return linked

    def dump(self) -> bytes:
        return pickle.dumps((self.ids, self.vectors, self.levels, self.links, self.entry, self.metric.value), protocol=5)

    @staticmethod
    def restore(data: bytes) -> Graph:
        ids, vectors, levels, links, entry, metric = pickle.loads(data)  # noqa: S301  written by this program
        return Graph(ids, vectors, levels, links, entry, DistanceMetric(metric))


def matrix(metric: DistanceMetric, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What orders the rows of ``b`` by their distance to each row of ``a``, by one matrix product: squares for the Euclidean distance."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    with np.errstate(all="ignore"):
        dots = x @ y.T
        if metric is DistanceMetric.DotProduct:
            return np.nan_to_num(dots, nan=np.inf)
        xx, yy = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)
        if metric is DistanceMetric.Cosine:
            return np.nan_to_num(1 - dots / np.sqrt(xx * yy), nan=np.inf)
        return np.maximum(xx + yy - 2 * dots, 0)


def build_graph(ids: list[str], vectors: np.ndarray, metric: DistanceMetric, params: IndexParams) -> Graph:
    """The graph of records, which are added in ascending order of their ids.

    A node's candidates in a layer are its nearest nodes among those before it. They are found
    exactly, by matrix products of ``BLOCK`` nodes at a time, rather than by searching the graph. Once all
    are in, what searches lose is linked (see :meth:`Graph.mend`).
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i].encode())
    ids, vectors = [ids[i] for i in order], vectors[order]
    levels = [level_of(x, params.seed, params.m) for x in ids]
    graph = Graph(ids, vectors, levels, [[] for _ in ids], -1, metric)
    members = [np.flatnonzero(np.array(levels) >= layer) for layer in range(max(levels, default=0) + 1)]
    for start in range(0, len(ids), BLOCK):
        end = min(len(ids), start + BLOCK)
        near = matrix(metric, vectors[start:end], vectors[:end])
        for node in range(start, end):
            graph.add(node, near[node - start], members, params.m, params.ef_construction)
    graph.mend(2 * params.m)
    return graph


def shards_for(count: int, size: int | None = None) -> int:
    return max(1, -(-count // (size or SHARD)))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")


def refresh(graphs: DataFrame, records: DataFrame, changed: DataFrame, metric: DistanceMetric, params: IndexParams, shards: int) -> DataFrame:
    """``graphs`` with those shards built anew that ``changed(id)`` touches: new records are inserted, replaced ones moved, and deleted ones gone. At most one number a shard is broadcast."""
    touched = F.broadcast(changed.select(shard_of(shards).alias("shard")).distinct())
    some = records.withColumn("shard", shard_of(shards)).join(touched, "shard", "left_semi").drop("shard")
    return graphs.join(touched, "shard", "left_anti").select("shard", "graph").unionByName(build(some, metric, params, shards))


def build(records: DataFrame, metric: DistanceMetric, params: IndexParams, shards: int) -> DataFrame:
    """``shard, graph`` of all shards. Shards go to partitions by their number, so that none gets two while another idles."""
    dealt = records.select("id", "vector", shard_of(shards).alias("shard")).repartitionById(shards, F.col("shard"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for pdf in batches:
            for shard, own in pdf.groupby("shard"):
                held.setdefault(int(shard), []).append(own)
        for shard, parts in sorted(held.items()):
            own = pd.concat(parts)
            graph = build_graph(own["id"].tolist(), np.array(own["vector"].tolist(), np.float32), metric, params)
            yield pd.DataFrame({"shard": [shard], "graph": [graph.dump()]})

    return dealt.mapInPandas(run, GRAPHS)


def search(graphs: DataFrame, queries: np.ndarray, keys: list, k: int, ef: int, key: str = "string") -> DataFrame:
    """``query_id, id, distance`` of each shard's ``k`` best for each query; the caller merges and ranks them."""
    held = graphs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(queries, np.float32), keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, names = held.value
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                graph = Graph.restore(blob)
                rows = [(name, i, d) for name, q in zip(names, vectors, strict=True) for d, i in graph.search(q, k, ef)]
                if rows:
                    own, ids, dist = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array(list(ids), pa.string()), pa.array(list(dist), pa.float32())], ["query_id", "id", "distance"])

    return graphs.select("graph").mapInArrow(run, f"query_id {key}, id string, distance float")
