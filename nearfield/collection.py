"""A named collection of vectors: immutable table versions, with recent small writes on the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatchError, InvalidArgumentError, InvalidIdentifierError, InvalidParameterError, InvalidValueError, NotFoundError
from nearfield.operators import hnsw, ivf, records
from nearfield.operators.knn import knn, knn_batch
from nearfield.plans import planner
from nearfield.sources.shared import Scratch
from nearfield.types import MAX_BATCH, RECORD, CollectionInfo, DistanceMetric, IndexParams, IndexType, decode_meta, encode_meta, parse_index_type, to_vector


class Collection:
    """Records of one dimensionality and metric.

    Single inserts and batches are validated and kept on the driver until there are ``MAX_BATCH``
    of them or a query needs them; then they become the next version of the table, which is written
    to the shared folder. Readers hold on to the version that they began with.
    """

    def __init__(self, spark: SparkSession, name: str, dim: int, metric: DistanceMetric, reserve: Callable[[Collection, int], None] = lambda coll, more: None):
        self.spark, self.name, self.dimensionality, self.metric = spark, name, dim, metric
        self._scratch, self._lock, self._reserve = Scratch(spark), threading.RLock(), reserve
        #: Bytes of one vector, in blocks of whole 64 bytes.
        self.block_bytes = -(-dim * 4 // 64) * 64
        self._base: DataFrame = spark.createDataFrame([], RECORD)
        self._known: int | None = 0
        self._pending: dict[str, tuple[np.ndarray, dict | None] | None] = {}
        self._version = 0
        self._kind, self.params = IndexType.NONE, IndexParams()
        self._graphs: DataFrame | None = None
        #: Into how many shards the graphs deal records by hash; None for graphs that were loaded.
        self._shards: int | None = None
        self._changed: DataFrame | None = None
        self._cells: tuple[int, ivf.IvfModel, DataFrame] | None = None

    # -- records ---------------------------------------------------------------------------------

    def _check(self, record_id: str, vector: np.ndarray) -> None:
        if not record_id:
            raise InvalidIdentifierError("a record needs an id of at least one character")
        if len(vector) != self.dimensionality:
            raise DimensionMismatchError(f"{len(vector)} components where the collection takes {self.dimensionality}")
        if not np.isfinite(vector).all():
            raise InvalidValueError(f"component {int(np.flatnonzero(~np.isfinite(vector))[0])} is not finite")

    def insert(self, id: str, vector, metadata: dict | None = None) -> None:  # noqa: A002
        """Insert a record or replace the one with this id, vector and metadata both."""
        if not isinstance(id, str):
            raise TypeError("an id must be a string")
        values, meta = to_vector(vector), encode_meta(metadata)
        self._check(id, values)
        self._write({id: (values, meta)})

    def insert_batch(self, batch) -> None:
        """Insert 1 to 10,000 records ``(id, vector)`` or ``(id, vector, metadata)``, all or none; of equal ids the last wins."""
        if isinstance(batch, (str, bytes, dict)) or not hasattr(batch, "__iter__"):
            raise TypeError("a batch is an iterable of records")
        rows = []
        for k, record in enumerate(batch):
            if not isinstance(record, (tuple, list)) or len(record) not in (2, 3):
                raise TypeError(f"record {k} is not (id, vector) or (id, vector, metadata)")
            if not isinstance(record[0], str):
                raise TypeError(f"the id of record {k} is not a string")
            rows.append((record[0], to_vector(record[1]), encode_meta(record[2]) if len(record) == 3 else None))
        if not 1 <= len(rows) <= MAX_BATCH:
            raise InvalidArgumentError(f"a batch must have 1 to {MAX_BATCH} records, not {len(rows)}")
        for record_id, vector, _ in rows:
            self._check(record_id, vector)
        self._write({record_id: (vector, meta) for record_id, vector, meta in rows})

    def insert_dataframe(self, df: DataFrame, order: str | None = None) -> None:
        """Insert any number of records ``id, vector`` and perhaps ``meta`` from a DataFrame, all or none.

        Of rows with equal ids the one with the highest ``order`` wins.
        """
        meta = F.col("meta") if "meta" in df.columns else F.lit(None)
        rank = F.col(order) if order else F.monotonically_increasing_id()
        writes = df.select(F.col("id").cast("string"), F.col("vector").cast("array<float>").alias("vector"), meta.cast(self._base.schema["meta"].dataType).alias("meta"), rank.alias("__order"))
        with self._lock:
            self._flush()
            writes = self._scratch.table(writes, f"staged-{self._version}")
            if bad := records.first_invalid(writes, self.dimensionality, "__order"):
                records.raise_invalid(bad[2], bad[1], self.dimensionality)
            self._reserve(self, writes.count())
            self._publish(records.upsert(self._base, writes, "__order"), writes.select("id"))

    def _write(self, rows: dict) -> None:
        with self._lock:
            self._reserve(self, len(rows))
            for key, row in rows.items():
                self._pending[key] = row
            self._known = None
            if len(self._pending) >= MAX_BATCH:
                self._flush()

    def _publish(self, table: DataFrame, touched: DataFrame) -> None:
        """Make ``table`` the next version; ``touched`` are the ids that differ."""
        self._version += 1
        self._base = self._scratch.table(table.select("id", "vector", "meta"), f"version-{self._version}")
        self._known = None
        if self._kind is IndexType.HNSW:
            changed = touched.select("id") if self._changed is None else self._changed.unionByName(touched.select("id"))
            self._changed = self._scratch.table(changed.distinct(), f"changed-{self._version}")

    def _flush(self) -> None:
        if not self._pending:
            return
        rows = [(k, [float(x) for x in v[0]], v[1]) for k, v in self._pending.items() if v is not None]
        gone = self.spark.createDataFrame([(k,) for k in self._pending], "id string")
        new = self.spark.createDataFrame(rows, RECORD)
        self._publish(self._base.join(gone, "id", "left_anti").unionByName(new), gone)
        self._pending = {}

    def table(self) -> DataFrame:
        """The present version: ``id, vector, meta``. Later writes don't change it."""
        with self._lock:
            self._flush()
            return self._base

    def get(self, id: str) -> tuple[list[float], dict | None]:  # noqa: A002
        with self._lock:
            if id in self._pending:
                row = self._pending[id]
            else:
                found = records.get(self._base, id).first()
                row = found and (found["vector"], found["meta"])
        if not row:
            raise NotFoundError(f"record '{id}' does not exist in collection '{self.name}'")
        return [float(x) for x in row[0]], decode_meta(row[1])

    def delete(self, id: str) -> None:  # noqa: A002
        with self._lock:
            self.get(id)
            self._pending[id] = None
            self._known = None

    def count(self) -> int:
        with self._lock:
            if self._known is None:
                self._flush()
                self._known = self._base.count()
            return self._known

    __len__ = count

    def info(self) -> CollectionInfo:
        return CollectionInfo(self.name, self.dimensionality, self.metric, self.count())

    # -- index -----------------------------------------------------------------------------------

    def index_type(self) -> IndexType:
        return self._kind

    def build_index(self, type, **params) -> None:  # noqa: A002
        """Build an index over the present records: ``hnsw`` (m, ef_construction, seed) or ``ivf`` (nlist, seed)."""
        kind = parse_index_type(type)
        wanted = IndexParams(**{k: int(v) for k, v in params.items() if k in IndexParams.__dataclass_fields__})
        with self._lock:
            n = self.count()
            if wanted.m < 2:
                raise InvalidParameterError("m must be at least 2")
            if wanted.ef_construction < 1:
                raise InvalidParameterError("ef_construction must be at least 1")
            if wanted.nlist != 0 and not 1 <= wanted.nlist <= n:
                raise InvalidParameterError(f"nlist must be 0 or from 1 to the {n} records")
            if kind is IndexType.NONE:
                raise InvalidArgumentError("an index must be hnsw or ivf")
            self._kind, self.params, self._graphs, self._changed, self._cells = kind, wanted, None, None, None
            if kind is IndexType.HNSW:
                self._build_graphs(n)

    def _build_graphs(self, count: int) -> None:
        self._shards = hnsw.shards_for(count)
        graphs = hnsw.build(self._base, self.metric, self.params, self._shards)
        self._graphs, self._changed = self._scratch.table(graphs, f"graphs-{self._version}-{self.params.m}"), None

    def _settle(self, count: int) -> int:
        """Bring records written since into the graphs when they are many; returns how many are left beside them."""
        changed = self._changed.count() if self._changed is not None else 0
        if not planner.must_refresh(changed, count):
            return changed
        if self._shards is None or hnsw.shards_for(count) > 2 * self._shards:
            self._build_graphs(count)
        else:
            graphs = hnsw.refresh(self._graphs, self._base, self._changed, self.metric, self.params, self._shards)
            self._graphs, self._changed = self._scratch.table(graphs, f"graphs-{self._version}-again"), None
        return 0

    def cells(self) -> tuple[ivf.IvfModel, DataFrame]:
        """The model and postings of the present version; they are made when first asked for."""
        with self._lock:
            self._flush()
            if self._cells is None or self._cells[0] != self._version:
                nlist = ivf.effective_nlist(self.params.nlist, self.count())
                model = ivf.train(self._base, nlist, self.params.seed)
                name = f"postings-{self._version}"
                path = f"{self._scratch.base}/{name}"
                ivf.assign(self._base.select("id", "vector"), model).write.mode("overwrite").partitionBy("cell").parquet(path)
                self._cells = (self._version, model, self.spark.read.schema("id string, vector array<float>, cell int").parquet(path))
            return self._cells[1], self._cells[2]

    # -- queries ---------------------------------------------------------------------------------

    def query(self, vector, k: int, **params) -> list[tuple[str, float]]:
        """Up to ``k`` nearest records as ``(id, distance)``, by distance then id."""
        q = to_vector(vector)
        if not isinstance(k, (int, np.integer)):
            raise InvalidArgumentError("k must be an integer")
        if k < 1:
            raise InvalidArgumentError("k must be at least 1")
        if len(q) != self.dimensionality:
            raise DimensionMismatchError(f"query has {len(q)} components, the collection {self.dimensionality}")
        if not np.isfinite(q).all():
            raise InvalidValueError("query has a component that is not finite")
        with self._lock:
            n = self.count()
            if not n:
                return []
            k = min(int(k), n)  # a limit of more would take memory for as many rows
            kind = self._kind
            extra = self._settle(n) if kind is IndexType.HNSW else 0
            base, graphs, changed = self._base, self._graphs, self._changed
            cells = self.cells() if planner.uses_index(kind, k, n) and kind is IndexType.IVF else None
        if not planner.uses_index(kind, k, n):
            found = knn(base, q, k, self.metric)
        elif kind is IndexType.IVF:
            found = ivf.search(cells[1], cells[0], q, k, int(params.get("nprobe", 1)), self.metric)
        else:
            found = planner.hnsw_query(base, graphs, changed, extra, q, k, int(params.get("ef_search", 50)), self.metric)
        return planner.with_fallback(found, base, q, k, n, self.metric)

    def query_batch(self, queries: DataFrame, k: int, exact: bool = True, **params) -> DataFrame:
        """``query_id, rank, id, distance``: the ``k`` nearest records of each of ``queries(query_id, vector)``.

        They are exact unless ``exact`` is false and there is an index; then its ``nprobe`` or ``ef_search``
        tells how far each query looks, block by block of queries.
        """
        base, n = self.table(), self.count()
        if exact or not planner.uses_index(self._kind, k, n):
            return knn_batch(base, queries, k, self.metric)
        with self._lock:
            kind = self._kind
            # Graphs take all changes in first: a batch has no place for records beside them.
            if kind is IndexType.HNSW and self._changed is not None:
                self._build_graphs(n)
            graphs, cells = self._graphs, self.cells() if kind is IndexType.IVF else None
        parts = max(1, -(-queries.count() // planner.QUERIES))
        out = None
        for p in range(parts):
            some = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).select("query_id", "vector")
            rows = [(r["query_id"], r["vector"]) for r in some.collect()]
            if kind is IndexType.IVF:
                part = planner.ivf_batch(cells[1], cells[0], rows, k, int(params.get("nprobe", 1)), self.metric)
            else:
                part = planner.hnsw_batch(base, graphs, rows, k, int(params.get("ef_search", 50)), self.metric)
            out = part if out is None else out.unionByName(part)
        return out
