"""Queries of the driver over ``embeddings``, and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.engine import Engine
from nearfield.functions.distance import distance, first_non_finite, norm_squared
from nearfield.operators import hnsw, ivf, records
from nearfield.operators.knn import knn, knn_batch, rerank
from nearfield.plans import planner
from nearfield.sources.crc64 import crc64
from nearfield.sources.embeddings import embeddings
from nearfield.sources.shared import Scratch
from nearfield.types import DistanceMetric, IndexParams

SEED = IndexParams().seed
METRICS = {"l2": DistanceMetric.Euclidean, "cosine": DistanceMetric.Cosine, "dot": DistanceMetric.DotProduct}
QUERY_ID = 17
#: Queries of a batch are the records whose number this divides.
EVERY = 20


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings times ``1 + label``, so that metrics rank them differently."""
    factor = (F.col("label") + 1).cast("float")
    return embeddings(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: (x * factor).cast("float")))


def query_vector(rows: DataFrame, number: int = QUERY_ID) -> np.ndarray:
    return np.array(rows.filter(F.col("vec_id") == number).first()["vector"], np.float32)


def asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("vec_id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector")


def _knn(metric: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled(spark, sf_dir)
        return knn(rows, query_vector(rows), 10, metric)

    return run


def _knn_batch(metric: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = scaled(spark, sf_dir)
        return knn_batch(rows, asked(rows), 5, metric)

    return run


def knn_k_exceeds_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    return knn(rows, query_vector(rows), planner.MOST_K, "l2")


def knn_zero_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir).withColumn("vector", F.when(F.col("vec_id") % 50 == 0, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vector")))
    return knn(rows, query_vector(rows), planner.MOST_K, "cosine")


def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector twice, under unpadded ids that order by bytes."""
    rows = scaled(spark, sf_dir)
    twice = rows.withColumn("id", F.concat(F.lit("r"), F.col("vec_id"))).unionByName(rows.withColumn("id", F.concat(F.lit("s"), F.col("vec_id"))))
    return knn(twice, query_vector(rows), 40, "l2")


def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("id").alias("other"), F.col("vector").alias("other_vector"))
    pairs = rows.join(other, "vec_id")
    return pairs.select("id", "other", *[distance(m, F.col("vector"), F.col("other_vector")).alias(n) for n, m in METRICS.items()])


def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).select("id", norm_squared(F.col("vector")).alias("norm_squared"), F.sqrt(norm_squared(F.col("vector"))).cast("float").alias("norm"))


def upsert_last_writer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = embeddings(spark, sf_dir)
    writes = scaled(spark, sf_dir).filter(F.col("vec_id") % 3 == 0)
    writes = writes.withColumn("seq", F.lit(1)).unionByName(writes.withColumn("vector", F.transform("vector", lambda x: -x)).withColumn("seq", F.lit(2)))
    done = records.upsert(base.select("id", "vector", "label"), writes, "seq")
    return done.select("id", "label", norm_squared(F.col("vector")).alias("norm_squared"), F.get("vector", F.lit(0)).alias("first"))


def delete_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(spark, sf_dir)
    left = records.delete(rows, rows.filter(F.col("vec_id") % 2 == 1))
    return knn(left, query_vector(rows), 20, "l2")


def get_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.get(embeddings(spark, sf_dir), f"rec-{QUERY_ID:06d}")
    return found.select("id", "label", F.posexplode("vector").alias("place", "component"))


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    broken = embeddings(spark, sf_dir).withColumn("id", F.when(n % 11 == 0, "").otherwise(F.col("id")))
    vector = F.when(n % 7 == 0, F.slice("vector", 1, 10)).when(n % 5 == 0, F.transform("vector", lambda x, i: F.when(i == n % 64, F.lit(float("inf")).cast("float")).otherwise(x))).otherwise(F.col("vector"))
    checked = records.validate(broken.withColumn("vector", vector), 64)
    return checked.select("vec_id", "code", first_non_finite(F.col("vector")).alias("bad_component"))


def _collection(spark: SparkSession, sf_dir: str, **index):
    """A collection of the scaled embeddings, through the API."""
    made = Engine(spark).create_collection("all", 64, "l2")
    made.insert_dataframe(scaled(spark, sf_dir).select("id", "vector"))
    if index:
        made.build_index(**index)
    return made


def _answers(spark: SparkSession, found: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(found, "id string, distance float")


def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each label, made and listed by the engine."""
    rows, engine = embeddings(spark, sf_dir), Engine(spark)
    for label in range(10):
        own = rows.filter(F.col("label") == label)
        if own.limit(1).count():
            engine.create_collection(f"label-{label}", 64, "l2").insert_dataframe(own.select("id", "vector"))
    return engine.collections_table()


def api_query_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of a collection without an index."""
    rows = scaled(spark, sf_dir)
    return _answers(spark, _collection(spark, sf_dir).query(query_vector(rows), 10))


def api_query_ivf_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More probes than cells are all cells, so the index answers exactly."""
    rows = scaled(spark, sf_dir)
    return _answers(spark, _collection(spark, sf_dir, type="ivf").query(query_vector(rows), 10, nprobe=1_000_000))


def api_query_k_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many neighbours as records: the scan answers, not the graphs."""
    rows = scaled(spark, sf_dir)
    return _answers(spark, _collection(spark, sf_dir, type="hnsw", ef_construction=32).query(query_vector(rows), 1_000_000_000))


def api_retrain_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are made anew for records that came after the index, and deleted ones are gone."""
    rows = scaled(spark, sf_dir)
    made = Engine(spark).create_collection("all", 64, "l2")
    made.insert_dataframe(rows.filter("vec_id % 2 = 0").select("id", "vector"))
    made.build_index("ivf")
    made.query(query_vector(rows), 10, nprobe=4)
    made.insert_dataframe(rows.filter("vec_id % 2 = 1").select("id", "vector"))
    made.delete(f"rec-{QUERY_ID:06d}")
    return _answers(spark, made.query(query_vector(rows), 10, nprobe=1_000_000))


def api_insert_after_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written after graphs were built are found: each of a batch of queries finds itself first, through the graphs."""
    rows = scaled(spark, sf_dir)
    made = Engine(spark).create_collection("all", 64, "l2")
    made.insert_dataframe(rows.filter("vec_id % 4 <> 0").select("id", "vector"))
    made.build_index("hnsw", ef_construction=64)
    made.insert_dataframe(rows.filter("vec_id % 4 = 0").select("id", "vector"))
    found = made.query_batch(asked(rows), 1, exact=False, ef_search=200)
    return found.select("query_id", "rank", "id", "distance")


def api_snapshot_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one snapshot file, written and read back."""
    engine = Engine(spark)
    engine.create_collection("all", 64, "l2").insert_dataframe(embeddings(spark, sf_dir).select("id", "vector"))
    with tempfile.TemporaryDirectory() as folder:  # a file of the driver's own, read back by the driver
        engine.save("all", f"{folder}/all.snap")
        loaded = Engine(spark).load(f"{folder}/all.snap").table()
        rows = loaded.select("id", norm_squared(F.col("vector")).alias("norm_squared")).collect()
    return spark.createDataFrame(rows, "id string, norm_squared float")


def crc64_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum's published check value, and that it can be continued."""
    data = b"123456789"
    return spark.createDataFrame([("whole", f"{crc64(data):016x}"), ("continued", f"{crc64(data[4:], crc64(data[:4])):016x}")], "name string, crc string")


def allocation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.storage(embeddings(spark, sf_dir))


def rerank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with repeats and stale ids."""
    rows = scaled(spark, sf_dir)
    some = rows.filter(F.col("vec_id") % 4 == 0).select("id")
    stale = rows.filter(F.col("vec_id") % 4 == 1).select(F.concat(F.lit("gone-"), F.col("id")).alias("id"))
    return rerank(rows, some.union(some).union(stale), query_vector(rows), 10, "l2")


def fallback_underdelivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two live candidates for ten neighbours: the exact scan answers."""
    rows = scaled(spark, sf_dir)
    q = query_vector(rows)
    found = rerank(rows, rows.filter("vec_id < 2").select("id"), q, 10, DistanceMetric.Euclidean)
    got = planner.with_fallback(found, rows, q, 10, rows.count(), DistanceMetric.Euclidean)
    return spark.createDataFrame(got, "id string, distance float")


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ivf.IvfModel]:
    rows = scaled(spark, sf_dir)
    return rows, ivf.train(rows, ivf.effective_nlist(0, rows.count()), SEED)


def ivf_nlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = embeddings(spark, sf_dir).count()
    return spark.createDataFrame([(asked_, ivf.effective_nlist(asked_, n)) for asked_ in (0, 1, 16, 1_000_000)], "asked long, nlist long")


def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _trained(spark, sf_dir)
    return ivf.assign(rows, model).select("id", "cell")


def ivf_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, model = _trained(spark, sf_dir)
    made = spark.createDataFrame(ivf.centroid_rows(model), "cell int, centroid array<float>")
    return made.select("cell", F.posexplode("centroid").alias("place", "component"))


def _ivf_search(nprobe: int | None) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, model = _trained(spark, sf_dir)
        scratch = Scratch(spark)
        path = scratch.folder("postings")
        ivf.assign(rows.select("id", "vector"), model).write.mode("overwrite").partitionBy("cell").parquet(path)
        postings = spark.read.schema("id string, vector array<float>, cell int").parquet(path)
        return ivf.search(postings, model, query_vector(rows), 10, nprobe or len(model.centroids), DistanceMetric.Euclidean)

    return run


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharded graphs at the default breadth, all queries, exact ranking."""
    rows = scaled(spark, sf_dir)
    graphs = Scratch(spark).table(hnsw.build(rows, DistanceMetric.Euclidean, IndexParams(), hnsw.shards_for(rows.count())), "graphs")
    queries = [(r["query_id"], r["vector"]) for r in asked(rows).collect()]
    return planner.hnsw_batch(rows, graphs, queries, 10, 50, DistanceMetric.Euclidean)


def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the graphs find at least nine tenths of the exact ten nearest, over all queries."""
    rows = scaled(spark, sf_dir)
    exact = knn_batch(rows, asked(rows), 10, "l2").select("query_id", "id")
    found = hnsw_search(spark, sf_dir).select("query_id", "id").withColumn("hit", F.lit(1))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*") >= 0.9).alias("recalled"))


def hnsw_full_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search as broad as the graph is exact."""
    rows = scaled(spark, sf_dir)
    n = rows.count()
    graphs = Scratch(spark).table(hnsw.build(rows, DistanceMetric.Euclidean, IndexParams(ef_construction=64), hnsw.shards_for(n)), "graphs")
    return planner.hnsw_query(rows, graphs, None, 0, query_vector(rows), 10, n, DistanceMetric.Euclidean)


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records saved to Parquet with their manifest, and loaded."""
    engine, uri = Engine(spark), Scratch(spark).folder("snapshot")
    label = F.create_map(F.lit("label"), F.struct(F.lit(1).cast("tinyint").alias("t"), F.lit(None).cast("string").alias("s"), F.col("label").cast("long").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("boolean").alias("b")))
    engine.create_collection("all", 64, "l2").insert_dataframe(embeddings(spark, sf_dir).withColumn("meta", label))
    engine.save_table("all", uri)
    loaded = Engine(spark).load_table(uri).table()
    return loaded.select("id", F.col("meta")["label"]["i"].alias("label"), norm_squared(F.col("vector")).alias("norm_squared"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"knn_{m}": _knn(m) for m in METRICS},
    **{f"knn_batch_{m}": _knn_batch(m) for m in METRICS},
    "knn_k_exceeds_count": knn_k_exceeds_count,
    "knn_zero_norm": knn_zero_norm,
    "knn_ties": knn_ties,
    "pairwise_distance": pairwise_distance,
    "vector_norm": vector_norm,
    "upsert_last_writer_wins": upsert_last_writer_wins,
    "delete_excludes": delete_excludes,
    "get_record": get_record,
    "validate_records": validate_records,
    "list_collections": list_collections,
    "allocation_stats": allocation_stats,
    "rerank_candidates": rerank_candidates,
    "fallback_underdelivery": fallback_underdelivery,
    "ivf_nlist": ivf_nlist,
    "ivf_assign": ivf_assign,
    "ivf_centroids": ivf_centroids,
    "ivf_search_nprobe1": _ivf_search(1),
    "ivf_search_nprobe4": _ivf_search(4),
    "ivf_full_probe": _ivf_search(None),
    "hnsw_search": hnsw_search,
    "hnsw_recall": hnsw_recall,
    "hnsw_full_breadth": hnsw_full_breadth,
    "snapshot_roundtrip": snapshot_roundtrip,
    "api_query_exact": api_query_exact,
    "api_query_ivf_clamped": api_query_ivf_clamped,
    "api_query_k_all": api_query_k_all,
    "api_retrain_after_writes": api_retrain_after_writes,
    "api_insert_after_graphs": api_insert_after_graphs,
    "api_snapshot_file": api_snapshot_file,
    "crc64_check": crc64_check,
}


# -- SQL ------------------------------------------------------------------------------------------


def _red(a: str, b: str, term: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda z: {term})) AS FLOAT)"


def _sq(a: str, b: str) -> str:
    return _red(a, b, "(z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)")


def _dot(a: str, b: str) -> str:
    return _red(a, b, "z[1]::DOUBLE * z[2]::DOUBLE")


def _sql_distance(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return f"CAST(sqrt({_sq(a, b)}) AS FLOAT)"
    if metric == "dot":
        return _dot(a, b)
    na, nb = _dot(a, a), _dot(b, b)
    q = f"CAST({_dot(a, b)}::DOUBLE / NULLIF(CAST(CAST(sqrt({na}) AS FLOAT) * CAST(sqrt({nb}) AS FLOAT) AS FLOAT), 0)::DOUBLE AS FLOAT)"
    return f"CASE WHEN {na} = 0 OR {nb} = 0 THEN 'inf'::FLOAT ELSE greatest(least(CAST(1::FLOAT - {q} AS FLOAT), 2::FLOAT), 0::FLOAT) END"


_ROWS = "plain AS (SELECT vec_id, 'rec-' || lpad(vec_id::VARCHAR, 6, '0') AS id, embedding::FLOAT[] AS vector, label FROM embeddings), r AS (SELECT vec_id, id, list_transform(vector, lambda x: CAST(x * (label + 1)::FLOAT AS FLOAT)) AS vector, label FROM plain)"
_Q = f"q AS (SELECT vector AS v FROM r WHERE vec_id = {QUERY_ID})"


def _sql_knn(metric: str, k: int | None, source: str = "r") -> str:
    limit = f" LIMIT {k}" if k else ""
    return f"WITH {_ROWS}, {_Q} SELECT s.id, {_sql_distance(metric, 's.vector', 'q.v')} AS distance FROM {source} s, q ORDER BY distance, s.id{limit}"


def _sql_batch(metric: str, k: int = 5) -> str:
    return (
        f"WITH {_ROWS}, d AS (SELECT a.id AS query_id, s.id AS id, {_sql_distance(metric, 's.vector', 'a.vector')} AS distance FROM r s, r a WHERE a.vec_id % {EVERY} = 0), "
        f"n AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM d) SELECT query_id, rank, id, distance FROM n WHERE rank <= {k}"
    )


def _sql_ivf(final: str) -> str:
    """Lloyd's rounds written out; ``final`` selects from the last assignment ``a{n}`` and centroids ``c{n}``."""
    n = ivf.ITERATIONS
    ctes = [
        _ROWS,
        _Q,
        "params AS (SELECT CAST(greatest(1, floor(sqrt(count(*)))) AS BIGINT) AS nlist FROM r)",
        f"c0 AS MATERIALIZED (SELECT CAST(o - 1 AS INTEGER) AS cell, vector AS c FROM (SELECT vector, row_number() OVER (ORDER BY md5('{SEED}:' || id), id) AS o FROM r), params WHERE o <= nlist)",
    ]
    for k in range(1, n + 1):
        ctes.append(f"a{k} AS MATERIALIZED (SELECT id, vector, arg_min(cell, (d, cell)) AS cell FROM (SELECT r.id, r.vector, c.cell, {_sq('r.vector', 'c.c')} AS d FROM r, c{k - 1} c) GROUP BY id, vector)")
        ctes.append(
            f"m{k} AS (SELECT cell, list(v ORDER BY place) AS c FROM (SELECT cell, place, CAST(sum(x::DOUBLE) / count(*) AS FLOAT) AS v FROM (SELECT cell, unnest(vector) AS x, generate_subscripts(vector, 1) AS place FROM a{k}) GROUP BY cell, place) GROUP BY cell)"
        )
        ctes.append(f"c{k} AS MATERIALIZED (SELECT p.cell, coalesce(m.c, p.c) AS c FROM c{k - 1} p LEFT JOIN m{k} m ON m.cell = p.cell)")
    return f"WITH {', '.join(ctes)} {final.format(n=n)}"


def _sql_probe(nprobe: int) -> str:
    return _sql_ivf(
        f"SELECT a.id, {_sql_distance('l2', 'a.vector', 'q.v')} AS distance FROM a{{n}} a, q WHERE a.cell IN (SELECT cell FROM c{{n}} c, q ORDER BY {_sq('c.c', 'q.v')}, cell LIMIT {nprobe}) ORDER BY distance, a.id LIMIT 10"
    )


_ZERO = "(SELECT vec_id, id, CASE WHEN vec_id % 50 = 0 THEN list_transform(vector, lambda x: 0::FLOAT) ELSE vector END AS vector FROM r)"
_BAD = (
    "(SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN '' ELSE id END AS id, CASE WHEN vec_id % 7 = 0 THEN vector[1:10] "
    "WHEN vec_id % 5 = 0 THEN list_transform(vector, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN 'inf'::FLOAT ELSE x END) ELSE vector END AS vector FROM plain)"
)
_PLACE = "coalesce(list_position(list_transform(vector, lambda x: isnan(x) OR isinf(x)), true), 0) - 1"

ORACLES: dict[str, str] = {
    **{f"knn_{m}": _sql_knn(m, 10) for m in METRICS},
    **{f"knn_batch_{m}": _sql_batch(m) for m in METRICS},
    "knn_k_exceeds_count": _sql_knn("l2", None),
    "knn_zero_norm": _sql_knn("cosine", None, _ZERO),
    "knn_ties": _sql_knn("l2", 40, "(SELECT 'r' || vec_id AS id, vector FROM r UNION ALL SELECT 's' || vec_id, vector FROM r)"),
    "pairwise_distance": f"WITH {_ROWS} SELECT a.id, b.id AS other, " + ", ".join(f"{_sql_distance(m, 'a.vector', 'b.vector')} AS {m}" for m in METRICS) + " FROM r a JOIN r b ON b.vec_id = a.vec_id + 1",
    "vector_norm": f"WITH {_ROWS} SELECT id, {_dot('vector', 'vector')} AS norm_squared, CAST(sqrt({_dot('vector', 'vector')}) AS FLOAT) AS norm FROM r",
    "upsert_last_writer_wins": (
        f"WITH {_ROWS}, done AS (SELECT p.id, p.label, CASE WHEN p.vec_id % 3 = 0 THEN list_transform(r.vector, lambda x: -x) ELSE p.vector END AS vector FROM plain p JOIN r ON r.vec_id = p.vec_id) "
        f"SELECT id, label, {_dot('vector', 'vector')} AS norm_squared, vector[1] AS \"first\" FROM done"
    ),
    "delete_excludes": _sql_knn("l2", 20, "(SELECT * FROM r WHERE vec_id % 2 = 0)"),
    "get_record": f"WITH {_ROWS} SELECT id, label, CAST(generate_subscripts(vector, 1) - 1 AS INTEGER) AS place, unnest(vector) AS component FROM plain WHERE vec_id = {QUERY_ID}",
    "validate_records": f"WITH {_ROWS} SELECT vec_id, CAST(CASE WHEN length(id) = 0 THEN 1 WHEN len(vector) <> 64 THEN 2 WHEN {_PLACE} >= 0 THEN 3 ELSE 0 END AS INTEGER) AS code, CAST({_PLACE} AS INTEGER) AS bad_component FROM {_BAD}",
    "list_collections": "SELECT 'label-' || label AS name, CAST(max(len(embedding)) AS INTEGER) AS dimensionality, 'Euclidean' AS metric, count(*) AS record_count FROM embeddings GROUP BY label ORDER BY name",
    "allocation_stats": "SELECT count(*) AS records, count(*) AS blocks, CAST(sum((len(embedding) * 4 + 63) // 64 * 64) AS BIGINT) AS bytes FROM embeddings",
    "rerank_candidates": _sql_knn("l2", 10, "(SELECT * FROM r WHERE vec_id % 4 = 0)"),
    "fallback_underdelivery": _sql_knn("l2", 10),
    "ivf_nlist": "SELECT asked, CAST(greatest(1, least(CASE WHEN asked = 0 THEN floor(sqrt(n)) ELSE asked END, n)) AS BIGINT) AS nlist FROM (SELECT unnest([0, 1, 16, 1000000]::BIGINT[]) AS asked), (SELECT count(*) AS n FROM embeddings)",
    "ivf_assign": _sql_ivf("SELECT id, cell FROM a{n}"),
    "ivf_centroids": _sql_ivf("SELECT cell, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS place, unnest(c) AS component FROM c{n}"),
    "ivf_search_nprobe1": _sql_probe(1),
    "ivf_search_nprobe4": _sql_probe(4),
    "ivf_full_probe": _sql_knn("l2", 10),
    "hnsw_full_breadth": _sql_knn("l2", 10),
    "snapshot_roundtrip": f"WITH {_ROWS} SELECT id, label::BIGINT AS label, {_dot('vector', 'vector')} AS norm_squared FROM plain",
    "hnsw_recall": f"SELECT count(*) AS queries, true AS recalled FROM embeddings WHERE vec_id % {EVERY} = 0",
    "api_query_exact": _sql_knn("l2", 10),
    "api_query_ivf_clamped": _sql_knn("l2", 10),
    "api_query_k_all": _sql_knn("l2", None),
    "api_retrain_after_writes": _sql_knn("l2", 10, f"(SELECT * FROM r WHERE vec_id <> {QUERY_ID})"),
    "api_insert_after_graphs": _sql_batch("l2", 1),
    "api_snapshot_file": f"WITH {_ROWS} SELECT id, {_dot('vector', 'vector')} AS norm_squared FROM plain",
    "crc64_check": "SELECT unnest(['whole', 'continued']) AS name, '6c40df5f0b497347' AS crc",
}
