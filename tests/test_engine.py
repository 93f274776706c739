import math
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import nearfield as nf
from nearfield.functions.distance import np_distance
from nearfield.sources.shared import Scratch
from nearfield.types import DistanceMetric, IndexType


@pytest.fixture
def engine(spark):
    return nf.Engine(spark)


def nearest(rows, query, k, metric):
    d = {i: float(np_distance(metric, np.array(v, np.float32), np.array(query, np.float32))) for i, v in rows.items()}
    return sorted(d.items(), key=lambda x: (x[1], x[0].encode()))[:k]


def test_lifecycle(engine):
    assert engine.list_collections() == []
    engine.create_collection("b", 2, "L2")
    engine.create_collection("a", 3, "IP").insert("x", [1, 2, 3])
    assert [(i.name, i.dimensionality, i.metric, i.record_count) for i in engine.list_collections()] == [("a", 3, DistanceMetric.DotProduct, 1), ("b", 2, DistanceMetric.Euclidean, 0)]
    with pytest.raises(nf.NameConflictError):
        engine.create_collection("a", 2, "l2")
    for name, dim, metric, error in (("", 2, "l2", nf.InvalidNameError), ("é" * 128, 2, "l2", ValueError), ("c", 0, "l2", nf.InvalidDimensionalityError), ("c", 65537, "l2", nf.InvalidDimensionalityError), ("", 0, "manhattan", nf.InvalidMetricError)):
        with pytest.raises(error):
            engine.create_collection(name, dim, metric)
    engine.deletion_fault = lambda name: name == "a"
    with pytest.raises(nf.DeletionFailedError):
        engine.delete_collection("a")
    assert engine.get_collection("a").count() == 1 and engine.allocation_stats() == {"a": 64, "b": 0}
    engine.deletion_fault = None
    engine.delete_collection("a")
    with pytest.raises(KeyError):
        engine.get_collection("a")
    with pytest.raises(nf.NotFoundError) as e:
        engine.delete_collection("zz")
    assert str(e.value).startswith("NotFound: ")


def test_records(engine):
    c = engine.create_collection("c", 3, "l2")
    c.insert("a", (1, 2.5, True), {"s": "x", "i": 1, "d": 1.0, "b": True})
    c.insert("b", np.array([1, 2, 3], np.int64))
    c.insert_batch([("a", [4, 5, 6]), ("c", [0, 0, 0], {}), ("c", [1, 1, 1], None)])
    assert c.count() == 3 and c.get("a") == ([4.0, 5.0, 6.0], None) and c.get("c") == ([1.0, 1.0, 1.0], None)
    c.insert("a", [1, 2, 3], {"s": "x", "i": 1, "d": 1.0, "b": True, "e": ""})
    c.insert("e", [1, 2, 3], {})
    assert c.count() == 4
    meta = c.get("a")[1]
    assert meta == {"b": True, "d": 1.0, "e": "", "i": 1, "s": "x"} and list(meta) == sorted(meta) and [type(meta[k]) for k in "bdi"] == [bool, float, int]
    assert c.get("e")[1] == {}
    c.delete("a")
    with pytest.raises(nf.NotFoundError):
        c.get("a")
    with pytest.raises(nf.NotFoundError):
        c.delete("a")
    c.insert("a", [9, 9, 9])
    assert c.count() == 4 and len(c) == 4


@pytest.mark.parametrize(
    ("batch", "error"),
    [
        ([], nf.InvalidArgumentError), ([(str(i), [0, 0, 0]) for i in range(10_001)], nf.InvalidArgumentError), ([("ok", [1, 2, 3]), ("bad", [1, 2])], nf.DimensionMismatchError), ([("ok", [1, 2, 3]), ("bad", [1, math.inf, 3])], nf.InvalidValueError),
        ([("ok", [1, 2, 3]), ("", [1, 2, 3])], nf.InvalidIdentifierError), ([("x",)], TypeError), ([("x", [1, "two", 3])], TypeError), ([(1, [1, 2, 3])], TypeError), ([("x", [1, 2, 3], 5)], TypeError), (7, TypeError), ([("x", [1e39, 0, 0])], nf.InvalidValueError),
    ],
)
def test_batch_is_atomic(engine, batch, error):
    c = engine.create_collection("c", 3, "l2")
    with pytest.raises(error):
        c.insert_batch(batch)
    assert c.count() == 0


def test_type_errors(engine):
    c = engine.create_collection("c", 3, "l2")
    for bad in ("1 2 3", b"\x01\x02\x03", {1: 1, 2: 2, 3: 3}, iter([1, 2, 3]), np.float32(2), [None, 1, 2], [[1], [2], [3]]):
        with pytest.raises(TypeError):
            c.insert("x", bad)
        with pytest.raises(TypeError):
            c.query(bad, 1)
    with pytest.raises(TypeError, match="element 1"):
        c.insert("x", [1, 1j, "z"])
    for meta in ({1: 2}, {"a": [1]}, 5):
        with pytest.raises(TypeError):
            c.insert("x", [1, 2, 3], meta)
    for k in (0, -1, 1.5, "1"):
        with pytest.raises(nf.InvalidArgumentError):
            c.query([1, 2, 3], k)
    with pytest.raises(nf.DimensionMismatchError):
        c.query([1, 2], 1)
    with pytest.raises(nf.InvalidValueError):
        c.query([1, 2, math.nan], 1)
    assert c.query([1, 2, 3], 5) == []


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
@pytest.mark.parametrize("index", [None, "hnsw", "ivf"])
def test_queries_and_changes(engine, metric, index):
    rng = np.random.default_rng(3)
    rows = {f"r{i}": rng.integers(-10, 11, 6).tolist() for i in range(60)}
    rows["r10"] = rows["r2"]  # a tie, by bytes r10 < r2
    rows["zero"] = [0] * 6
    c = engine.create_collection("c", 6, metric)
    c.insert_batch(list(rows.items()))
    if index:
        c.build_index(index)
        assert c.index_type() is IndexType[index.upper()]
    kind = c.metric
    q = [3, -2, 0, 1, 4, 4]
    every = {"nprobe": 1000, "ef_search": 1000}
    assert c.query(q, 7, **every) == nearest(rows, q, 7, kind)
    assert c.query(q, 1000) == nearest(rows, q, 1000, kind)
    gone = c.query(q, 1, **every)[0][0]
    c.delete(gone)
    del rows[gone]
    rows["r5"], rows["new"] = [1, 1, 1, 1, 1, 1], [3, -2, 0, 1, 4, 5]
    c.insert("r5", rows["r5"])
    c.insert("new", rows["new"])
    assert c.query(q, 9, **every) == nearest(rows, q, 9, kind)
    assert len(c.query(q, 20, nprobe=1, ef_search=1)) == 20


def test_index_parameters(engine):
    c = engine.create_collection("c", 2, "l2")
    c.insert_batch([(f"r{i}", [i, i]) for i in range(5)])
    for params in ({"m": 1}, {"ef_construction": 0}, {"nlist": 6}):
        with pytest.raises(nf.InvalidParameterError):
            c.build_index("hnsw", **params)
    for kind in ("none", "tree"):
        with pytest.raises(nf.InvalidArgumentError):
            c.build_index(kind)
    assert c.index_type() is IndexType.NONE
    c.build_index("IVF", nlist=2, unknown=1)
    assert c.index_type() is IndexType.IVF


vectors = st.lists(st.integers(-1000, 1000), min_size=3, max_size=3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=1, max_size=6), vectors, min_size=1, max_size=12), vectors, st.integers(1, 15), st.sampled_from(["l2", "cosine", "dot"]))
def test_order_matches_brute_force(spark, rows, query, k, metric):
    c = nf.Engine(spark).create_collection("c", 3, metric)
    c.insert_batch(list(rows.items()))
    assert c.query(query, k) == nearest(rows, query, k, c.metric)


def test_pair_distance():
    a, b = [1, 2, 3], [4, 6, 8]
    assert nf.pair_distance(a, b, "l2") == pytest.approx(math.sqrt(50)) and nf.pair_distance(a, b, "dot") == 40
    assert nf.pair_distance(a, b, "cosine") == pytest.approx(1 - 40 / math.sqrt(14 * 116), rel=1e-5)
    with pytest.raises(nf.UndefinedDistanceError):
        nf.pair_distance([0, 0], [1, 1], "cosine")
    with pytest.raises(nf.DimensionMismatchError):
        nf.pair_distance([0], [1, 1], "l2")
    with np.errstate(all="ignore"):
        assert np_distance(DistanceMetric.Cosine, np.full(3, 3e38, np.float32), np.full(3, 3e38, np.float32)) == np.inf


def test_dataframe_ingest_and_batch_queries(spark, engine):
    c = engine.create_collection("c", 2, "l2")
    df = spark.createDataFrame([("a", [0.0, 0.0], 1), ("a", [5.0, 5.0], 2), ("b", [1.0, 1.0], 1)], "id string, vector array<float>, seq int")
    c.insert_dataframe(df, "seq")
    assert c.count() == 2 and c.get("a")[0] == [5.0, 5.0]
    for bad, error in ((("x", [1.0]), nf.DimensionMismatchError), (("", [1.0, 1.0]), nf.InvalidIdentifierError), (("x", None), nf.DimensionMismatchError), (("x", [1.0, None]), nf.InvalidValueError), ((None, [1.0, 1.0]), nf.InvalidIdentifierError)):
        with pytest.raises(error):
            c.insert_dataframe(spark.createDataFrame([("n", [0.0, 0.0]), bad], "id string, vector array<float>"))
    assert c.count() == 2
    q = spark.createDataFrame([("q1", [0.0, 0.0]), ("q2", [5.0, 5.0])], "query_id string, vector array<float>")
    got = sorted((r.query_id, r["rank"], r.id, r.distance) for r in c.query_batch(q, 1).collect())
    assert got == [("q1", 1, "b", pytest.approx(math.sqrt(2))), ("q2", 1, "a", 0.0)]


def test_stream(spark, engine, tmp_path):
    from nearfield.streaming.ingest import ingest

    for k in range(3):
        spark.createDataFrame([(f"r{k}", [float(k), 0.0]), ("same", [float(k), 1.0])], "id string, vector array<float>").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    c = engine.create_collection("c", 2, "l2")
    stream = spark.readStream.schema("id string, vector array<float>").parquet(str(tmp_path / "in" / "k=*"))
    ingest(stream, c, str(tmp_path / "state")).awaitTermination(60)
    assert c.count() == 4


def test_scratch_tables_have_no_checksum_files(spark):
    """Under a local file system each file costs a process of the JVM, so there are none but the tables' own."""
    scratch = Scratch(spark)
    table = scratch.table(spark.range(0, 1000, 1, 7), "numbers")
    files = [p.name for p in Path(scratch.base.removeprefix("file://"), "numbers").iterdir()]
    assert table.count() == 1000 and sum(f.endswith(".parquet") for f in files) == 7 and not [f for f in files if f.endswith(".crc")]
    assert scratch.table(spark.range(5), "numbers").count() == 5
