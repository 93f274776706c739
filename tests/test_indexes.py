import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

import nearfield as nf
from nearfield.functions.distance import distance, np_distance, np_l2_squared
from nearfield.operators import hnsw, ivf
from nearfield.operators.knn import knn_batch
from nearfield.plans import planner
from nearfield.types import DistanceMetric, IndexParams

L2 = DistanceMetric.Euclidean


def frame(spark, x, parts=4):
    return spark.createDataFrame([(f"rec-{k:06d}", v.tolist()) for k, v in enumerate(x)], "id string, vector array<float>").repartition(parts)


def exact(x, q, k):
    d = np_distance(L2, x, q)
    return [f"rec-{i:06d}" for i in np.lexsort((np.arange(len(d)), d))[:k]]


def test_hnsw_recall(spark):
    """10,000 uniform records of 32 components at default parameters."""
    rng = np.random.default_rng(11)
    x, q = rng.uniform(-1, 1, (10_000, 32)).astype(np.float32), rng.uniform(-1, 1, (200, 32)).astype(np.float32)
    rows = frame(spark, x, 8).cache()
    graphs = hnsw.build(rows, L2, IndexParams(), hnsw.shards_for(len(x), 1_250)).cache()
    assert graphs.count() == 8
    got = planner.hnsw_batch(rows, graphs, [(f"q{k}", v.tolist()) for k, v in enumerate(q)], 10, 50, L2).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.id)
    recall = np.mean([len(found[f"q{k}"] & set(exact(x, v, 10))) / 10 for k, v in enumerate(q)])
    assert recall >= 0.90


def shells(n, dim):
    """Vectors of ten lengths: the long ones are nobody's nearest."""
    x = np.random.default_rng(3).normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1)[:, None] * (1 + np.arange(n) % 10)[:, None]).astype(np.float32)


def test_recall_over_shells():
    """Records of unlike lengths in two shards, with so few links that long ones lose theirs."""
    x = shells(1200, 64)
    graphs = [hnsw.build_graph([f"rec-{k:06d}" for k in range(s, 1200, 2)], x[s::2], L2, IndexParams(m=4)) for s in (0, 1)]
    found = [{i for _, i in sorted(r for g in graphs for r in g.search(x[k], 10, 50))[:10]} for k in range(0, 1200, 7)]
    assert np.mean([len(f & set(exact(x, x[k], 10))) / 10 for f, k in zip(found, range(0, 1200, 7), strict=True)]) >= 0.9


def test_records_are_found_from_their_own_vectors():
    x = shells(1200, 64)
    for s in (0, 1):
        g = hnsw.build_graph([f"rec-{k:06d}" for k in range(s, 1200, 2)], x[s::2], L2, IndexParams(m=6, ef_construction=32))
        assert all(g.search(x[k], 1, ef) == [(0.0, f"rec-{k:06d}")] for k in range(s, 1200, 2) for ef in (50, 200))
    copies = np.concatenate([shells(300, 16), np.repeat(shells(2, 16), 150, axis=0), np.zeros((60, 16), np.float32)])
    g = hnsw.build_graph([f"rec-{k:06d}" for k in range(len(copies))], copies, L2, IndexParams())
    assert all([i for _, i in g.search(q, 10, 50)] == exact(copies, q, 10) for q in copies)
    assert hnsw.build_graph([], np.zeros((0, 16), np.float32), L2, IndexParams()).search(x[0, :16], 1, 50) == []


def test_records_are_found_however_few_links():
    """With four links a node, the rounds that keep to that bound leave records lost; the rounds after them don't."""
    x = shells(300, 64)
    g = hnsw.build_graph([f"rec-{k:06d}" for k in range(300)], x, L2, IndexParams(m=2, ef_construction=16))
    assert all(g.search(x[k], 1, ef) == [(0.0, f"rec-{k:06d}")] for k in range(300) for ef in (50, 200))
    x[::50, 3] = np.nan
    assert len(hnsw.build_graph([f"rec-{k:06d}" for k in range(300)], x, L2, IndexParams(m=4)).ids) == 300  # ends


def test_shards_go_to_tasks_of_their_own(spark):
    graphs = hnsw.build(frame(spark, shells(300, 8)), L2, IndexParams(m=4), 3)
    assert graphs.groupBy(F.spark_partition_id()).count().count() == graphs.count() == 3


def test_graph_keeps_its_bounds():
    x = np.random.default_rng(0).normal(size=(400, 8)).astype(np.float32)
    g = hnsw.build_graph([f"r{k}" for k in range(400)], x, L2, IndexParams(m=5, ef_construction=40))
    assert g.ids == sorted(g.ids) and max(g.levels) == g.levels[g.entry]
    for node, own in enumerate(g.links):
        assert len(own) == g.levels[node] + 1
        for layer, near in enumerate(own):
            assert len(near) <= (10 if layer == 0 else 5) and len(set(near)) == len(near) and node not in near and all(g.levels[n] >= layer for n in near)
    again = hnsw.Graph.restore(g.dump())
    assert again.links == g.links and again.search(x[0], 5, 50) == g.search(x[0], 5, 50)
    levels = [hnsw.level_of(f"r{k}", 1, 16) for k in range(20_000)]
    assert sum(v > 0 for v in levels) / len(levels) == pytest.approx(1 / 16, rel=0.1)


def test_ivf_cells_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 4
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8))).astype(np.float32)
    rows = frame(spark, x).cache()
    model = ivf.train(rows, 20, 7)
    other = ivf.train(frame(spark, x, 1), 20, 7)
    assert np.allclose(model.centroids, other.centroids, rtol=1e-5) and 1 <= model.iterations <= ivf.ITERATIONS
    postings = ivf.assign(rows, model).cache()
    cells = {r.id: r.cell for r in postings.select("id", "cell").collect()}
    near = ivf.nearest_cells(x, model.assigned)
    assert all(cells[f"rec-{k:06d}"] == near[k] for k in range(len(x)))
    recall = []
    for nprobe in (1, 4, 20):
        hits = [len({r.id for r in ivf.search(postings, model, x[k], 10, nprobe, L2).collect()} & set(exact(x, x[k], 10))) for k in range(0, 1500, 150)]
        recall.append(sum(hits) / 100)
    assert recall == sorted(recall) and recall[-1] == 1.0 and recall[0] > 0.4
    batch = planner.ivf_batch(postings, model, [(f"q{k}", x[k]) for k in (3, 4)], 5, 20, L2)
    assert {q: [r.id for r in sorted(batch.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in ("q3", "q4")} == {f"q{k}": exact(x, x[k], 5) for k in (3, 4)}


@pytest.mark.parametrize(("nlist", "count", "expected"), [(0, 500, 22), (0, 1, 1), (7, 500, 7), (9, 3, 3), (0, 0, 1)])
def test_effective_nlist(nlist, count, expected):
    assert ivf.effective_nlist(nlist, count) == expected


@pytest.mark.parametrize("scale", [0.0, 1e-20, 1.0, 1e19])
def test_nearest_cells_are_exact(scale):
    rng = np.random.default_rng(6)
    x, c = (rng.integers(-2, 3, (700, 3)) * scale).astype(np.float32), (rng.integers(-2, 3, (40, 3)) * scale).astype(np.float32)
    d = np.stack([[np_l2_squared(a, b) for b in c] for a in x])
    assert ivf.nearest_cells(x, c).tolist() == d.argmin(axis=1).tolist()


def test_ties_go_to_the_lowest_cell():
    assert ivf.nearest_cells(np.zeros((1, 2), np.float32), np.array([[1, 0], [0, 1], [-1, 0]], np.float32)).tolist() == [0]


@pytest.mark.parametrize("metric", list(DistanceMetric))
def test_columns_equal_numpy(spark, metric, monkeypatch):
    import nearfield.functions.distance as module

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(500, 24)).astype(np.float32), rng.normal(size=(500, 24)).astype(np.float32)
    a[0] = 0
    a[1], b[1] = 3e38, 3e38
    df = spark.createDataFrame([(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b, strict=True))], "k int, a array<float>, b array<float>")
    got = [r.d for r in df.select("k", distance(metric, F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()]
    assert np.array_equal(np.array(got, np.float32), np_distance(metric, a, b))
    for most in (128, 8):
        monkeypatch.setattr(module, "WRITTEN_OUT", most)
        for k in (0, 1, 2):
            one = [r.d for r in df.select("k", module.distance_to(metric, F.col("a"), b[k]).alias("d")).orderBy("k").collect()]
            assert np.array_equal(np.array(one, np.float32), np_distance(metric, a, b[k]))


def test_many_queries_in_several_blocks(spark, monkeypatch):
    from nearfield.operators import knn as module

    monkeypatch.setattr(module, "BROADCAST_QUERIES", 10)
    x = np.random.default_rng(5).integers(-3, 4, (300, 4)).astype(np.float32)
    rows = frame(spark, x)
    got = {}
    for r in knn_batch(rows, rows.limit(35).withColumnRenamed("id", "query_id"), 6, L2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    assert len(got) == 35
    for q, found in got.items():
        assert [found[k] for k in range(1, 7)] == exact(x, x[int(q[4:])], 6)
    assert knn_batch(rows, rows.limit(0).withColumnRenamed("id", "query_id"), 6, L2).count() == 0


def test_concurrent_readers(spark):
    c = nf.Engine(spark).create_collection("c", 3, "l2")
    c.insert_batch([(f"r{k}", [k % 5, k % 7, k % 11]) for k in range(100)])
    c.build_index("ivf", nlist=5)
    results, failed = [], []

    def read():
        try:
            results.append(c.query([1, 2, 3], 5, nprobe=5))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=read) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and all(r == results[0] for r in results) and len(results) == 6


def test_quota(spark):
    engine = nf.Engine(spark, quota=128)
    c = engine.create_collection("c", 3, "l2")
    c.insert("a", [1, 2, 3])
    with pytest.raises(MemoryError):
        c.insert_batch([("b", [1, 2, 3]), ("c", [1, 2, 3])])
    c.insert("b", [1, 2, 3])
    with pytest.raises(nf.AllocationFailureError):
        c.insert("c", [1, 2, 3])
    assert c.count() == 2 and engine.allocation_stats() == {"c": 128}
    engine.delete_collection("c")
    assert engine.allocation_stats() == {}
    engine.create_collection("d", 3, "l2").insert("a", [1, 2, 3])


@pytest.mark.parametrize("metric", list(DistanceMetric))
@pytest.mark.parametrize("kind", ["ties", "normal", "tiny", "huge", "zero", "same"])
def test_estimates_lose_no_neighbour(metric, kind):
    from nearfield.operators.knn import _Best, near_pairs

    rng = np.random.default_rng(8)
    x = {"ties": rng.integers(-1, 2, (900, 3)), "normal": rng.normal(size=(900, 16)) + 5, "tiny": rng.normal(size=(900, 4)) * 1e-20, "huge": rng.normal(size=(900, 4)) * 1e30, "zero": rng.integers(0, 2, (900, 2)), "same": np.ones((900, 5))}[kind].astype(np.float32)
    q, k = x[:40], 7
    ids = np.array([f"r{i}" for i in range(len(x))], object)
    best = _Best(len(q), k)
    best.most = 400
    for i in range(0, len(x), 100):
        at, row, dist = near_pairs(metric, x[i : i + 100], q, k)
        best.add(at, ids[i : i + 100][row], dist)
    got = {}
    for a, i, d in zip(*best.done(), strict=True):
        got.setdefault(a, []).append((float(d), i.encode()))
    for a in range(len(q)):
        d = np_distance(metric, x, q[a])
        assert sorted(got[a]) == sorted((float(v), i.encode()) for v, i in zip(d, ids, strict=True))[:k]


def test_changes_are_built_into_the_graphs(spark, monkeypatch):
    """Few changes are ranked beside the graphs; many are built into the shards that they touch."""
    monkeypatch.setattr(planner, "MOST_CHANGED", 20)
    monkeypatch.setattr(hnsw, "SHARD", 200)
    rng = np.random.default_rng(5)
    x = {f"r{k}": rng.normal(size=8).astype(np.float32) for k in range(400)}
    c = nf.Engine(spark).create_collection("c", 8, "l2")
    c.insert_batch([(k, v) for k, v in x.items()])
    c.build_index("hnsw", m=8, ef_construction=64)
    x |= {f"s{k}": rng.normal(size=8).astype(np.float32) for k in range(10)}
    c.insert_batch([(k, v) for k, v in x.items() if k[0] == "s"])
    for q in (x["s3"], x["r7"]):
        assert c.query(q, 1, ef_search=200)[0][1] == 0.0
    assert c._changed is not None
    x |= {f"t{k}": rng.normal(size=8).astype(np.float32) for k in range(30)}
    c.insert_batch([(k, v) for k, v in x.items() if k[0] == "t"])
    c.delete("r7")
    found = c.query(x["t4"], 5, ef_search=500)
    exact = sorted(((float(np.sqrt(((v - x["t4"]) ** 2).sum())), k) for k, v in x.items() if k != "r7"))[:5]
    assert c._changed is None and [i for i, _ in found] == [k for _, k in exact]
    ids = {i for r in c._graphs.collect() for i in hnsw.Graph.restore(bytes(r["graph"])).ids}
    assert ids == set(x) - {"r7"}


@pytest.mark.parametrize("index", ["hnsw", "ivf"])
def test_batches_through_an_index(spark, monkeypatch, index):
    monkeypatch.setattr(planner, "QUERIES", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    c = nf.Engine(spark).create_collection("c", 6, "l2")
    c.insert_batch([(f"r{k}", v) for k, v in enumerate(x)])
    queries = spark.createDataFrame([(f"q{k}", x[k].tolist()) for k in range(20)], "query_id string, vector array<float>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
    assert rows(c.query_batch(queries, 3)) == rows(c.query_batch(queries, 3, exact=False))
    c.build_index(index)
    assert rows(c.query_batch(queries, 3)) == rows(c.query_batch(queries, 3, exact=False, nprobe=1000, ef_search=300))
    assert c.query_batch(queries, 300, exact=False).count() == 20 * 300


def test_many_centroids_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(ivf, "MOST_BYTES", 1000)
    rows = spark.createDataFrame([(f"r{k}", [float(k)] * 8) for k in range(100)], "id string, vector array<float>")
    monkeypatch.setattr(ivf, "initial_centroids", lambda *a: pytest.fail("collected"))
    with pytest.raises(MemoryError):
        ivf.train(rows, 100, 1)


def test_recall_of_a_loaded_union_of_graphs(spark, tmp_path, monkeypatch):
    """Shards that are joined in one file still find nine tenths of the nearest."""
    monkeypatch.setattr(hnsw, "SHARD", 300)
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (1200, 16)).astype(np.float32)
    engine = nf.Engine(spark)
    c = engine.create_collection("c", 16, "l2")
    c.insert_batch([(f"r{k:04d}", v) for k, v in enumerate(x)])
    c.build_index("hnsw")
    engine.save("c", str(tmp_path / "c.snap"))
    loaded = nf.Engine(spark).load(str(tmp_path / "c.snap"))
    graphs = [hnsw.Graph.restore(bytes(r["graph"])) for r in loaded._graphs.collect()]
    hits = 0
    for q in rng.uniform(-1, 1, (50, 16)).astype(np.float32):
        exact = {f"r{k:04d}" for k in np.argsort(((x - q) ** 2).sum(axis=1))[:10]}
        hits += len(exact & {i for _, i in sorted(r for g in graphs for r in g.search(q, 10, 100))[:10]})
    assert len(graphs) == 1 and hits / 500 >= 0.9
