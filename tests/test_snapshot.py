import struct
from functools import reduce

import numpy as np
import pytest

import nearfield as nf
from nearfield.sources.crc64 import POLYNOMIAL, crc64
from nearfield.types import IndexType


def slow_crc(data):
    def byte(crc, b):
        crc ^= b << 56
        for _ in range(8):
            crc = ((crc << 1) ^ (POLYNOMIAL if crc >> 63 else 0)) & (1 << 64) - 1
        return crc

    return reduce(byte, data, 0)


def test_crc():
    assert crc64(b"123456789") == 0x6C40DF5F0B497347
    data = np.random.default_rng(0).integers(0, 256, 300_007, np.uint8).tobytes()
    assert crc64(data) == slow_crc(data) == crc64(data[1000:], crc64(data[:1000]))


def filled(engine, name="c", n=40):
    c = engine.create_collection(name, 5, "cosine")
    values = np.random.default_rng(17).normal(0, 20, (n, 5)).round(2).tolist()
    c.insert_batch([(f"r{i}", values[i], {"place": i, "label": f"no. {i}", "half": i / 2, "even": i % 2 == 0} if i % 3 else None) for i in range(n)])
    c.insert("empty", [1, 2, 3, 4, 5], {})
    return c


@pytest.mark.parametrize("index", [None, "hnsw", "ivf"])
def test_round_trip(spark, tmp_path, index):
    engine = nf.Engine(spark)
    c = filled(engine)
    if index:
        c.build_index(index)
    file = str(tmp_path / "c.snap")
    engine.save("c", file)
    other = nf.Engine(spark)
    d = other.load(file)
    assert d.count() == 41 and d.index_type() is c.index_type() and d.params == c.params
    for i in ("r0", "r1", "r20", "empty"):
        assert d.get(i) == c.get(i)
    assert d.query([1, 2, 3, 4, 5], 5, nprobe=100, ef_search=100) == c.query([1, 2, 3, 4, 5], 5, nprobe=100, ef_search=100)
    other.save("c", str(tmp_path / "again.snap"))
    assert (tmp_path / "c.snap").read_bytes() == (tmp_path / "again.snap").read_bytes()
    with pytest.raises(nf.NameConflictError):
        other.load(file)
    engine.save_table("c", str(tmp_path / "table"))
    engine.save_table("c", str(tmp_path / "table"))
    t = nf.Engine(spark).load_table(str(tmp_path / "table"))
    assert t.count() == 41 and t.get("r1") == c.get("r1") and t.index_type() is c.index_type()
    assert t.query([1, 2, 3, 4, 5], 5, nprobe=100, ef_search=100) == c.query([1, 2, 3, 4, 5], 5, nprobe=100, ef_search=100)


def test_reading_in_parts(spark, tmp_path):
    from nearfield.sources import snapshot

    engine = nf.Engine(spark)
    c = filled(engine, n=50)
    engine.save("c", str(tmp_path / "c"))
    spark.dataSource.register(snapshot.SnapshotSource)
    df = spark.read.format("nearfield_snapshot").option("records", 7).load(str(tmp_path / "c"))
    assert df.rdd.getNumPartitions() == 8 and df.schema == c.table().schema
    rows = lambda t: sorted((r.id, tuple(r.vector), r.meta and sorted(r.meta.items())) for r in t.collect())
    assert rows(df) == rows(c.table())


def test_empty_collection_and_layout(spark, tmp_path):
    engine = nf.Engine(spark)
    engine.create_collection("naïve", 7, "l2")
    engine.save("naïve", str(tmp_path / "e"))
    raw = (tmp_path / "e").read_bytes()
    assert len(raw) == 128 and raw[76:82] == "naïve".encode() and struct.unpack("<I", raw[8:12]) == (1,) and crc64(raw[76:]) == struct.unpack("<Q", raw[68:76])[0]
    assert nf.Engine(spark).load(str(tmp_path / "e")).count() == 0


def test_damage(spark, tmp_path):
    engine = nf.Engine(spark)
    filled(engine).build_index("hnsw", m=4)
    file = tmp_path / "c"
    engine.save("c", str(file))
    raw = file.read_bytes()

    def loading(data):
        (tmp_path / "bad").write_bytes(data)
        return nf.Engine(spark).load(str(tmp_path / "bad"))

    with pytest.raises(FileNotFoundError):
        nf.Engine(spark).load(str(tmp_path / "none"))
    for data in (b"", raw[:75], b"X" + raw[1:]):
        with pytest.raises(nf.SnapshotNotFoundError):
            loading(data)
    with pytest.raises(nf.UnsupportedVersionError):
        loading(raw[:8] + b"\2" + raw[9:])
    for at in (80, 200, len(raw) - 1):
        with pytest.raises(nf.CorruptionError):
            loading(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    for at, value in ((16, b"\0\0\0\0"), (20, b"\7"), (21, b"\7"), (24, b"\1"), (32, b"\0"), (36, b"\0")):
        with pytest.raises(nf.CorruptionError):
            loading(raw[:at] + value + raw[at + len(value) :])
    with pytest.raises(nf.CorruptionError):
        loading(raw[:-3])
    with pytest.raises(OSError):
        engine.save("c", str(tmp_path / "no" / "folder"))
    assert file.read_bytes() == raw and IndexType.HNSW is engine.get_collection("c").index_type()
    engine.save_table("c", str(tmp_path / "t"))
    manifest = tmp_path / "t" / "MANIFEST"
    manifest.write_text(manifest.read_text().replace('"dim": 5', '"dim": 6'))
    for crc in tmp_path.glob("t/.MANIFEST.crc"):
        crc.unlink()
    with pytest.raises(nf.CorruptionError):
        nf.Engine(spark).load_table(str(tmp_path / "t"))
    with pytest.raises(nf.SnapshotNotFoundError):
        nf.Engine(spark).load_table(str(tmp_path / "t2"))
