"""Snapshots of collections of any size: Parquet folders with a manifest that is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.collection import Collection
from nearfield.errors import CorruptionError, SnapshotNotFoundError, UnsupportedVersionError, WriteFailureError
from nearfield.operators.hnsw import GRAPHS
from nearfield.types import RECORD, DistanceMetric, IndexParams, IndexType

VERSION = 1


def _fs(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def digest(table: DataFrame) -> tuple[int, str]:
    """Count, and a checksum of all rows in which their order doesn't matter."""
    cells = F.array_sort(F.map_entries("meta")) if "meta" in table.columns else F.lit("")
    row = F.xxhash64("id", "vector", cells) if "id" in table.columns else F.xxhash64(*table.columns)
    n, total = table.agg(F.count("*"), F.sum(row.cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def save_table(coll: Collection, uri: str) -> None:
    """Write records and graphs to new folders under ``uri``, then point the manifest at them by a rename.

    Readers see the old snapshot or the new one; a failure leaves the old one.
    """
    spark, version = coll.spark, uuid.uuid4().hex[:12]
    try:
        table = coll.table()
        table.write.parquet(f"{uri}/records-{version}")
        n, check = digest(table)
        graphs = None
        if coll.index_type() is IndexType.HNSW:
            coll._graphs.write.parquet(f"{uri}/graphs-{version}")
            graphs = digest(coll._graphs)[1]
        changed = None
        if coll._changed is not None:
            coll._changed.write.parquet(f"{uri}/changed-{version}")
            changed = True
        p = coll.params
        manifest = {
            "version": VERSION, "name": coll.name, "dim": coll.dimensionality, "metric": coll.metric.name, "index": coll.index_type().name, "records": f"records-{version}", "count": n, "check": check,
            "m": p.m, "ef_construction": p.ef_construction, "nlist": p.nlist, "seed": p.seed, "graphs": graphs and f"graphs-{version}", "graphs_check": graphs, "changed": changed and f"changed-{version}",
        }
        text = json.dumps({"manifest": manifest, "crc": _crc(manifest)})
        own, fs = _fs(spark, f"{uri}/.manifest-{version}")
        out = fs.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = _fs(spark, f"{uri}/MANIFEST")
        context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(own, target, options)
    except Exception as e:
        raise WriteFailureError(f"cannot write '{uri}': {e}") from e


def _crc(manifest: dict) -> int:
    from nearfield.sources.crc64 import crc64

    return crc64(json.dumps(manifest, sort_keys=True).encode())


def load_table(spark: SparkSession, uri: str) -> Collection:
    path, fs = _fs(spark, f"{uri}/MANIFEST")
    if not fs.exists(path):
        raise SnapshotNotFoundError(f"'{uri}' has no manifest")
    stream = fs.open(path)
    text = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    try:
        held = json.loads(text)
        m = held["manifest"]
    except (ValueError, KeyError, TypeError) as e:
        raise CorruptionError("the manifest cannot be read") from e
    if m.get("version") != VERSION:
        raise UnsupportedVersionError(f"snapshot version {m.get('version')} is not {VERSION}")
    if held.get("crc") != _crc(m):
        raise CorruptionError("the manifest's checksum does not match")
    table = spark.read.schema(RECORD).parquet(f"{uri}/{m['records']}")
    if digest(table) != (m["count"], m["check"]):
        raise CorruptionError("the records' checksum does not match")
    coll = Collection(spark, m["name"], m["dim"], DistanceMetric[m["metric"]])
    coll._base, coll._known = table, m["count"]
    coll._kind, coll.params = IndexType[m["index"]], IndexParams(m["m"], m["ef_construction"], m["nlist"], m["seed"])
    if m["graphs"]:
        coll._graphs = spark.read.schema(GRAPHS).parquet(f"{uri}/{m['graphs']}")
        if digest(coll._graphs)[1] != m["graphs_check"]:
            raise CorruptionError("the graphs' checksum does not match")
    if m["changed"]:
        coll._changed = spark.read.schema("id string").parquet(f"{uri}/{m['changed']}")
    return coll
