"""Token-ID output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

A table of token files is a folder with, for each partition ``p`` in ascending key order,

* ``part-p.ids``: the ids of its documents one after another, as little-endian unsigned 16-bit
  integers when the vocabulary fits and 32-bit ones otherwise;
* ``part-p.off``: ``n + 1`` little-endian signed 64-bit offsets of its documents in ``part-p.ids``;
* ``part-p.key``: ``n`` little-endian signed 64-bit document ids, then ``n`` bytes, 0 where the id is null;

and ``manifest``, a Parquet table of ``part, n_docs, n_ids, first_doc, first_id, width``. The last
two bases are prefix sums over the partitions before, so a document's place in the whole output is
``first_id + offset`` and no task needs to know what others wrote.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, bound_batches, documents
from nearfield.llm.tokens import END_ID, default_tokenizer, encoder

MANIFEST = "part int, n_docs long, n_ids long, width int"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, write: Callable) -> None:
    """Write a file under a name of its own, then rename it, so that a repeated or lost task harms nothing."""
    files, base = _filesystem(uri)
    own = f"{base}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        write(out)
    files.move(own, f"{base}/{name}")


def _map(uri: str, name: str) -> memoryview:
    """A file's bytes: memory-mapped where the folder is local or mounted, read otherwise."""
    from pyarrow import fs

    files, base = _filesystem(uri)
    path = f"{base}/{name}"
    if files.get_file_info(path).size == 0:
        return memoryview(b"")
    if isinstance(files, fs.LocalFileSystem):
        return memoryview(pa.memory_map(path).read_buffer())
    with files.open_input_file(path) as f:
        return memoryview(f.readall())


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write them to the folder ``uri`` in ascending doc_id order; returns the manifest.

    A null text counts as empty and gives the end id alone. Null ids come first. Repeated ids are
    separate documents, ordered by text. An empty table gives an empty manifest. Other columns are
    ignored. Ids must fit 64 bits. Memory: a batch of texts and eight bytes a document of the partition;
    a very long text is encoded whole.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, code = TaskContext.get().partitionId(), encoder(tokenizer)
        kind = np.dtype("<u2" if code.vocabulary <= 1 << 16 and end_id < 1 << 16 else "<u4")
        end = np.array([end_id], dtype=kind).tobytes()
        offsets, keys, valid = [0], [], []

        def ids(out) -> None:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    got = np.frombuffer(code.encode(text.as_py() or ""), dtype="<u4")
                    out.write(got.astype(kind).tobytes() + end)
                    offsets.append(offsets[-1] + len(got) + 1)
                    keys.append(key or 0)
                    valid.append(key is not None)

        _put(uri, f"part-{part:06d}.ids", ids)
        if keys:
            _put(uri, f"part-{part:06d}.off", lambda out: out.write(np.array(offsets, dtype="<i8").tobytes()))
            _put(uri, f"part-{part:06d}.key", lambda out: out.write(np.array(keys, dtype="<i8").tobytes() + bytes(valid)))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_ids": pa.array([offsets[-1]], pa.int64()), "width": pa.array([kind.itemsize], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # One short row for each partition written: their number, not the data's, bounds what the driver holds.
    parts = sorted(rows.mapInArrow(write, MANIFEST).collect())
    docs_before = np.cumsum([0, *(p.n_docs for p in parts)]).tolist()
    ids_before = np.cumsum([0, *(p.n_ids for p in parts)]).tolist()
    manifest = spark.createDataFrame([(*p, d, i) for p, d, i in zip(parts, docs_before, ids_before, strict=False)], f"{MANIFEST}, first_doc long, first_id long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{uri}/manifest")


def read_token_files(spark: SparkSession, uri: str, schema: str, rows: Callable[[list, np.ndarray, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """A DataFrame of what ``rows(doc ids, starts in the whole output, local offsets, mapped ids)`` makes of each partition's files.

    ``rows`` gets at most 4,096 documents at a time; the mapped array has all ids of the partition. A folder of an empty table gives no rows.
    """
    manifest = spark.read.parquet(f"{uri}/manifest")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, first, width in zip(*(batch.column(c).to_pylist() for c in ("part", "n_docs", "first_id", "width")), strict=True):
                ids = np.frombuffer(_map(uri, f"part-{part:06d}.ids"), dtype=f"<u{width}")
                offsets = np.frombuffer(_map(uri, f"part-{part:06d}.off"), dtype="<i8")
                held = _map(uri, f"part-{part:06d}.key")
                keys, valid = np.frombuffer(held[: 8 * n], dtype="<i8"), held[8 * n :]
                for i in range(0, n, 4096):
                    some = slice(i, min(n, i + 4096))
                    own = [k if v else None for k, v in zip(keys[some].tolist(), valid[some], strict=True)]
                    yield pa.RecordBatch.from_pydict(rows(own, first + offsets[some], offsets[some.start : some.stop + 1], ids))

    parts = manifest.select("part", "n_docs", "first_id", "width")
    # A number of partitions given by hand isn't coalesced: a task for each file, however short the manifest.
    return parts.repartitionByRange(max(1, parts.count()), "part").mapInArrow(read, schema)


def _texts_of_ids(keys: list, starts: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> dict:
    cut = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(ids[offsets[0] : offsets[-1]].astype("<i4")))
    return {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts), "ids": cut}


def token_rows(spark: SparkSession, uri: str) -> DataFrame:
    """``doc_id, start, ids`` of all documents of a folder of token files."""
    return read_token_files(spark, uri, "doc_id long, start long, ids array<int>", _texts_of_ids)


def _digests(keys: list, starts: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> dict:
    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return {"doc_id": pa.array(keys, pa.int64()), "start": pa.array(starts), "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array(crc, pa.int64())}


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    uri = Scratch(spark).folder("token_files")
    write_token_files(documents(spark, sf_dir), uri, default_tokenizer())
    return read_token_files(spark, uri, "doc_id long, start long, n_tokens long, ids_crc32 long", _digests)
