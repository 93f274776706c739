"""Best-fit packing by a hierarchy of residuals.

Partitions pack locally by best fit and emit nearly full bins. Underfull bins are items of further
rounds of best fit in the nodes of a tree, until one node is left or nothing more is saved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, bound_batches, documents
from nearfield.llm.tokens import END_ID, default_tokenizer, encoder

CAPACITY = 1024
#: Underfull bins of about this many nodes meet in one node of the next round.
FAN = 16
#: A bin with at most so many tokens free is nearly full and final. The others are items of the next round.
NEARLY = 4
#: A node of the tree has about so many bins at most: a level of more underfull bins has more nodes.
NODE = 200_000
#: A task packs its pieces by itself once it holds this many, or this many bytes of their ids.
PIECES_HELD, BYTES_HELD = 100_000, 64 << 20
#: Rounds go on while the last one saved at least this share of its bins, or till one node is left.
SAVED = 0.002


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin. Lengths are 1 to ``capacity``; ties keep their order.

    Open bins lie in one stack for each free length, and a bit mask tells which stacks hold any, so an item takes constant time.
    """
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if above := mask >> n:
            room = n + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            free[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, fill long"


def _pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of each document with the bin and place that best fit gives among those that a task holds."""
    names = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, bins_before = encoder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4").tobytes()
        cols: dict[str, list] = {k: [] for k in (*names, "ids")}
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal bins_before, held
            bins, places, fills = best_fit(np.array(cols["length"], np.int64), capacity)
            for i in range(0, len(bins), 8192):
                own = bins[i : i + 8192]
                out = {k: pa.array(cols[k][i : i + 8192], t) for k, t in names.items()}
                out |= {"bin": pa.array(own + bins_before), "place": pa.array(places[i : i + 8192]), "fill": pa.array(fills[own])}
                if with_ids:
                    out["ids"] = pa.array([np.frombuffer(x, "<i4") for x in cols["ids"][i : i + 8192]], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)
            bins_before, held = bins_before + len(fills), 0
            for c in cols.values():
                c.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.encode(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[4 * a : 4 * b]
                    for name, v in zip(cols, (key, k, a, b - a, zlib.crc32(own), own if with_ids else None), strict=True):
                        cols[name].append(v)
                    held += len(own) * with_ids
                if len(cols["length"]) >= PIECES_HELD or held >= BYTES_HELD:
                    yield from packed()
        yield from packed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(pack, PIECES + ", ids array<int>" * with_ids)


def _merge(bins: DataFrame, capacity: int, nearly: int) -> DataFrame:
    """One round: the bins of each node are items; returns ``bin, parent, shift, fill, open`` for each."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ignore_index=True)
        own, shift, fills = best_fit(pdf["fill"].to_numpy(), capacity)
        first = np.zeros(len(fills), np.int64)  # a merged bin keeps the number of the least of its items
        first[own[::-1]] = pdf["bin"].to_numpy()[::-1]
        return pd.DataFrame({"bin": pdf["bin"], "parent": first[own], "shift": shift, "fill": fills[own], "open": fills[own] < capacity - nearly})

    return bins.groupBy("node").applyInPandas(merge, "bin long, parent long, shift long, fill long, open boolean")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, fan: int = FAN, nearly: int = NEARLY, node: int = NODE, with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    Each document is encoded and ended by ``end_id``; a longer one is cut so that only its first
    piece may be shorter than ``capacity``. Each partition packs its pieces by best fit, about
    ``PIECES_HELD`` at a time. Bins with at most ``nearly`` tokens free are final. The others are items
    of the next round, in which about ``fan`` partitions meet in a node, but never more than about
    ``node`` bins, dealt anew in each round. Rounds end with one node, or when one saves next to
    nothing. So no task's size grows with the input; all rows stay, in the bins that they then have.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids``.
    A null text counts as empty (the end id alone); null or repeated ids are documents like others;
    an empty table gives no rows; other columns are ignored. A very long text is encoded whole by one
    task and cut into as many pieces as it takes.
    """
    scratch = Scratch(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = scratch.table(_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    level = rows.filter((F.col("place") == 0) & (F.col("fill") < capacity - nearly)).select("bin", "fill")
    nodes, count = (rows.agg(F.max("bin")).first()[0] or 0) // (1 << 40) + 1, level.count()
    moved, k, last = None, 0, False
    while count and not last:
        nodes, k = max(-(-nodes // fan), -(-count // node)), k + 1
        dealt = level.withColumn("node", F.pmod(F.xxhash64(F.lit(k), "bin"), F.lit(nodes)))
        done = scratch.table(_merge(dealt, capacity, nearly), f"round{k}")
        step = done.select("bin", "parent", "shift")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("bin").alias("parent"), F.col("parent").alias("__to"), F.col("shift").alias("__by"))
            moved = moved.join(later, "parent", "left").select("bin", F.coalesce("__to", "parent").alias("parent"), (F.col("shift") + F.coalesce("__by", F.lit(0))).alias("shift"))
        heads = done.filter("shift = 0")
        level = heads.filter("open").select(F.col("parent").alias("bin"), "fill")
        bins, left = heads.agg(F.count("*"), F.count_if("open")).first()
        last = nodes == 1 or (left > node and count - bins < SAVED * count)
        count = left
    if moved is None:
        moved = rows.limit(0).select("bin", F.col("bin").alias("parent"), F.col("place").alias("shift"))
    found = rows.join(moved, "bin", "left")
    place = (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), place, *["ids"] * with_ids)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1,024 tokens."""
    return pack(documents(spark, sf_dir), default_tokenizer())
