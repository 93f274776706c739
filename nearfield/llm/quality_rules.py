"""Quality rules by cross-document line frequency.

Normalised lines are hashed together with their host. A line that more distinct documents of its
host hold than the limit is removed, and a document that loses too many of its words is rejected, as is
one that fails the plain rules on its own words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, bound_batches, broadcast_if_small, documents

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: A line that more distinct documents of its host hold is removed. The limit doesn't grow with the host: the larger a host, the more of its boilerplate is found.
LIMIT = 10
#: A document that keeps a smaller share of its words is rejected.
LEFT = 0.5

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, sizes array<int>"


def _line_hash(host: bytes, line: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(host + b"\n" + b" ".join(line.lower().split()))


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    from xxhash import xxh64_intdigest

    if len(words) < 4:
        return 0
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    grams = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    held = np.zeros(len(words), bool)
    for k in range(3):
        held[k : k + len(grams)] |= twice
    return int(held.sum())


def _stats(text: str, host: bytes) -> tuple:
    from xxhash import xxh64_intdigest

    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    lines: dict[int, int] = {}
    repeats = 0
    for line in raw.split(b"\n"):
        if n := len(line.split()):
            repeats += line in seen
            seen.add(line)
            key = _line_hash(host, line)
            lines[key] = lines.get(key, 0) + n
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, repeats, repeated_words(words), xxh64_intdigest(raw), list(lines), list(lines.values())


def _with_stats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, host, text)`` with the counts of each text and its distinct lines with the words that they hold."""
    schema = "doc_id " + dict(docs.dtypes)["doc_id"] + ", host string, text string, " + STATS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_stats(t or "", (h or "").encode()) for t, h in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            out = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(np.array(cols[5], np.uint64).view(np.int64))]
            out += [pa.array([np.array(x, np.uint64).view(np.int64) for x in cols[6]], pa.list_(pa.int64())), pa.array(cols[7], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], ["doc_id", "host", "text", *(x.split()[0] for x in STATS.split(", "))])

    return docs.mapInArrow(run, schema)


def frequent_lines(stats: DataFrame, limit: int) -> DataFrame:
    """``line`` of all lines that more than ``limit`` distinct documents of their host hold; rows of one doc_id are one document, rows without an id one for each text.

    Each document counts a line once. The second count is summed in every task before the exchange, so the commonest line is a row a task.
    """
    each = stats.select(F.explode("lines").alias("line"), F.coalesce(F.col("doc_id").cast("long"), F.col("content")).alias("document")).distinct()
    return each.groupBy("line").count().filter(F.col("count") > limit).select("line")


def apply_rules(docs: DataFrame, host: str = "source", limit: int = LIMIT, left: float = LEFT, with_text: bool = False) -> DataFrame:
    """Count, clean and judge each row of ``docs(doc_id, text, <host>)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    removed_words, kept`` and, if asked for, ``text`` without the lines above the limit. A null text
    counts as empty and fails for want of words. A null host is a host of its own, as is an empty one
    with it. Repeated rows get the same verdict and count once in line counts; copies under different
    ids are different documents, so a text that more than ``limit`` documents of a host hold loses all
    its lines. An empty table gives no rows; other columns are ignored. Very long texts are counted
    whole, in time about linear in their length. Lines above the limit are broadcast within a checked
    size; beyond it Spark joins them by exchange and splits the commonest.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    bound_batches(spark)
    rows = _with_stats(docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")))
    rows = scratch.table(rows.select(F.monotonically_increasing_id().alias("row"), *(rows.columns if with_text else [c for c in rows.columns if c != "text"])), "stats")
    often = broadcast_if_small(scratch.table(frequent_lines(rows, limit), "frequent"))
    hits = rows.select("row", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select("row", F.col("l.lines").alias("line"), F.col("l.sizes").alias("size")).join(often, "line")
    lost = hits.groupBy("row").agg(F.sum("size").alias("removed_words"), *[F.collect_set("line").alias("gone")] * with_text)
    out = rows.join(lost, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("removed_words") >= left * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if not with_text:
        return out.select("doc_id", *counts, failed.alias("base_failed"), "removed_words", kept.alias("kept"))
    out = out.select("doc_id", *counts, failed.alias("base_failed"), "removed_words", kept.alias("kept"), "text", "host", "gone")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, host_, gone = (batch.column(k).to_pylist() for k in ("text", "host", "gone"))
            done = []
            for t, h, g in zip(text, host_, gone, strict=True):
                off = {x % (1 << 64) for x in g or ()}
                done.append(t if not off or t is None else "\n".join(x for x in t.split("\n") if _line_hash((h or "").encode(), x.encode()) not in off))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(done, pa.string())], batch.schema.names[:-3] + ["text"])

    return out.mapInArrow(clean, out.drop("host", "gone").schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all ``documents``."""
    return apply_rules(documents(spark, sf_dir))
