"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are fitted: one of texts of the target quality, one of the
raw corpus. A document's logarithmic importance weight is the sum over its n-grams of the log ratio of
the two models, and Gumbel top-k draws ``k`` documents without replacement, in proportion to their weights.

N-grams are words, runs of marks, and pairs of neighbours of these, hashed to ``BUCKETS`` for each
length. Letters are lower-cased.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import BROADCAST_BYTES, Scratch, bound_batches, documents, null_safe_join, table_bytes
from nearfield.llm.recent import forget

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
#: About this many labelled documents at most are the target's sample.
LABELLED = 20_000
#: Counts that both models add to each bucket, at the size of the target's sample; they leave rare n-grams neutral.
PRIOR = 20.0
SEED = 5


def features(text: str | None) -> np.ndarray:
    """Buckets of the words and marks of a whole text, then those of their pairs, which follow the first ``BUCKETS``."""
    from xxhash import xxh32_intdigest

    tokens = TOKEN.findall(text.lower()) if text else ()
    one = np.fromiter(map(xxh32_intdigest, tokens), np.int64, len(tokens))
    two = (one[:-1] * 0x9E3779B1 + one[1:] * 0x85EBCA77) >> 12
    return np.concatenate([one & (BUCKETS - 1), (two & (BUCKETS - 1)) + BUCKETS])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    total = np.zeros((2, 2 * BUCKETS), np.int64)
    for batch in batches:
        for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = features(text.as_py())
            for k in (0, 1) if target == 1 else (0,):
                np.add.at(total[k], own, 1)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_pydict({"feature": pa.array(at, pa.int64()), "raw": pa.array(total[0][at]), "target": pa.array(total[1][at])})


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of the target model over the raw model for each bucket, from the counts of both; 0 throughout without a target.

    The raw counts are scaled to the target's total for each length of n-gram, and both get ``PRIOR``.
    """
    out = np.zeros(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        if target[part].sum():
            out[part] = np.log((target[part] + PRIOR) / (raw[part] * (target[part].sum() / raw[part].sum()) + PRIOR))
    return out


def _each_label(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> np.ndarray:
    """The log ratio by bucket. The raw model counts all of ``docs(doc_id, text)``; the target's sample is those of them whose ``labels(doc_id, quality)`` say 1, about ``labelled`` at most, chosen by a hash of the id."""
    each = _each_label(labels)
    share = min(1.0, labelled / max(1, each.count()))
    chosen = each.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    marked = docs.join(F.broadcast(chosen), "doc_id", "left").select("text", "quality")
    counted = marked.mapInArrow(_counts, "feature long, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = counted.toArrow()  # a row for each bucket at most, whatever the input
    n = np.zeros((2, 2 * BUCKETS))
    at = got.column("feature").to_numpy()
    n[0][at], n[1][at] = got.column("raw").to_numpy(), got.column("target").to_numpy()
    return log_ratio(*n)


def _scorer(spark: SparkSession, ratio: np.ndarray):
    """A function of a text column: the logarithmic weight, null for texts without words or marks."""
    sent = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        ratio = sent.value
        return pd.Series([float(ratio[own].sum()) if len(own) else None for own in map(features, texts)], dtype="float64")

    # A deterministic function would be computed once for a filter and once more for the columns above it.
    return score.asNondeterministic()


def kth_largest(values: DataFrame, column: str, k: int, last: int = 10_000) -> float:
    """The exact ``k``-th largest value (from 1) by ever finer histograms of 1,000 bins, then a sort of ``last`` rows at most (or of equal values)."""
    values = values.select(F.col(column).alias("v")).filter("v is not null")
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    while n > last and lo < hi:
        width = (hi - lo) / 1000
        if lo + width <= lo:
            break
        inside = values.filter(F.col("v").between(lo, hi))
        bins = inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(999)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy(F.desc("b")).collect()
        for b in bins:
            if k <= b["n"]:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            k -= b["n"]
    if lo == hi or n > last:
        return float(lo)
    return float(values.filter(F.col("v").between(lo, hi)).orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0])


def gumbel(seed: int, *of: Column | str) -> Column:
    """A draw from the standard Gumbel law, by a hash of the columns ``of``."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def top_k_floor(keys: DataFrame, k: int) -> float:
    """The least of the ``k`` largest of ``keys(key)``; infinite where none, or all, are to be drawn."""
    if k <= 0:
        return math.inf
    return kth_largest(keys, "key", k) if k < keys.filter("key is not null").count() else -math.inf


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, labelled: int = LABELLED) -> tuple[DataFrame, DataFrame]:
    """Draw ``k`` of ``docs(doc_id, text, ...)`` by Gumbel top-k on their importance weights.

    The logarithmic weight of a document is the sum over its n-grams of the log ratio of the models.
    Its key is the weight plus a draw from the standard Gumbel law, and the ``k`` greatest keys are drawn:
    a sample without replacement in which a document that is e times as likely is drawn e times as soon.
    Without ``k``, as many are drawn as labels lead to expect of good documents: their share among the
    labelled, of all documents with words. Returns the drawn rows with all their columns, and
    ``doc_id, log_weight, key, kept`` of every row.

    Texts without words or marks, null ones too, have no weight and are never drawn. Rows that tie at
    the last place, such as exact repeats of a row, are all drawn. Null ids have no label. Without any label all rows
    with words are drawn; without a good one all weights are 0. An empty table gives empty results;
    columns of any names stay as they are. Every word of a very long text counts, in time linear in their number.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    score = _scorer(spark, fit(plain, labels, labelled))
    scored = plain.select("doc_id", F.xxhash64("text").alias("hash"), score("text").alias("log_weight"))
    scratch = Scratch(spark)
    scores = scratch.table(scored.withColumn("key", F.col("log_weight") + gumbel(seed, "doc_id", "hash")), "scores")
    if k is None:
        n, good = _each_label(labels).agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
        words = scores.filter("log_weight is not null").count()
        k = round(words * good / n) if n else words
    floor = top_k_floor(scores.select("key"), k)
    kept = F.coalesce(F.col("key") >= floor, F.lit(False))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    out = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    gone = scratch.table(scores.filter(~kept).select("doc_id", "hash").distinct(), "gone")
    if table_bytes(gone) <= BROADCAST_BYTES:
        left = null_safe_join(rows.withColumn("hash", F.xxhash64("text")), F.broadcast(gone), ["doc_id", "hash"], "left_anti")
    else:  # texts are scored again rather than exchanged
        left = rows.withColumn("key", score("text") + gumbel(seed, "doc_id", F.xxhash64("text"))).filter(kept)
    return left.select(*out), scores.select("doc_id", "log_weight", "key", kept.alias("kept"))


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all ``documents``, and which of them the draw keeps."""
    return resample(documents(spark, sf_dir), labels_table(spark, sf_dir))[1]
