"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets all rows that the stage before kept. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.common import Scratch, bound_batches, broadcast_if_small, documents, null_safe_join, spread
from nearfield.llm.mixing import mix
from nearfield.llm.ngram_join import ngram_join
from nearfield.llm.packing import pack
from nearfield.llm.quality_model import labels_table, resample
from nearfield.llm.secret_scan import redact
from nearfield.llm.tokens import default_tokenizer, token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts have no words and go; equal rows stay or go together; very long texts count
    whole. An empty table gives an empty one. Other columns than those of ``documents`` are left out.
    """
    return resample(spread(docs.select(*COLUMNS)), labels_table(spark, sf_dir))[0]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word n-grams at 0.8 or more the document with the least id stays; equal rows stay once.

    Null and empty texts are linked with nothing and stay; rows without ids stay. An empty table gives
    an empty one. What goes is a table of ids, broadcast within a checked size; beyond it, texts meet it by exchange.
    """
    docs, scratch = spread(docs.select(*COLUMNS)), Scratch(spark)
    found = ngram_join(docs, words=5, percent=80)
    rows = scratch.table(found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first"), F.count("*").alias("n")), "rows")
    gone = broadcast_if_small(scratch.table(rows.filter("not first").select("doc_id"), "gone"))
    left = null_safe_join(docs, gone, ["doc_id"], "left_anti")
    several = scratch.table(rows.filter("first and n > 1").select("doc_id"), "several")
    scratch.drop("rows")
    if not several.limit(1).count():
        return left
    single, repeated = (null_safe_join(left, broadcast_if_small(several), ["doc_id"], how) for how in ("left_anti", "left_semi"))
    return single.unionByName(repeated.dropDuplicates())


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blotted out of the texts; ``n_chars`` follows.

    All rows stay, repeated ones too. A null text stays null, and so does its ``n_chars``. An empty table
    gives an empty one.
    """
    return redact(spread(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to the target weights, in tokens of the tokenizer that packs; a document taken in several epochs comes as often.

    Null languages and sources are leaves of their own; null and empty texts cost the end id; equal
    rows are taken together. An empty table gives an empty one.
    """
    bound_batches(spark)
    return mix(spread(docs.select(*COLUMNS)), tokens=token_counts(default_tokenizer()))[0].select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences.

    A null or empty text is a piece of the end id alone; repeated rows are packed as often; very long
    texts are cut into pieces. An empty table gives no rows.
    """
    return pack(spread(docs), default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: Tokenising and seeded sampling are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written before the next reads it."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{k}")
            scratch.drop(f"stage{k - 1}")
            scratch.release()
    return docs
