"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.sizes import BROADCAST_BYTES, broadcast_if_small, table_bytes
from nearfield.sources.shared import Scratch, shared_dir

__all__ = ["BROADCAST_BYTES", "Scratch", "bound_batches", "broadcast_if_small", "documents", "null_safe_join", "shared_dir", "spread", "table_bytes", "text_or_empty"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly where it has fewer splits than there are cores, which only small inputs have."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, of which nulls equal each other; the keys of ``left`` stay."""
    for k in keys:
        right = right.withColumnRenamed(k, f"__right_{k}")
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(right, test, how).drop(*[f"__right_{k}" for k in keys])


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most ``rows`` whole texts travel to a Python worker in one batch; the session's default of 10,000 takes hundreds of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))
