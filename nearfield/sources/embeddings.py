"""Records from a Parquet table of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def record_id(number: Column | str) -> Column:
    return F.concat(F.lit("rec-"), F.lpad(F.col(number).cast("string") if isinstance(number, str) else number, 6, "0"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, vector, label`` of the table ``embeddings``."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return table.select(record_id("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), "label", "vec_id")
