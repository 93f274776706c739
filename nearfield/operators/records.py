"""Record store operators on DataFrames of ``id, vector, meta``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import DimensionMismatchError, InvalidIdentifierError, InvalidValueError
from nearfield.functions.distance import first_non_finite

#: Codes of the first rule that a record breaks.
VALID, BAD_ID, BAD_LENGTH, BAD_VALUE = 0, 1, 2, 3


def validation_code(dim: int) -> Column:
    """Identifier, then length, then components; a null vector has no length, a null component no value."""
    return (
        F.when(F.coalesce(F.length("id"), F.lit(0)) == 0, BAD_ID)
        .when(F.coalesce(F.size("vector"), F.lit(-1)) != dim, BAD_LENGTH)
        .when(first_non_finite(F.col("vector")) >= 0, BAD_VALUE)
        .otherwise(VALID)
    )


def validate(records: DataFrame, dim: int) -> DataFrame:
    """``records`` with ``code``, 0 for valid ones."""
    return records.withColumn("code", validation_code(dim))


def first_invalid(records: DataFrame, dim: int, order: str) -> tuple | None:
    """``order, id, code`` of the first invalid record, or None; one row comes to the driver."""
    bad = validate(records, dim).filter(F.col("code") != VALID)
    row = bad.agg(F.min_by(F.struct(order, "id", "code"), order).alias("first")).first()
    return tuple(row["first"]) if row and row["first"] else None


def raise_invalid(code: int, record_id: str | None, dim: int, where: str = "") -> None:
    if code == BAD_ID:
        raise InvalidIdentifierError(f"record identifier must not be empty{where}")
    if code == BAD_LENGTH:
        raise DimensionMismatchError(f"record '{record_id}' does not have {dim} components{where}")
    if code == BAD_VALUE:
        raise InvalidValueError(f"record '{record_id}' has a component that is not finite{where}")


def last_writer(writes: DataFrame, order: str) -> DataFrame:
    """Of the writes to each id the one that comes last."""
    latest = Window.partitionBy("id").orderBy(F.col(order).desc())
    return writes.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def upsert(base: DataFrame, writes: DataFrame, order: str) -> DataFrame:
    """``base`` with the last write to each id in place of what it had, vector and metadata both."""
    new = last_writer(writes, order).select(*base.columns)
    return base.join(new.select("id"), "id", "left_anti").unionByName(new)


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id"), "id", "left_anti")


def missing(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ``ids`` that ``base`` lacks."""
    return ids.select("id").join(base.select("id"), "id", "left_anti")


def get(base: DataFrame, record_id: str) -> DataFrame:
    return base.filter(F.col("id") == record_id)


def storage(base: DataFrame) -> DataFrame:
    """``records, blocks, bytes`` of a collection: vectors lie in blocks of whole 64 bytes."""
    size = (F.floor((F.size("vector") * 4 + 63) / 64) * 64).cast("long")
    return base.agg(F.count("*").alias("records"), F.count("*").alias("blocks"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
