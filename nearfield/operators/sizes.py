"""Sizes of tables, which are checked before a broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: A table of at most so many bytes may be broadcast.
BROADCAST_BYTES = 24 << 20


def _width(value: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
            return F.coalesce(F.aggregate(value, F.lit(16), lambda n, x: (n + _width(x, kind.elementType)).cast("int")), F.lit(16))
        return 16 + 8 * F.coalesce(F.size(value), F.lit(0))
    return F.lit(8)


def table_bytes(table: DataFrame) -> int:
    """The bytes that the broadcast of a written table takes, about: those of its values, and of a hash table's entry for each row."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(48))
    return table.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written ``table``, marked for broadcast if its values take at most ``most`` bytes; otherwise Spark joins it by exchange."""
    return F.broadcast(table) if table_bytes(table) <= most else table
