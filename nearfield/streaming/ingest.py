"""Continuous ingest of a stream of records into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, order: str | None = None, **trigger) -> StreamingQuery:
    """Upsert each micro-batch of ``stream(id, vector, meta?)`` into ``collection``.

    A batch is stored whole or not at all, and a batch that is delivered again overwrites its own
    rows, so the table is the same as if each came once.
    """

    def store(batch: DataFrame, _epoch: int) -> None:
        if not batch.isEmpty():
            collection.insert_dataframe(batch, order)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
