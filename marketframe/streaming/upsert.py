"""Continuous refresh: each micro-batch of landed rows is an upsert by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marketframe.operators.relational import last_by_key
from marketframe.sources.snapshots import Manifest, Table


def stream_upsert(landed: DataFrame, table: Table, checkpoint: str, *, order: list[str], conflict: str = "replace", once: bool = True) -> StreamingQuery:
    """Upsert a stream of rows into a keyed table, each batch exactly once.

    A late row is a replacement like any other, so no watermark is needed.  Within a batch the row with the largest ``order`` stands
    for its key.  The commit of a batch names the checkpoint and the batch's number, so one that is delivered again after a failure is passed over:
    appends ('error') and 'ignore' are safe too.  ``once``: stop when all there is has been read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        latest = last_by_key(batch, list(table.spec.key), order).select(table.spec.columns)
        table.upsert(latest, conflict, batch=(checkpoint, number))
        Manifest(table.spark, table.root).update(table)

    writer = landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
