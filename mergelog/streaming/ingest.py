"""Structured Streaming into a store: each micro-batch is one committed batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from mergelog.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order_col: str = "seq", compact: bool = True, available_now: bool = False) -> StreamingQuery:
    """Rows (key, value, tag, <order_col>) go to the store. Arrival order is recency, so there is no watermark.

    The manifest keeps the number of the last applied micro-batch in the commit that made
    it visible, so a batch that is run again after a failure is skipped.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number <= store.manifest.stream_batch:
            return
        store.apply(batch.select("key", "value", "tag", order_col), order_col, stream_batch=number)
        if compact:
            store.compact()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
