"""A stream of documents into an index, one atomic write per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from lexquarry.api import SearchIndex


def upsert_stream(
    index: SearchIndex, documents: DataFrame, checkpoint: str, trigger: dict | None = None, most_segments: int = 16
) -> StreamingQuery:
    """Starts a query that upserts every micro-batch of ``documents`` (``id`` and text columns) into the index.

    A batch that is run again after a failure writes the same documents again, so the result is the same. Each batch adds a segment;
    when there are more than ``most_segments`` they are merged, so reads stay short and an index of n batches is rewritten n / ``most_segments`` times at most.
    """

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.upsert_many(batch)
            if index.segments > most_segments:
                index.optimize()

    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
