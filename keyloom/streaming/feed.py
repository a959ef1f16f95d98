"""Structured Streaming over a store: a feed of its versions, and streams applied as keyed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.model import Keyspace
from ..sources.store import Store


def feed(store: Store, space: str | None = None) -> DataFrame:
    """A stream of published versions, of one keyspace's changes if it is named."""
    changes = store.changes()
    return changes if space is None else changes.where(F.array_contains("changed", F.lit(space)))


def apply_stream(store: Store, space: Keyspace, rows: DataFrame, checkpoint: str, sequence: str | None = None) -> StreamingQuery:
    """Upsert a stream's rows: one published version for each micro-batch that has any. A batch that is run again gives the same rows."""

    def work(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.update(lambda tx: tx.put(space, batch, sequence))

    return rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
