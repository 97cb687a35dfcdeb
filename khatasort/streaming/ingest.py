"""Statement rows as a stream: an extension of the idempotent import.

Each micro-batch is imported like a file; rows whose transaction_id came within the watermark are dropped before, and the
store's anti-join drops those that came at any time, so a batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.learning import Store


def deduplicated(stream: DataFrame, delay: str = "1 day", time: str = "occurred_at") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["transaction_id"])


def ingest(stream: DataFrame, store: Store, checkpoint: str, **layers):
    """Start importing a stream of parsed statement rows into the store."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            store.import_transactions(rows, **layers)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
