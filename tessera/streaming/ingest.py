"""A stream of rows appended to a table, one transaction a micro-batch.

The manifest that commits a batch's rows also names the batch, so a batch that
is delivered again after a failure adds nothing.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..sources.database import Database


def append_batch(database: Database, table: Any, stream: str, batch: DataFrame, number: int) -> bool:
    """Insert a batch unless ``stream`` has committed it; whether it was inserted."""

    def run(txn):
        done = txn.manifest.get("streams", {})
        if done.get(stream, -1) >= number:
            return False
        txn.insert_many(table, batch)
        txn.manifest = txn.manifest | {"streams": {**done, stream: number}}
        return True

    return database.transaction_mut(run)


def ingest(source: DataFrame, database: Database, table: Any, name: str, checkpoint: str, **trigger: Any):
    """Start appending a streaming DataFrame with the table's columns; unique keys are checked batch by batch."""
    writer = source.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, number: append_batch(database, table, name, batch, number)).start()
