"""Structured Streaming into a table: each micro-batch is embedded, filed into indexes and committed once."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    from ..session import Session


def stream_into(session: Session, table: str, stream: DataFrame, checkpoint: str, name: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that appends ``stream`` to ``table``.

    The manifest keeps the last batch of each query name, written in the same commit as the batch's rows,
    so a batch that is replayed after a failure is not added twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        with session.transaction():
            entry = session.catalog.entry(table)
            if entry.setdefault("streams", {}).get(name, -1) >= number:
                return
            session.insert(table, rows)
            entry["streams"][name] = number
            session.catalog.touched.add(table.lower())

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
