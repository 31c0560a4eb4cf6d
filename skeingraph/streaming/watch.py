"""Incremental updates driven by a stream of file events (any source with a column file_path)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeingraph.plans.service import Service
from skeingraph.sources.languages import language_column


def update_on_events(events: DataFrame, service: Service, checkpoint: str, done: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Runs an incremental update for each micro-batch that names a source file. An update looks at
    the tree itself, so a batch that is replayed after a failure changes nothing twice."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.where(language_column(F.col("file_path")).isNotNull()).isEmpty():
            result = service.update()
            if done:
                done(number, result)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
