"""A stream of lookups upserted into a table, and windowed counts of events with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomset.operators.cache import upserted
from loomset.sources.sinks import upsert_buckets


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "id", at: str = "fetched_at", buckets: int = 256) -> StreamingQuery:
    """Keep the table at path (see sinks.read_table) at the latest row of each key; a batch rewrites its keys' buckets alone.

    A batch that runs again changes nothing. With keys as many as buckets in a batch, most of the table is rewritten, so
    the number of buckets should grow with the table.
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert_buckets(batch, path, key, lambda old, new: upserted(old, new, key, at), buckets)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, n, total) by tumbling window of event time; rows later than `late` are dropped from a stream."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
