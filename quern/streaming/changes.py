"""Structured Streaming forms of the change queue and of last-event-wins.

The queue lives in a versioned table: every micro-batch coalesces its events, merges
them into the version before and commits the next. The batch id is a key of the same
commit, so a batch that runs again after a failure changes nothing, whatever else is
committed under that root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.changes import coalesce_queue
from quern.operators.versions import Versions

QUEUE = "note_id bigint, reasons int, sequence bigint, queued_at double, attempts int"
LEAST_DELAY, MOST_DELAY, DELAY = 0.25, 10.0, 1.2


def debounce(seconds: float | None = None) -> dict[str, str]:
    """A trigger for batches of changes: 1.2 seconds, within a quarter and ten."""
    delay = min(MOST_DELAY, max(LEAST_DELAY, DELAY if seconds is None else float(seconds)))
    return {"processingTime": f"{int(delay * 1000)} milliseconds"}


def queue_stream(events: DataFrame, versions: Versions, checkpoint: str, stream: str = "queue", **trigger) -> StreamingQuery:
    """Merge a stream of ``(note_id, reasons, sequence, queued_at)`` into a versioned queue.

    ``stream`` names this stream's batch ids; a new checkpoint folder needs a new name.
    """
    key = f"batch:{stream}"

    def merge(batch: DataFrame, batch_id: int) -> None:
        if versions.key(key, -1) >= batch_id:
            return
        before = versions.read("queue") if versions.has("queue") else None
        versions.publish({"queue": coalesce_queue(batch, before)}, keys={key: batch_id})

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_state(events: DataFrame) -> DataFrame:
    """A stream of each note's latest sequence and united reasons, as a running aggregate.

    Late events only add their reasons. With a watermark on a column ``ts``, aggregate by
    window as well to let state expire.
    """
    return events.groupBy("note_id").agg(F.max("sequence").alias("sequence"), F.bit_or("reasons").alias("reasons"))


def windowed_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of each type by window of their time; windows are final once the watermark passes them."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("span"), "event_type").agg(F.count("*").alias("events")).select("span.start", "span.end", "event_type", "events")


def late_guard(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with a watermark on their time, repeated event ids dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]).withColumn("day", F.to_date("ts"))
