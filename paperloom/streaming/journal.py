"""Streams over the journal and into the store."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


def counts_by_action(events: DataFrame, ts: str = "ts", action: str = "action", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each action in each window; a window closes ``late`` after its end."""
    windowed = events.withWatermark(ts, late) if events.isStreaming else events
    return windowed.groupBy(F.window(ts, width).alias("w"), F.col(action).alias("action")).agg(F.count("*").alias("n")).select("action", F.col("w.start").alias("start"), "n")


def upsert_stream(chunks: DataFrame, store: Store, checkpoint: str):
    """Start upserting a stream of chunk rows.

    The pointer keeps the last batch of each stream, which its checkpoint names.  A batch
    that is replayed after a crash is known by its number and has its effect once; a new
    stream counts from its own beginning.
    """
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        done = store.metadata().get("streams", {})
        if done.get(stream, -1) < number:
            store.upsert(batch, f"RUN-{stream}-{number}", streams=done | {stream: number})

    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
