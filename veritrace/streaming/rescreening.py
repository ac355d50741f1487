"""Structured Streaming around rescreening. The change is static and small; the book or the versions stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrace.operators.changes import snapshot_diff
from veritrace.operators.rescreen import Rescreen
from veritrace.operators.snapshots import Snapshot, Store


def alerts_to(book: DataFrame, rescreen: Rescreen, path: str, checkpoint: str) -> StreamingQuery:
    """Screens each arriving part of a book against the change and appends its alerts under `path`, a folder a batch: a batch that is
    run again after a failure replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        rescreen.alerts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return book.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions_to(arrivals: DataFrame, store: Store, source: str, checkpoint: str, changed: Callable[[DataFrame, Snapshot], None]) -> StreamingQuery:
    """Stores each arriving version of a list (a batch of entities) and hands on its difference to the one before. The store is the
    state; a version that is stored already changes nothing, so a repeated batch does no harm."""

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        before = store.read(source) if store.stored(source) else None
        now = Snapshot.of(source, batch)
        if store.write(now):
            changed(snapshot_diff(before and before.entities, now.entities), now)

    return arrivals.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, *, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): events by window; an event later than `late` behind the newest is left out, as state is dropped then."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("start"), "event_type", "n")
