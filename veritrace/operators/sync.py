"""Taking in lists: each source by itself, so that one that fails keeps its stored version and stops no other."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.errors import ParseError, ScreeningError
from veritrace.operators.snapshots import Snapshot, Store
from veritrace.sources.registry import Adapter

RESULT = "source string, status string, record_count long, snapshot_id string, message string, retryable boolean, fetched_at timestamp"


def sync(spark: SparkSession, store: Store, arrived: dict[str, tuple[Adapter, dict[str, str] | str]], log: Callable[[str], None] = lambda line: None) -> DataFrame:
    """Reads the payloads of each source and stores what is new. A row for each: updated, unchanged or failed. Payloads lie where a
    fetch has put them; there is a driver call for each source and no more."""
    rows = []
    for key, (adapter, paths) in sorted(arrived.items()):
        before = store.meta(key)
        try:
            parsed = adapter.read(spark, paths)
            snapshot = Snapshot.of(key, parsed.entities, source_version=parsed.source_version)
            if not snapshot.record_count:
                raise ParseError(f"{key} parsed to no records at all")
            status = "updated" if store.write(snapshot) else "unchanged"
            rows.append((key, status, snapshot.record_count, snapshot.snapshot_id, None, False, snapshot.fetched_at))
        except Exception as e:  # whatever one source does, the others go on and the stored version stays
            held = (before.record_count, before.snapshot_id, before.fetched_at) if before else (None, None, None)
            rows.append((key, "failed", held[0], held[1], f"{type(e).__name__}: {e}"[:500], bool(getattr(e, "retryable", not isinstance(e, ScreeningError))), held[2]))
        log(f"{rows[-1][0]}: {rows[-1][1]}")
    return spark.createDataFrame(rows, RESULT)


def tallies(results: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """(updated, unchanged, failed, record_count, max_age_seconds) over a sync's results."""
    when = F.current_timestamp() if now is None else F.lit(now)
    by = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("updated", "unchanged", "failed")]
    return results.agg(*by, F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count"), F.max(F.unix_timestamp(when) - F.unix_timestamp("fetched_at")).alias("max_age_seconds"))
