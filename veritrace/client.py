"""The public operations over one store."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.config import Settings
from veritrace.functions.fold import DEFAULT, Dictionary
from veritrace.operators import profile, snapshots
from veritrace.operators.changes import snapshot_diff
from veritrace.operators.queries import subjects_of
from veritrace.operators.rescreen import Rescreen
from veritrace.operators.screening import Matcher
from veritrace.operators.snapshots import Snapshot, Store
from veritrace.operators.sync import sync
from veritrace.sources import lists, treasury
from veritrace.sources.registry import SOURCES


class Client:
    """screen, screen_all, sync, diff, rescreen, doctor, export and import over the lists of a store. Immutable but for its matcher,
    which is built at the first screening and anew after a sync that changed something."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), dictionary: Dictionary = DEFAULT):
        self.spark, self.store, self.settings, self.dictionary = spark, Store(spark, path), settings, dictionary
        self._matcher: Matcher | None = None

    @property
    def matcher(self) -> Matcher:
        if self._matcher is None:
            held = self.store.current().select("source", "snapshot_id", "verified")
            self._matcher = Matcher(self.spark, self.store.each_entity(), held, self.settings, self.dictionary)
        return self._matcher

    def reload(self) -> None:
        self._matcher = None

    def screen(self, query=None, **fields) -> DataFrame:
        return self.matcher.screen(query, **fields)

    def screen_all(self, asked: Iterable | DataFrame, **overrides) -> DataFrame:
        return self.matcher.screen_all(asked, **overrides)

    def sync(self, arrived: dict[str, dict[str, str] | str]) -> DataFrame:
        """Takes in the payloads of registered sources, by key."""
        results = sync(self.spark, self.store, {k: (SOURCES[k], p) for k, p in arrived.items()})
        if not results.where(F.col("status") == "updated").isEmpty():
            self.reload()
        return results

    def diff(self, source: str, earlier: str | None = None, later: str | None = None) -> DataFrame:
        """What changed between two stored versions of a source: by default from the one before to the current one."""
        ids = [r["snapshot_id"] for r in self.store.history(source).where(~F.col("removed")).collect()]
        now = self.store.read(source, later)
        before = earlier or next((i for i in reversed(ids) if i != now.snapshot_id), None)
        return snapshot_diff(self.store.read(source, before).entities if before else None, now.entities)

    def rescreen(self, book: Iterable[dict] | DataFrame, changes: DataFrame, **ids) -> DataFrame:
        subjects = book if isinstance(book, DataFrame) else subjects_of(self.spark, book, self.settings)
        return Rescreen(self.spark, changes, settings=self.settings, dictionary=self.dictionary, **ids).alerts(subjects)

    def doctor(self, source: str, paths: dict[str, str] | str, tolerance: float | None = None) -> DataFrame:
        """Findings of a payload against the stored version of its source, or the source's floors; nothing is stored."""
        adapter = SOURCES[source]
        parsed = adapter.read(self.spark, paths)
        coverage = None
        if parsed.segments is not None:
            from veritrace.sources.remarks import coverage as covered

            row = covered(parsed.segments).first()
            coverage = row["ratio"] if row["segments"] else None
        now = profile.measure(parsed.entities, source, warnings=parsed.warnings, orphans={k: df.count() for k, df in parsed.orphans.items()} or None, coverage=coverage, columns=parsed.columns)
        was = profile.measure(self.store.read(source).entities, source) if self.store.stored(source) else None
        return profile.ordered(profile.findings(now, was, adapter.definition.floors, self.settings.tolerance if tolerance is None else tolerance))

    def export(self, source: str, path: str, key: bytes | None = None) -> None:
        snapshots.export(self.store.read(source), path, key)

    def import_(self, path: str, key: bytes | None = None) -> Snapshot:
        snapshot = snapshots.read_bundle(self.spark, path, key)
        if self.store.write(snapshot):
            self.reload()
        return snapshot


__all__ = ["Client", "lists", "treasury"]
