"""Definitions of sources, adapters and their registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from veritrace.errors import InvalidArgument
from veritrace.schema import WARNING, conformed


@dataclass(frozen=True)
class Definition:
    """What is known of a source without reading it. files: the names of its payloads, the main one first."""

    key: str
    jurisdiction: str
    authority: str
    format: str
    files: tuple[str, ...] = ("main",)
    floors: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        if not self.key.replace("_", "").isalnum() or self.key != self.key.lower():
            raise InvalidArgument(f"a source's key is in lower case, letters, digits and underscores: {self.key!r}")


@dataclass
class Parsed:
    """What one reading of a source gives: conformed entities, and what was mended or left over on the way."""

    entities: DataFrame
    warnings: DataFrame
    orphans: dict[str, DataFrame] = field(default_factory=dict)
    segments: DataFrame | None = None
    columns: DataFrame | None = None
    source_version: str | None = None


class Adapter:
    """Reads a source's payloads: `parse` gives entities. Subclasses set `definition` and `parse`."""

    definition: Definition

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        raise NotImplementedError

    def read(self, spark: SparkSession, paths: dict[str, str] | str) -> Parsed:
        paths = {self.definition.files[0]: paths} if isinstance(paths, str) else paths
        missing = set(self.definition.files) - set(paths)
        if missing:
            raise InvalidArgument(f"{self.definition.key} needs the payload(s) {', '.join(sorted(missing))}")
        parsed = self.parse(spark, paths)
        parsed.entities = conformed(parsed.entities)
        return parsed


def no_warnings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], WARNING)


class Registry:
    def __init__(self):
        self._held: dict[str, Adapter] = {}

    def register(self, adapter: Adapter) -> Adapter:
        key = adapter.definition.key
        if key in self._held and type(self._held[key]) is not type(adapter):
            raise InvalidArgument(f"another adapter is registered as {key}")
        self._held[key] = adapter
        return adapter

    def __getitem__(self, key: str) -> Adapter:
        if key not in self._held:
            raise InvalidArgument(f"no source {key!r} is registered; there are {', '.join(self.keys()) or 'none'}")
        return self._held[key]

    def keys(self) -> list[str]:
        return sorted(self._held)

    def all(self) -> list[Adapter]:
        return [self._held[k] for k in self.keys()]

    def enabled(self, keys: list[str] | None = None) -> list[Adapter]:
        return self.all() if keys is None else [self[k] for k in keys]

    def unregister(self, key: str) -> None:
        self._held.pop(key, None)


SOURCES = Registry()
