"""Versions of lists: checksums over content, a store that keeps every version, and signed bundles.

A store is a folder: `entities/source=.../snapshot=...` holds immutable rows, `meta/` a row for each write. The current version of a
source is its latest meta row, so a reader never sees half a write, and `diff` can read any two versions.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.errors import CorruptSnapshot, IntegrityError, InvalidArgument, MissingSnapshot, UnsupportedSchema
from veritrace.schema import ENTITY, SCHEMA_VERSION

META = "source string, snapshot_id string, record_count long, fetched_at timestamp, schema_version int, source_version string, verified boolean, written_at timestamp, removed boolean"


def fingerprints(entities: DataFrame) -> DataFrame:
    """(fingerprint): the hash of each record's content."""
    return entities.select(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(entities.columns)])), 256).alias("fingerprint"))


def checksum(entities: DataFrame, source: str, schema_version: int = SCHEMA_VERSION) -> str:
    """The hash of the content, whatever the order of rows. Sorted fingerprints are hashed by their first three digits, and those 4,096
    hashes once more, so no task holds all of them."""
    prints = fingerprints(entities)
    parts = prints.groupBy(F.substring("fingerprint", 1, 3).alias("bucket")).agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("fingerprint"))), 256).alias("digest"))
    digest = hashlib.sha256(f"{schema_version}\n{source}\n".encode())
    for r in sorted(parts.collect(), key=lambda r: r["bucket"]):  # at most 4,096 rows
        digest.update(f"{r['bucket']} {r['digest']}\n".encode())
    return f"sha256:{digest.hexdigest()}"


@dataclass(frozen=True)
class Snapshot:
    """One version of one list."""

    source: str
    entities: DataFrame
    snapshot_id: str
    record_count: int
    fetched_at: dt.datetime
    source_version: str | None = None
    verified: bool = False

    @classmethod
    def of(cls, source: str, entities: DataFrame, fetched_at: dt.datetime | None = None, source_version: str | None = None, expected: str | None = None) -> Snapshot:
        if not source:
            raise InvalidArgument("a snapshot needs a source")
        found = checksum(entities, source)
        if expected not in (None, found):
            raise IntegrityError(f"{source}: the content hashes to {found}, not {expected}")
        when = (fetched_at or dt.datetime.now(dt.UTC)).replace(microsecond=0)
        return cls(source, entities, found, entities.count(), when, source_version, expected is not None)

    def same_content(self, other: Snapshot | None) -> bool:
        return other is not None and other.snapshot_id == self.snapshot_id


class Store:
    """Snapshots under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _meta(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], META)
        return self.spark.read.schema(META).parquet(f"{self.path}/meta")

    def _note(self, **row) -> None:
        names = [c.split()[0] for c in META.split(", ")]
        row = {"written_at": dt.datetime.now(dt.UTC), "removed": False, **row}
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], META).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def _folder(self, source: str, snapshot_id: str) -> str:
        return f"{self.path}/entities/source={source}/snapshot={snapshot_id.replace(':', '-')}"

    def write(self, snapshot: Snapshot) -> bool:
        """Stores a version; False where it is the current one already."""
        if snapshot.same_content(self.meta(snapshot.source)):
            return False
        folder = self._folder(snapshot.source, snapshot.snapshot_id)
        # Rows of a version are the same whoever writes them: a repeated write replaces them by themselves.
        snapshot.entities.write.mode("overwrite").parquet(folder)
        self._note(source=snapshot.source, snapshot_id=snapshot.snapshot_id, record_count=snapshot.record_count, fetched_at=snapshot.fetched_at, schema_version=SCHEMA_VERSION, source_version=snapshot.source_version, verified=snapshot.verified)
        return True

    def current(self) -> DataFrame:
        """The meta row of each source that is stored."""
        last = self._meta().groupBy("source").agg(F.max_by(F.struct("*"), F.col("written_at")).alias("m")).select("m.*")
        return last.where(~F.col("removed")).drop("removed")

    def history(self, source: str) -> DataFrame:
        return self._meta().where(F.col("source") == source).orderBy("written_at")

    def meta(self, source: str) -> Snapshot | None:
        """What is known of the current version, without its rows."""
        r = self.current().where(F.col("source") == source).first()
        return None if r is None else Snapshot(source, self.spark.createDataFrame([], ENTITY), r["snapshot_id"], r["record_count"], r["fetched_at"], r["source_version"], r["verified"])

    def sources(self) -> list[str]:
        return sorted(r["source"] for r in self.current().select("source").collect())

    def stored(self, source: str) -> bool:
        return self.meta(source) is not None

    def read(self, source: str, snapshot_id: str | None = None, verify: bool = True) -> Snapshot:
        """A version, the current one by default. Rows that don't give their checksum are refused, not returned."""
        rows = self._meta().where((F.col("source") == source) & ~F.col("removed"))
        rows = rows.where(F.col("snapshot_id") == snapshot_id) if snapshot_id else rows
        r = rows.orderBy(F.desc("written_at")).first() if snapshot_id or self.stored(source) else None
        if r is None:
            raise MissingSnapshot(f"no snapshot of {source}{f' with id {snapshot_id}' if snapshot_id else ''} is stored")
        if r["schema_version"] != SCHEMA_VERSION:
            raise UnsupportedSchema(f"{source} is stored under schema {r['schema_version']}, this reads {SCHEMA_VERSION}")
        entities = self.spark.read.schema(ENTITY).parquet(self._folder(source, r["snapshot_id"]))
        if verify and checksum(entities, source) != r["snapshot_id"]:
            raise CorruptSnapshot(f"{source}: the stored rows don't give {r['snapshot_id']}")
        return Snapshot(source, entities, r["snapshot_id"], r["record_count"], r["fetched_at"], r["source_version"], r["verified"])

    def delete(self, source: str) -> bool:
        """Takes a source out of the current ones; its versions stay readable by id."""
        if not self.stored(source):
            return False
        self._note(source=source, snapshot_id="", record_count=0, schema_version=SCHEMA_VERSION, verified=False, removed=True)
        return True

    def clear(self) -> None:
        for source in self.sources():
            self.delete(source)

    def each_entity(self, sources: list[str] | None = None) -> DataFrame:
        """The entities of all current versions, or of some; each source is its own folder, so others are not read."""
        held = [r for r in self.current().collect() if sources is None or r["source"] in sources]
        missing = set(sources or ()) - {r["source"] for r in held}
        if missing:
            raise MissingSnapshot(f"no snapshot of {', '.join(sorted(missing))} is stored")
        if not held:
            return self.spark.createDataFrame([], ENTITY)
        return self.spark.read.schema(ENTITY).parquet(*[self._folder(r["source"], r["snapshot_id"]) for r in held])

    def ages(self, now: dt.datetime | None = None) -> DataFrame:
        """(source, record_count, age_seconds) of the current versions."""
        when = F.current_timestamp() if now is None else F.lit(now)
        return self.current().select("source", "record_count", (F.unix_timestamp(when) - F.unix_timestamp("fetched_at")).alias("age_seconds"))


MAGIC = "entity-bundle/1"


def export(snapshot: Snapshot, path: str, key: bytes | None = None) -> None:
    """Writes a bundle: compressed JSON lines in the order of ids, and a header that names the content's checksum. key signs the header,
    and with it the content."""
    spark = snapshot.entities.sparkSession
    header = {
        "magic": MAGIC, "source": snapshot.source, "snapshot_id": snapshot.snapshot_id, "record_count": snapshot.record_count, "schema_version": SCHEMA_VERSION,
        "fetched_at": snapshot.fetched_at.isoformat(), "source_version": snapshot.source_version, "payload": uuid.uuid4().hex,
    }
    payload = snapshot.entities.orderBy("id").select(F.to_json(F.struct(*[F.col(c) for c in snapshot.entities.columns])).alias("value"))
    payload.write.option("compression", "gzip").text(f"{path}/{header['payload']}")
    line = json.dumps(header, sort_keys=True)
    signed = hmac.new(key, line.encode(), hashlib.sha256).hexdigest() if key else ""
    spark.createDataFrame([(0, line), (1, signed)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{path}/header")


def read_bundle(spark: SparkSession, path: str, key: bytes | None = None) -> Snapshot:
    """A bundle's snapshot. With a key the signature must be that key's; the rows must give the header's checksum in any case."""
    lines = [r["value"] for r in spark.read.text(f"{path}/header").collect()]
    header = json.loads(next((x for x in lines if x.startswith("{")), "{}"))
    if header.get("magic") != MAGIC:
        raise IntegrityError(f"{path} is no bundle")
    if header["schema_version"] != SCHEMA_VERSION:
        raise UnsupportedSchema(f"{path} has schema {header['schema_version']}, this reads {SCHEMA_VERSION}")
    if key is not None:
        signed = hmac.new(key, json.dumps(header, sort_keys=True).encode(), hashlib.sha256).hexdigest()
        if not any(hmac.compare_digest(x, signed) for x in lines):
            raise IntegrityError(f"{path}: the signature is not this key's")
    rows = spark.read.text(f"{path}/{header['payload']}").select(F.from_json("value", ENTITY, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    if checksum(rows, header["source"]) != header["snapshot_id"]:
        raise IntegrityError(f"{path}: the rows don't give {header['snapshot_id']}")
    return Snapshot(header["source"], rows, header["snapshot_id"], header["record_count"], dt.datetime.fromisoformat(header["fetched_at"]), header["source_version"], key is not None)


# The normalised layout, for SQL stores


def normalised(entities: DataFrame) -> dict[str, DataFrame]:
    """The entities as flat tables: entities, names, addresses and identifiers, children with their entity's id and their place."""

    def children(name: str) -> DataFrame:
        return entities.select("source", F.col("id").alias("entity_id"), F.posexplode(name).alias("position", "x")).select("source", "entity_id", "position", "x.*")

    flat = entities.select(
        "id", "source", "source_ref", "type", *[F.to_json(c).alias(c) for c in ("dates_of_birth", "nationalities", "programs", "listed_on")], "remarks",
    )
    papers = children("identifiers")
    papers = papers.withColumns({c: F.to_json(c) for c in ("issued_on", "expires_on")})
    return {"entities": flat, "names": children("names"), "addresses": children("addresses"), "identifiers": papers}


def reassembled(tables: dict[str, DataFrame]) -> DataFrame:
    """The entities of their flat tables."""
    out = tables["entities"]
    kinds = {f.name: f.dataType for f in ENTITY.fields}
    for c in ("dates_of_birth", "nationalities", "programs", "listed_on"):
        out = out.withColumn(c, F.from_json(c, kinds[c]))
    for name in ("names", "addresses", "identifiers"):
        fields = kinds[name].elementType.fields
        element = F.struct(*[(F.from_json(f.name, f.dataType) if f.name in ("issued_on", "expires_on") else F.col(f.name)).alias(f.name) for f in fields])
        by = tables[name].groupBy("source", F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", element.alias("e")))).alias("all"))
        by = by.select(F.col("source").alias("c_source"), F.col("id").alias("c_id"), F.transform("all", lambda x: x["e"]).alias(name))
        out = out.join(by, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("id") == F.col("c_id")), "left").drop("c_source", "c_id")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kinds[name])))
    return out.select(*ENTITY.fieldNames())
