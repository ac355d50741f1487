"""Rescreening: a book of subjects against the records that a list change touched, in both versions.

Only changed records are indexed, so the work grows with the book times the change, not with the list. The index ranks by
frequencies among the changed records; scores don't depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.config import Settings
from veritrace.functions.fold import DEFAULT, Dictionary, country_table
from veritrace.operators.scoring import prepared_evidence, prepared_queries, scored
from veritrace.operators.screening import Index
from veritrace.schema import MATCHER_VERSION

ALERT = "subject_id string, change string, source string, entity_id string, score double, previous_score double, fields array<string>, matched_name string, previous_name string, explanation array<struct<factor:string,detail:string,contribution:double>>, previous_explanation array<struct<factor:string,detail:string,contribution:double>>, threshold double, snapshot_id string, previous_snapshot_id string, matcher_version string"


@dataclass
class Rescreen:
    """changes: rows of `entity_diff` of one source, static and small beside the book."""

    spark: SparkSession
    changes: DataFrame
    snapshot_id: str | None = None
    previous_snapshot_id: str | None = None
    settings: Settings = field(default_factory=Settings)
    dictionary: Dictionary = DEFAULT
    countries: dict[str, str] | None = None

    def __post_init__(self):
        self.changes = self.changes.cache()
        self.empty = self.changes.isEmpty()
        if self.empty:
            return
        self.countries = self.countries or country_table(self.spark)
        old = self.changes.where(F.col("previous").isNotNull()).select(F.lit("before").alias("version"), "previous.*")
        new = self.changes.where(F.col("current").isNotNull()).select(F.lit("after").alias("version"), "current.*")
        versions = old.unionByName(new)
        # The version stands for the source, so each version of a record is an entity of its own.
        self.index = Index.build(versions.drop("source").withColumnRenamed("version", "source"), self.dictionary)
        self.evidence = prepared_evidence(self.index.entities, self.countries).select("eid", "type", "dates_of_birth", "countries", "papers").cache()

    def alerts(self, book: DataFrame) -> DataFrame:
        """Alerts of a book (rows of the query schema; qid is the subject, a null threshold takes the settings'), as they rank: by score,
        then entity. What newly scores at the subject's threshold, what no longer does, and what still does though its record changed."""
        if self.empty:  # the book is not read
            return self.spark.createDataFrame([], ALERT)
        book = book.withColumn("sources", F.lit(None).cast("array<string>")).withColumn("threshold", F.coalesce("threshold", F.lit(self.settings.threshold)))
        ready = prepared_queries(book, self.countries, self.dictionary).cache()
        near = self.index.candidates(ready, budget=self.settings.postings_budget, limit=self.settings.candidate_limit)
        ids = near.join(self.index.entities.select("eid", "id"), "eid").select("qid", "id").distinct()
        # Both versions are scored without a cutoff, for the side under it is reported too.
        pairs = ids.join(self.index.entities.select("eid", "id"), "id").select("qid", "eid", F.lit(0.0).alias("cutoff"))
        names = self.index.names.drop("source", "id")
        found = scored(pairs, ready, names, self.evidence, self.settings.weights).drop("cutoff").join(self.index.entities.select("eid", "id", "source"), "eid")

        def side(version: str, prefix: str) -> DataFrame:
            return found.where(F.col("source") == version).select("qid", "id", F.col("score").alias(f"{prefix}score"), F.col("matched_name").alias(f"{prefix}name"), F.col("explanation").alias(f"{prefix}explanation"))

        both = side("after", "").join(side("before", "previous_"), ["qid", "id"], "full_outer").join(ready.select("qid", "threshold"), "qid")
        now, was = (F.coalesce(F.col(c) >= F.col("threshold"), F.lit(False)) for c in ("score", "previous_score"))
        change = F.when(now & ~was, "newly_listed").when(was & ~now, "delisted").when(was & now, "details_changed")
        both = both.withColumn("change", change).where(F.col("change").isNotNull())
        both = both.join(self.changes.select("id", F.col("source").alias("list"), "fields"), "id")
        return both.select(
            F.col("qid").alias("subject_id"), "change", F.col("list").alias("source"), F.col("id").alias("entity_id"), "score", "previous_score", "fields", F.col("name").alias("matched_name"), "previous_name",
            "explanation", "previous_explanation", "threshold", F.lit(self.snapshot_id).cast("string").alias("snapshot_id"), F.lit(self.previous_snapshot_id).cast("string").alias("previous_snapshot_id"), F.lit(MATCHER_VERSION).alias("matcher_version"),
        )


def ranked(alerts: DataFrame) -> DataFrame:
    """Alerts in their order: by subject, score and entity."""
    return alerts.orderBy("subject_id", F.desc(F.coalesce("score", "previous_score")), "entity_id")
