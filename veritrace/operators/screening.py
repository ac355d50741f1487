"""Blocked name screening: postings over tokens, trigrams and sound keys, TF-IDF cosine candidates, then scores with evidence.

Features of both sides join by equality, so no pair is made that shares nothing; a posting budget per query keeps frequent
features from multiplying rows, and the candidate limit is applied per query by partial and final top-k.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.config import Settings, Weights
from veritrace.errors import QueryError
from veritrace.functions.fold import DEFAULT, Dictionary, country_table
from veritrace.functions.similarity import tokens, trigrams
from veritrace.operators.queries import queries_of
from veritrace.operators.scoring import name_rows, penalties, prepared_evidence, prepared_queries, scored
from veritrace.schema import MATCHER_VERSION, primary_name


def features(names: DataFrame) -> DataFrame:
    """(id, space, feature), each once; sound keys where names have a column `sounds`."""
    tagged = lambda s, a: F.transform(a, lambda x: F.struct(F.lit(s).alias("space"), x.alias("feature")))
    spaces = [tagged("token", F.array_distinct(tokens(F.col("name")))), tagged("trigram", trigrams(F.col("name")))]
    if "sounds" in names.columns:
        spaces.append(tagged("phonetic", F.array_distinct(F.flatten("sounds"))))
    return names.where(F.col("name") != "").select("id", F.explode(F.concat(*spaces)).alias("f")).select("id", "f.space", "f.feature")


def frequencies(posted: DataFrame, n: int) -> DataFrame:
    """(space, feature, df, idf) with idf = ln(1 + N / df)."""
    return posted.groupBy("space", "feature").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + F.lit(n) / F.col("df")))


def norms(posted: DataFrame, idf: DataFrame) -> DataFrame:
    return posted.join(idf, ["space", "feature"]).groupBy("id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))


def within_budget(queries: DataFrame, idf: DataFrame, budget: int) -> DataFrame:
    """(qid, space, feature, df, idf): a query's rarest features whose postings fit; the first always stays."""
    order = Window.partitionBy("qid").orderBy("df", "space", "feature")
    walked = queries.withColumnRenamed("id", "qid").join(idf, ["space", "feature"])
    walked = walked.withColumn("rn", F.row_number().over(order)).withColumn("cum", F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return walked.where((F.col("rn") == 1) | (F.col("cum") <= budget)).select("qid", "space", "feature", "df", "idf")


def cosines(posted: DataFrame, idf: DataFrame, normed: DataFrame, asked: DataFrame, budget: int) -> DataFrame:
    """(qid, id, cosine) of all entries that share a walked feature with a query. normed: norms of the entries; asked: features of the
    queries."""
    walked = within_budget(asked, idf, budget)
    q_norm = walked.groupBy("qid").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("q_norm"))
    dots = walked.join(posted, ["space", "feature"]).groupBy("qid", "id").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    cosine = F.least(F.lit(1.0), F.col("dot") / (F.col("norm") * F.col("q_norm")))
    return dots.join(normed, "id").join(q_norm, "qid").select("qid", "id", cosine.alias("cosine"))


def candidates(names: DataFrame, queries: DataFrame, *, budget: int = 5000, limit: int = 200) -> DataFrame:
    """(qid, id, weight): the best entries of each query by cosine, ties by id. Cosines tie where they differ by less than 1e-12, as sums
    of one set of numbers in another order may."""
    posted = features(names)
    idf = frequencies(posted, names.where(F.col("name") != "").count())
    pairs = cosines(posted, idf, norms(posted, idf), features(queries), budget)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 12)), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "id", F.round("cosine", 6).alias("weight"))


def screen(names: DataFrame, queries: DataFrame, score, *, threshold: float = 75.0, limit: int = 10, **options) -> DataFrame:
    """(qid, id, score): the results of each query at the threshold or above, over plain names. score(a, b) -> Column of 0 to 100."""
    pairs = candidates(names, queries, **options).join(names.withColumnRenamed("name", "e_name"), "id").join(queries.withColumnsRenamed({"id": "qid", "name": "q_name"}), "qid")
    pairs = pairs.select("qid", "id", F.round(score(F.col("q_name"), F.col("e_name")), 1).alias("score")).where(F.col("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


# Entities


def entity_key() -> Column:
    return F.concat_ws("\x1f", F.coalesce("source", F.lit("")), "id").alias("eid")


@dataclass
class Index:
    """What screening reads of the listed entities: all their names, and each distinct folded name of an entity as an entry."""

    entities: DataFrame
    names: DataFrame
    entries: DataFrame
    posted: DataFrame
    idf: DataFrame
    normed: DataFrame

    @classmethod
    def build(cls, entities: DataFrame, dictionary: Dictionary = DEFAULT) -> Index:
        keyed = entities.select(entity_key(), "*")
        names = name_rows(keyed, dictionary, "eid", "source", "id").cache()
        first = Window.partitionBy("eid", "form").orderBy("position")
        entries = names.withColumn("rn", F.row_number().over(first)).where(F.col("rn") == 1)
        entries = entries.select(F.xxhash64("eid", "form").alias("entry"), "eid", "source", F.col("id").alias("entity_id"), "position", "form", "tokens", "sounds").cache()
        posted = features(entries.select(F.col("entry").alias("id"), F.col("form").alias("name"), "sounds")).cache()
        idf = frequencies(posted, entries.count()).cache()
        return cls(keyed, names, entries, posted, idf, norms(posted, idf).cache())

    def stats(self) -> DataFrame:
        """(names, entities, token, trigram, phonetic, postings)"""
        spaces = [F.count(F.when(F.col("space") == s, 1)).alias(f"{s}s") for s in ("token", "trigram", "phonetic")]
        features_of = self.idf.agg(*spaces, F.sum("df").alias("postings"))
        return self.entries.agg(F.count("*").alias("names"), F.countDistinct("eid").alias("entities")).crossJoin(features_of)

    def candidates(self, queries: DataFrame, *, budget: int, limit: int) -> DataFrame:
        """(qid, eid): the entities of each prepared query's best entries. A query's sources bound what counts towards the limit."""
        asked = features(queries.select(F.col("qid").alias("id"), F.col("form").alias("name"), "sounds"))
        pairs = cosines(self.posted, self.idf, self.normed, asked, budget).withColumnRenamed("id", "entry")
        pairs = pairs.join(self.entries.select("entry", "eid", "source", "entity_id", "position"), "entry").join(queries.select("qid", "sources"), "qid")
        pairs = pairs.where(F.col("sources").isNull() | F.array_contains("sources", F.col("source")))
        order = Window.partitionBy("qid").orderBy(F.desc(F.round("cosine", 12)), "source", "entity_id", "position")
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "eid").distinct()


@dataclass
class Matcher:
    """Screens queries against entities. snapshots: (source, snapshot_id, verified), to stamp results with."""

    spark: SparkSession
    entities: DataFrame
    snapshots: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    dictionary: Dictionary = DEFAULT
    countries: dict[str, str] | None = None

    def __post_init__(self):
        self.countries = self.countries or country_table(self.spark)
        self.index = Index.build(self.entities, self.dictionary)
        evidence = prepared_evidence(self.index.entities, self.countries)
        self.evidence = evidence.select("eid", "type", "dates_of_birth", "countries", "papers").cache()

    def screen(self, query=None, **overrides) -> DataFrame:
        return self.screen_all([query if query is not None else {}], **overrides)

    def screen_all(self, asked: Iterable | DataFrame, weights: Weights | None = None, **overrides) -> DataFrame:
        """Results of all queries: score, what matched, the explanation, and the stamp. asked: names, dicts, or rows of the query schema."""
        queries = asked if isinstance(asked, DataFrame) else queries_of(self.spark, asked, self.settings, **overrides)
        self.held(queries)
        weights = weights or self.settings.weights
        ready = prepared_queries(queries, self.countries, self.dictionary).cache()
        pairs = self.index.candidates(ready, budget=self.settings.postings_budget, limit=self.settings.candidate_limit)
        pairs = pairs.join(ready.select("qid", F.col("threshold").alias("cutoff")), "qid")
        found = scored(pairs, ready, self.index.names.drop("source", "id"), self.evidence, weights)
        who = self.index.entities.select("eid", "source", F.col("id").alias("entity_id"), "type", primary_name(F.col("names")).alias("primary_name"))
        found = found.join(who, "eid").join(ready.select("qid", "limit"), "qid")
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "source", "entity_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("limit"))
        return self.stamped(found, weights).select(
            "qid", "rank", "source", "entity_id", "type", "primary_name", "matched_name", "matched_kind", "score", "explanation", penalties(F.col("explanation")).alias("penalties"),
            F.col("cutoff").alias("threshold"), "snapshot_id", "verified", "matcher_version", "backend", "weights", "screened_at",
        )

    def held(self, queries: DataFrame) -> None:
        """Refuses queries that name a source which is not held."""
        asked = queries.select(F.explode("sources").alias("source")).distinct()
        missing = [r["source"] for r in asked.join(self.entities.select("source").distinct(), "source", "left_anti").limit(20).collect()]
        if missing:
            raise QueryError(f"no snapshot is held of {', '.join(sorted(missing))}")

    def stamped(self, found: DataFrame, weights: Weights) -> DataFrame:
        shares = F.create_map(*[F.lit(x) for k, v in vars(weights).items() for x in (k, v)])
        stamp = {"matcher_version": F.lit(MATCHER_VERSION), "backend": F.lit("spark"), "weights": shares, "screened_at": F.date_trunc("second", F.current_timestamp())}
        if self.snapshots is None:
            return found.withColumns({**stamp, "snapshot_id": F.lit(None).cast("string"), "verified": F.lit(False)})
        return found.join(F.broadcast(self.snapshots.select("source", "snapshot_id", "verified")), "source", "left").withColumns(stamp)
