"""Scores of (query, entity) pairs: the best name by five similarities, then evidence, each part with its reason.

A pair carries `cutoff`; what can't reach it goes before the costly similarity. The name's share of the cutoff is what evidence
leaves of it, and every bound is exact, so no pair at the cutoff is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrace.config import Weights
from veritrace.functions.dates import date_text, overlaps, same_day
from veritrace.functions.fold import DEFAULT, Dictionary, country_keys, form_of
from veritrace.functions.phonetics import agreement, sounds
from veritrace.functions.similarity import jaro_winkler, jaro_winkler_ceiling, levenshtein_similarity, set_ratio, sorted_line, sorted_set, tokens

LEAST_IDENTIFIER = 4


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))


def prepared_evidence(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """df with `countries` (key, known) of its nationalities, and the country key of each identifier."""
    keys = country_keys(F.transform("identifiers", lambda x: x["country"]), table)
    df = df.withColumn("countries", country_keys(F.col("nationalities"), table)).withColumn("_keys", keys)
    return df.withColumn("papers", F.transform("identifiers", lambda x, i: x.withField("country_key", F.when(x["country"].isNotNull(), F.get("_keys", i)["key"])))).drop("_keys")


def prepared_queries(queries: DataFrame, table: dict[str, str], dictionary: Dictionary = DEFAULT) -> DataFrame:
    """Queries with their folded name, its tokens and their sound keys."""
    df = prepared_evidence(queries, table).withColumn("form", form_of(F.col("name"), F.col("type"), dictionary))
    return with_tokens(df)


def with_tokens(df: DataFrame) -> DataFrame:
    """df with the tokens of `form`, their sorted line and set, and their sound keys: computed once a name, not once a pair."""
    df = df.withColumn("tokens", tokens(F.col("form"))).withColumn("sounds", sounds("tokens"))
    return df.withColumn("line", sorted_line(F.col("tokens"))).withColumn("set", sorted_set(F.col("tokens")))


def name_rows(entities: DataFrame, dictionary: Dictionary = DEFAULT, *keys: str) -> DataFrame:
    """(keys, type, position, value, kind, quality, form, tokens, sounds, line, set): each name of each entity; names that fold to nothing go."""
    df = entities.select(*keys, "type", F.posexplode("names").alias("position", "n"))
    df = df.select(*keys, "type", "position", "n.value", "n.kind", "n.quality").withColumn("form", form_of(F.col("value"), F.col("type"), dictionary))
    return with_tokens(df.where(F.col("form") != ""))


def reason(factor: str, detail: Column, contribution) -> Column:
    value = F.round(contribution if isinstance(contribution, Column) else F.lit(float(contribution)), 1)
    return F.struct(F.lit(factor).alias("factor"), detail.alias("detail"), value.alias("contribution"))


def identifier_reason(mine: Column, theirs: Column, w: Weights) -> Column:
    """Of the query's papers the first that the entity has too."""

    def same(a: Column, b: Column) -> Column:
        kind = (a["kind"] == b["kind"]) | (a["kind"] == "other") | (b["kind"] == "other")
        country = a["country_key"].isNull() | b["country_key"].isNull() | (a["country_key"] == b["country_key"])
        return (a["normalized_value"] == b["normalized_value"]) & kind & country

    long = F.filter(mine, lambda a: F.length(a["normalized_value"]) >= LEAST_IDENTIFIER)
    pairs = F.transform(long, lambda a: F.struct(a.alias("a"), F.get(F.filter(theirs, lambda b: same(a, b)), F.lit(0)).alias("b")))
    hit = F.get(F.filter(pairs, lambda p: p["b"].isNotNull()), F.lit(0))
    kind = F.when(hit["a"]["kind"] == "other", hit["b"]["kind"]).otherwise(hit["a"]["kind"])
    listed = F.when(hit["a"]["value"] == hit["b"]["value"], "").otherwise(F.concat(F.lit(" listed "), hit["b"]["value"]))
    detail = F.concat(kind, F.lit(" "), hit["a"]["value"], F.lit(" matches"), listed)
    return F.when(hit["a"].isNotNull(), reason("identifier", detail, w.identifier_match))


def birth_reason(mine: Column, theirs: Column, w: Weights) -> Column:
    """A common day, else dates that overlap, else a conflict; nothing where either side has no date."""
    pairs = F.flatten(F.transform(mine, lambda a: F.transform(theirs, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    first = lambda test: F.get(F.filter(pairs, lambda p: test(p["a"], p["b"])), F.lit(0))
    exact, near = first(same_day), first(overlaps)
    all_of = lambda dates: F.array_join(F.transform(dates, date_text), ", ")
    text = lambda *parts: F.concat(F.lit("date of birth "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    out = F.when((F.size(mine) == 0) | (F.size(theirs) == 0), None)
    out = out.when(exact["a"].isNotNull(), reason("dob", text(date_text(exact["a"]), " matches"), w.dob_exact))
    out = out.when(near["a"].isNotNull(), reason("dob", text(date_text(near["a"]), " overlaps listed ", date_text(near["b"])), w.dob_overlap))
    return out.otherwise(reason("dob", text(all_of(mine), " conflicts with listed ", all_of(theirs)), w.dob_conflict))


def nationality_reason(mine: Column, theirs: Column, w: Weights) -> Column:
    """A common country; a conflict only where every value on both sides is a known country."""
    keys = lambda c: F.array_distinct(F.transform(c, lambda x: x["key"]))
    shared = F.array_intersect(keys(mine), keys(theirs))
    known = F.forall(mine, lambda x: x["known"]) & F.forall(theirs, lambda x: x["known"]) & (F.size(keys(mine)) == F.size(mine))
    out = F.when((F.size(mine) == 0) | (F.size(theirs) == 0), None)
    out = out.when(F.size(shared) > 0, reason("nationality", F.concat(F.array_join(shared, ", "), F.lit(" matches")), w.nationality_match))
    conflict = F.concat(F.lit("query "), F.array_join(keys(mine), ", "), F.lit(" vs listed "), F.array_join(keys(theirs), ", "))
    return out.when(known, reason("nationality", conflict, w.nationality_conflict))


def total(reasons: Column) -> Column:
    return F.round(F.aggregate(reasons, F.lit(0.0), lambda a, r: a + r["contribution"]), 1)


def scored(pairs: DataFrame, queries: DataFrame, names: DataFrame, evidence: DataFrame, weights: Weights) -> DataFrame:
    """(qid, eid, cutoff, score, matched_name, matched_kind, explanation) of the pairs (qid, eid, cutoff) at their cutoff.

    queries: prepared, by qid; names: name_rows by eid; evidence: eid, type, dates_of_birth, countries, papers.
    """
    q = queries.select("qid", F.col("type").alias("q_type"), F.col("dates_of_birth").alias("q_dates"), F.col("countries").alias("q_countries"), F.col("papers").alias("q_papers"))
    pairs = pairs.join(q, "qid").join(evidence.select("eid", F.col("type").alias("e_type"), "dates_of_birth", "countries", "papers"), "eid")
    pairs = pairs.where(F.col("q_type").isNull() | (F.col("q_type") == F.col("e_type")))
    found = F.array(
        identifier_reason(F.col("q_papers"), F.col("papers"), weights), birth_reason(F.col("q_dates"), F.col("dates_of_birth"), weights),
        nationality_reason(F.col("q_countries"), F.col("countries"), weights),
    )
    pairs = pairs.select("qid", "eid", "cutoff", F.filter(found, lambda r: r.isNotNull()).alias("adjustments"))
    given = F.aggregate("adjustments", F.lit(0.0), lambda a, r: a + r["contribution"])
    pairs = pairs.withColumn("floor", F.when(F.col("cutoff") > 0, F.greatest(F.col("cutoff") - given, F.lit(0.0))).otherwise(0.0))

    a = queries.select("qid", *[F.col(c).alias(f"q_{c}") for c in ("form", "tokens", "sounds", "line", "set")])
    rows = pairs.join(a, "qid").join(names.drop("type"), "eid")
    penalty = F.when(F.col("quality") == "low", F.lit(weights.low_quality_alias)).otherwise(0.0)
    rows = rows.withColumn("penalty", penalty).withColumn("least", F.least(F.greatest(F.col("floor") - F.col("penalty"), F.lit(0.0)), F.lit(100.0)) / 100)
    x, y = F.col("q_form"), F.col("form")
    rows = rows.withColumns({
        "token_set": set_ratio(F.col("q_set"), F.col("set")), "token_sort": levenshtein_similarity(F.col("q_line"), F.col("line")), "levenshtein": levenshtein_similarity(x, y),
        "phonetic": agreement(F.col("q_tokens"), F.col("q_sounds"), F.col("tokens"), F.col("sounds")),
    })

    def blend(first: Column) -> Column:
        out = F.lit(0.0)
        for k, share in weights.shares().items():
            out = out + share * (first if k == "jaro_winkler" else F.col(k))
        return out

    # Jaro-Winkler alone needs Python: only pairs that could still reach the cutoff go there, each pair of strings once a batch.
    rows = rows.where(blend(jaro_winkler_ceiling(x, y)) >= F.col("least") - 1e-9)
    rows = rows.withColumn("raw", blend(jaro_winkler(x, y))).where((F.col("least") <= 0) | (F.col("raw") >= F.col("least")))
    order = F.struct((100 * F.col("raw") + F.col("penalty")).alias("s"), (-F.col("position")).alias("p"), "raw", "penalty", "value", "kind")
    best = rows.groupBy("qid", "eid").agg(F.max(order).alias("b"), F.first("cutoff").alias("cutoff"), F.first("adjustments").alias("adjustments"))
    b = F.col("b")
    named = F.when(b["kind"] == "primary", F.concat(F.lit("matched primary name "), quoted(b["value"]))).otherwise(F.concat(F.lit("matched alias "), quoted(b["value"]), F.lit(" ("), b["kind"], F.lit(")")))
    graded = F.concat(quoted(b["value"]), F.lit(" is graded a low-quality alias by its publisher"))
    reasons = F.filter(F.array(reason("name", named, 100 * b["raw"]), F.when(b["penalty"] != 0, reason("alias_quality", graded, b["penalty"]))), lambda r: r.isNotNull())
    best = best.withColumn("reasons", F.concat(reasons, "adjustments")).withColumn("sum", total(F.col("reasons")))
    capped = F.least(F.greatest(F.col("sum"), F.lit(0.0)), F.lit(100.0))
    clamp = reason("clamp", F.concat(F.col("sum").cast("string"), F.when(capped == 0, " raised").otherwise(" capped"), F.lit(" to "), capped.cast("string")), capped - F.col("sum"))
    best = best.withColumn("explanation", F.when(capped == F.col("sum"), F.col("reasons")).otherwise(F.concat("reasons", F.array(clamp))))
    best = best.withColumn("score", total(F.col("explanation"))).where(F.col("score") >= F.col("cutoff"))
    return best.select("qid", "eid", "cutoff", "score", b["value"].alias("matched_name"), b["kind"].alias("matched_kind"), "explanation")


def penalties(explanation: Column) -> Column:
    return F.filter(explanation, lambda r: r["contribution"] < 0)
