"""Profiles of list versions and the findings of a checkup against an earlier profile.

A profile is one long table (source, kind, name, value, size, detail), so that checks are joins and CASE expressions over it:
kind count (records by type and all), fill (share of records with a field, of the records that can have it), warnings (rows by
message shape), orphans (child rows by file), coverage (of remarks), unrecognized (by shape) and column (share of matching values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrace.functions.fold import TYPES
from veritrace.operators.changes import shapes

PROFILE = "source string, kind string, name string, value double, size long, detail string"
SEVERITIES = ("info", "warn", "error")
#: The fields whose filling is measured, the records that can have them, and how findings name both.
FIELDS = {"names": "all", "aliases": "all", "addresses": "all", "identifiers": "all", "programs": "all", "remarks": "all", "dates_of_birth": "individual", "nationalities": "individual"}
COHORTS = {"all": "records", "individual": "individuals", "organization": "organizations", "vessel": "vessels", "aircraft": "aircraft"}
PHRASES = {"names": "a name", "aliases": "an alternate name", "addresses": "an address", "identifiers": "an identifier", "programs": "a program", "remarks": "remarks", "dates_of_birth": "a date of birth", "nationalities": "a nationality"}


def present(field: str) -> Column:
    if field == "aliases":
        return F.exists("names", lambda x: x["kind"] != "primary")
    return F.coalesce(F.col("remarks") != "", F.lit(False)) if field == "remarks" else F.size(field) > 0


def measure(entities: DataFrame, source: str, *, warnings: DataFrame | None = None, orphans: dict[str, int] | None = None, coverage: float | None = None, unrecognized: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """The profile of one version. warnings: a column `message`; unrecognized: (shape, n); columns: (name, ratio, at_least, checked,
    description). What is not given is not measured."""
    spark = entities.sparkSession
    counts = [F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t}") for t in TYPES] + [F.count("*").alias("n_all")]
    filled = [F.count(F.when(present(f) & (F.lit(True) if c == "all" else F.col("type") == c), 1)).alias(f"f_{f}") for f, c in FIELDS.items()]
    one = entities.agg(*counts, *filled)  # one pass over the records
    row = lambda kind, name, value, size, detail=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(name).alias("name"), value.cast("double").alias("value"), size.cast("long").alias("size"), F.lit(detail).cast("string").alias("detail")
    )
    rows = [row("count", c, F.col(f"n_{c}"), F.col("n_all")) for c in COHORTS]
    rows += [row("fill", f, F.round(F.try_divide(f"f_{f}", f"n_{c}"), 4), F.col(f"n_{c}")) for f, c in FIELDS.items()]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(source).alias("source"), "r.*").where(F.col("value").isNotNull())
    if warnings is not None:
        out = out.unionByName(shapes(warnings, F.col("message")).select(F.lit(source).alias("source"), F.lit("warnings").alias("kind"), F.col("shape").alias("name"), F.col("n").cast("double").alias("value"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("detail")))
    more = [(source, "orphans", k, float(n), None, None) for k, n in (orphans or {}).items()]
    more += [(source, "coverage", "remarks", round(coverage, 4), None, None)] if coverage is not None else []
    more += [(source, "measured", k, 1.0, None, None) for k, x in (("warnings", warnings), ("orphans", orphans)) if x is not None]
    if more:
        out = out.unionByName(spark.createDataFrame(more, PROFILE))
    if unrecognized is not None:
        top = unrecognized.orderBy(F.desc("n"), "shape").limit(5)
        out = out.unionByName(top.select(F.lit(source).alias("source"), F.lit("unrecognized").alias("kind"), F.col("shape").alias("name"), F.col("n").cast("double").alias("value"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("detail")))
    if columns is not None:
        out = out.unionByName(columns.select(F.lit(source).alias("source"), F.lit("column").alias("kind"), "name", F.col("ratio").cast("double").alias("value"), F.col("checked").cast("long").alias("size"), F.concat_ws("|", F.col("at_least").cast("string"), "description").alias("detail")))
    return out


def percentage(ratio: Column) -> Column:
    value = F.round(ratio * 100, 1)
    return F.concat(F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string")), F.lit("%"))


def number(value: Column) -> Column:
    return F.format_number(value.cast("long"), 0)


def within(now: Column, was: Column, tolerance: float) -> Column:
    return F.when(was == 0, now == was).otherwise(F.abs(now - was) / was <= tolerance)


def _labelled(kind: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in kind.items() for x in pair])[key]


def findings(observed: DataFrame, baseline: DataFrame | None = None, floors: dict[str, float] | None = None, tolerance: float = 0.10) -> DataFrame:
    """(source, severity, check, message, observed, baseline) of each source's profile against its baseline's, or, where there is
    none, against floors by check name; by severity, then check. A version without records has that one finding."""
    spark = observed.sparkSession
    was = (baseline if baseline is not None else spark.createDataFrame([], PROFILE)).select("source", "kind", "name", F.col("value").alias("was"))
    floor = spark.createDataFrame([(k, float(v)) for k, v in (floors or {}).items()], "check string, floor double")
    known = was.where(F.col("kind") == "count").select("source").distinct().withColumn("compared", F.lit(True))
    records = observed.where((F.col("kind") == "count") & (F.col("name") == "all")).select("source", F.greatest(F.col("value"), F.lit(1.0)).alias("records"), (F.col("value") == 0).alias("empty"))
    rows = observed.join(was, ["source", "kind", "name"], "left").join(known, "source", "left").join(records, "source")
    kind, name, now, old = F.col("kind"), F.col("name"), F.col("value"), F.col("was")
    check = F.when(kind == "count", "record_count").when(kind == "fill", F.concat(F.lit("fill_"), name)).when(kind == "coverage", "remarks_coverage").when(kind == "column", F.concat(F.lit("column_"), name)).otherwise(kind)
    rows = rows.withColumn("check", check).join(F.broadcast(floor), "check", "left")
    moved = F.when(now < old, "warn").otherwise("info")
    near, fallen = within(now, old, tolerance), F.col("floor").isNotNull() & (now < F.col("floor"))
    worst = rows.where(kind == "unrecognized").groupBy("source").agg(F.max(F.struct("value", "name")).alias("w"))
    rows = rows.join(worst, "source", "left")
    cohort, phrase = _labelled({f: COHORTS[c] for f, c in FIELDS.items()}, name), _labelled(PHRASES, name)

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    # Counts
    is_count = (kind == "count") & (name == "all")
    share = F.abs(now - old) / old
    count_level = F.when(old.isNull(), F.when(fallen, "warn")).when(~near, moved)
    count_text = F.when(old.isNull(), text(number(now), " records, below the floor of ", number(F.col("floor")))).otherwise(
        text(number(now), " records, was ", number(old), " (", F.when(now < old, "down ").otherwise("up "), percentage(share), ")"))
    # Filling
    fill_level = F.when(old.isNull(), F.when(fallen, "warn")).when((now == 0) & (old > 0), "error").when(~near, moved)
    lost = text("no ", F.regexp_replace(cohort, "s$", ""), " carries ", phrase, " any more, ", percentage(old), " did")
    fill_text = F.when(old.isNull(), text(cohort, " with ", phrase, " ", percentage(now), ", below the floor of ", percentage(F.col("floor")))).when((now == 0) & (old > 0), lost).otherwise(
        text(cohort, " with ", phrase, " ", percentage(now), " (was ", percentage(old), ") of ", number(F.col("size"))))
    # Remarks
    unread = F.when(F.col("w").isNotNull(), text(': "', F.col("w.name"), '" x ', number(F.col("w.value")), " unrecognized")).otherwise("")
    cover_text = text("remarks coverage ", percentage(now), " (", F.when(old.isNull(), text("below the floor of ", percentage(F.col("floor")))).otherwise(text("was ", percentage(old))), ")", unread)
    # Warnings: the five commonest shapes
    rank = F.row_number().over(Window.partitionBy("source", "kind").orderBy(F.desc("value"), "name"))
    rows = rows.withColumn("rank", rank)
    before = F.when(F.col("compared") & F.col("known_warnings"), F.coalesce(old, F.lit(0.0)))
    measured = was.where((F.col("kind") == "measured") & (F.col("name") == "warnings")).select("source", F.lit(True).alias("known_warnings"))
    rows = rows.join(measured, "source", "left")
    warn_level = F.when(now / F.col("records") < tolerance, "info").when(before.isNull() | (before == 0), "warn").otherwise("info")
    history = F.when(before.isNull(), "").when(before == 0, ", new since the last sync").otherwise(text(", was ", number(before)))
    # Columns
    least, described = F.split("detail", r"\|")[0].cast("double"), F.get(F.split("detail", r"\|", 2), F.lit(1))
    column_text = text(name, " ", described, " on ", percentage(now), " of ", number(F.col("size")), " rows, expected ", percentage(least))

    level = F.when(is_count, count_level).when(kind == "fill", fill_level).when(kind == "coverage", fill_level_of_coverage(old, fallen, near, moved)).when((kind == "warnings") & (F.col("rank") <= 5), warn_level)
    level = level.when((kind == "column") & (now < least), "error")
    message = F.when(is_count, count_text).when(kind == "fill", fill_text).when(kind == "coverage", cover_text).when(kind == "warnings", text(name, " (", number(now), " rows", history, ")")).when(kind == "column", column_text)
    compared = F.when(kind == "warnings", before).when(kind == "column", least).otherwise(old)
    found = rows.where(~F.col("empty")).select("source", level.alias("severity"), "check", message.alias("message"), now.alias("observed"), compared.alias("baseline")).where(F.col("severity").isNotNull())

    lost_rows = rows.where((kind == "orphans") & (now > 0) & ~F.col("empty"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", text(number(now), " in ", name).alias("t")))), lambda x: x["t"]), ", ")
    lost_rows = lost_rows.groupBy("source").agg(F.sum("value").alias("observed"), F.sum("was").alias("baseline"), F.first("records").alias("records"), listed.alias("listed"))
    lost_rows = lost_rows.select("source", F.when(F.col("observed") / F.col("records") > tolerance, "warn").otherwise("info").alias("severity"), F.lit("orphans").alias("check"),
                                 text(number(F.col("observed")), " child row(s) matched no record: ", F.col("listed")).alias("message"), "observed", "baseline")
    nothing = rows.where(is_count & F.col("empty")).select("source", F.lit("error").alias("severity"), F.lit("empty").alias("check"), F.lit("parsed to no records at all").alias("message"), F.lit(0.0).alias("observed"), old.alias("baseline"))
    return found.unionByName(lost_rows).unionByName(nothing)


def fill_level_of_coverage(old: Column, fallen: Column, near: Column, moved: Column) -> Column:
    return F.when(old.isNull(), F.when(fallen, "warn")).when(~near, moved)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("source", F.desc(severity_rank(F.col("severity"))), "check", "message")


def report(found: DataFrame, sources: list[str], fail_on: str = "error") -> DataFrame:
    """(source, severity, findings, ok): the worst finding of each source, and whether it is under `fail_on`."""
    if fail_on not in SEVERITIES:
        raise ValueError(f"fail_on is one of {', '.join(SEVERITIES)}")
    all_of = found.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    worst = found.groupBy("source").agg(F.max(severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("findings"))
    out = all_of.join(worst, "source", "left")
    level = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank").cast("int") - 1)
    return out.select("source", level.alias("severity"), F.coalesce("findings", F.lit(0)).alias("findings"), (F.coalesce("rank", F.lit(0)) < SEVERITIES.index(fail_on) + 1).alias("ok"))


def exit_code(reported: DataFrame) -> int:
    return int(not reported.where(~F.col("ok")).isEmpty())


def baseline_of(profile: DataFrame, profile_checksum: str | None, stored_checksum: str | None) -> DataFrame | None:
    """A recorded profile counts as baseline only if it is of the version that is stored."""
    return profile if profile_checksum is not None and profile_checksum == stored_checksum else None


#: Tolerances of the canary's checks; others take the default (fixed values).
CANARY = {"record_count": 0.05, "remarks_coverage": 0.02}


def canary(spark: SparkSession, observed: DataFrame, baseline: DataFrame, default: float = 0.10) -> DataFrame:
    """Findings with each check's own tolerance."""
    parts = [findings(observed, baseline, tolerance=t).where(F.col("check") == c) for c, t in CANARY.items()]
    out = findings(observed, baseline, tolerance=default).where(~F.col("check").isin(*CANARY))
    for p in parts:
        out = out.unionByName(p)
    return out
