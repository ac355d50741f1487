"""Snapshot differences, nested joins and plain profile aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrace.errors import InvalidArgument
from veritrace.functions.fold import message_shape
from veritrace.schema import COLLECTIONS, SCALARS


def nested_left_join(parent: DataFrame, child: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Every parent with the array of its children; a null key has none."""
    kept = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in child.columns if c not in (key, order)]))).alias(name))
    return parent.join(kept, key, "left")


def orphans(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Children whose key no parent has; a child without a key is no orphan."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def _same_columns(before: DataFrame, after: DataFrame) -> None:
    if set(before.columns) != set(after.columns):
        raise InvalidArgument(f"the versions have other columns: {sorted(set(before.columns) ^ set(after.columns))}")


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change, fields): added, removed and modified rows. Keys are distinct on each side; a row without a key is no record."""
    _same_columns(before, after)
    fields = [c for c in before.columns if c != key]
    b = before.where(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("b"), F.lit(True).alias("in_b"))
    a = after.where(F.col(key).isNotNull()).select(key, F.struct(*fields).alias("a"), F.lit(True).alias("in_a"))
    both = b.join(a, key, "full_outer")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(c)) for c in fields]))
    kind = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(F.size(moved) > 0, "modified")
    listed = F.when(kind == "modified", F.array_join(moved, ",")).otherwise("")
    return both.select(key, kind.alias("change"), listed.alias("fields")).where(F.col("change").isNotNull())


def first_of_each(entities: DataFrame) -> DataFrame:
    """Of records of one id the first, by reference and content."""
    order = Window.partitionBy("id").orderBy("source_ref", F.to_json(F.struct(*[F.col(c) for c in entities.columns])))
    return entities.where(F.col("id").isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")


def _identity(field: str, x: Column) -> Column:
    """What makes two elements of a list the same: identifiers compare by kind, normal form and country."""
    return F.struct(x["kind"], x["normalized_value"], F.lower(x["country"])) if field == "identifiers" else x


def list_changes(field: str, before: Column, after: Column) -> tuple[Column, Column]:
    """Added and removed elements; another order is no change."""

    def less(a: Column, b: Column) -> Column:
        keys = F.transform(b, lambda y: _identity(field, y))
        return F.filter(a, lambda x: ~F.exists(keys, lambda k: k.eqNullSafe(_identity(field, x))))

    return less(after, before), less(before, after)


def entity_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, source, change, fields, details, previous, current) of two versions of one source's entities, by id. details: per field
    the JSON of {from, to}, or of {added, removed}."""
    _same_columns(before, after)
    fields = [c for c in before.columns if c != "id"]
    whole = F.struct(*[F.col(c) for c in before.columns])
    b = first_of_each(before).select("id", whole.alias("previous"))
    a = first_of_each(after).select("id", whole.alias("current"))
    both = b.join(a, "id", "full_outer")
    details = []
    for c in fields:
        x, y = F.col(f"previous.{c}"), F.col(f"current.{c}")
        if c in COLLECTIONS:
            added, removed = list_changes(c, x, y)
            moved, text = (F.size(added) > 0) | (F.size(removed) > 0), F.to_json(F.struct(added.alias("added"), removed.alias("removed")))
        else:
            moved, text = ~x.eqNullSafe(y), F.to_json(F.struct(x.alias("from"), y.alias("to")))
        details.append(F.when(moved, F.struct(F.lit(c).alias("field"), text.alias("detail"))))
    moved = F.when(F.col("previous").isNotNull() & F.col("current").isNotNull(), F.array_compact(F.array(*details)))
    both = both.withColumn("moved", F.coalesce(moved, F.array().cast("array<struct<field:string,detail:string>>")))
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").when(F.size("moved") > 0, "modified")
    out = both.withColumn("change", kind).where(F.col("change").isNotNull())
    source = F.coalesce("current.source", "previous.source")
    listed = F.transform("moved", lambda m: m["field"])
    return out.select("id", source.alias("source"), "change", listed.alias("fields"), F.map_from_arrays(listed, F.transform("moved", lambda m: m["detail"])).alias("details"), "previous", "current")


def snapshot_diff(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """entity_diff of two stored versions. Without an earlier one this is the baseline: nothing has changed."""
    if before is None:
        return entity_diff(after.limit(0), after.limit(0))
    sources = [{r["source"] for r in df.select("source").distinct().limit(2).collect()} for df in (before, after)]
    if any(len(s) > 1 for s in sources) or all(sources) and sources[0] != sources[1]:
        raise InvalidArgument(f"a diff is of two versions of one source, not of {sorted(map(str, sources[0] | sources[1]))}")
    return entity_diff(before, after)


def summary(changes: DataFrame, limit: int = 20) -> list[str]:
    """Lines for people: the changed ids in order with their fields, and how many more there are."""
    rows = changes.select("id", "change", F.array_join("fields", ", ").alias("f")).orderBy("id").limit(limit + 1).collect()
    lines = [f"{r['change']} {r['id']}" + (f": {r['f']}" if r["f"] else "") for r in rows[:limit]]
    return lines + ([f"... and {changes.count() - limit} more"] if len(rows) > limit else [])


def churn(changes: DataFrame, before: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("changed")).crossJoin(before.agg(F.count("*").alias("previous"))).select("changed", "previous", F.round(F.try_divide("changed", "previous"), 6).alias("churn"))


def fill_rates(df: DataFrame, cohort: str, fields: dict[str, Column]) -> DataFrame:
    """Share of rows with each field, by cohort and over all (cohort ``all``)."""
    rows = df.select(F.coalesce(F.col(cohort).cast("string"), F.lit("")).alias("cohort"), *[c.cast("double").alias(k) for k, c in fields.items()])
    by = rows.rollup("cohort").agg(F.count("*").alias("n"), *[F.round(F.avg(k), 4).alias(k) for k in fields])
    return by.select(F.coalesce("cohort", F.lit("all")).alias("cohort"), "n", *fields)


def column_shape(df: DataFrame, value: Column, matches: Column | None = None, *, allowing: list[str] | None = None, at_least: float = 0.99, sample: int = 3, order: Column | None = None) -> DataFrame:
    """(checked, matched, blank, ratio, at_least, ok, sample) of a column that should match, or hold one of some values in any case.
    sample: the first offenders, by `order` where it is given."""
    if (matches is None) == (allowing is None):
        raise InvalidArgument("a column shape needs one of matches and allowing")
    if not 0 <= at_least <= 1:
        raise InvalidArgument("at_least is a share between 0 and 1")
    text = F.trim(value.cast("string"))
    fits = F.lower(text).isin(*[x.strip().lower() for x in allowing]) if allowing is not None else matches
    full = F.coalesce(text, F.lit("")) != ""
    place = F.struct((order if order is not None else text).alias("o"), text.alias("v"))
    rows = df.select(full.alias("full"), F.coalesce(fits, F.lit(False)).alias("fits"), place.alias("p"))
    tally = rows.agg(F.count(F.when(F.col("full"), 1)).alias("checked"), F.count(F.when(F.col("full") & F.col("fits"), 1)).alias("matched"), F.count(F.when(~F.col("full"), 1)).alias("blank"))
    ratio = F.when(F.col("checked") == 0, 1.0).otherwise(F.try_divide("matched", "checked"))
    odd = rows.where(F.col("full") & ~F.col("fits")).orderBy("p").limit(sample).agg(F.array_sort(F.collect_list("p")).alias("s")).select(F.transform("s", lambda p: p["v"]).alias("sample"))
    return tally.select("checked", "matched", "blank", F.round(ratio, 4).alias("ratio"), F.lit(at_least).alias("at_least"), (ratio >= at_least).alias("ok")).crossJoin(odd)


def shapes(df: DataFrame, line: Column) -> DataFrame:
    """(shape, n): lines with digits masked, white space squeezed, cut after 100 characters."""
    return df.select(message_shape(line).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


def top_shapes(df: DataFrame, line: Column, limit: int = 5) -> DataFrame:
    return shapes(df, line).orderBy(F.desc("n"), "shape").limit(limit)


def confirmed(now: DataFrame, before: DataFrame, keys: tuple[str, ...] = ("source", "check")) -> DataFrame:
    """Findings that two runs in a row made."""
    return now.join(before.select(*keys).distinct(), list(keys), "left_semi")


__all__ = ["SCALARS", "churn", "column_shape", "confirmed", "diff", "entity_diff", "fill_rates", "first_of_each", "list_changes", "nested_left_join", "orphans", "shapes", "snapshot_diff", "summary", "top_shapes"]
