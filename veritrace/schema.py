"""The record model: listed entities with nested names, addresses, identifiers and dates, and what queries and results hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .errors import InvalidArgument
from .functions.dates import PDATE
from .functions.fold import TYPES, identifier_form

#: Bumped whenever a score could move; every result carries it.
MATCHER_VERSION = "1"
SCHEMA_VERSION = 2

NAME_KINDS, QUALITIES = ("primary", "aka", "fka", "nka"), ("good", "low")
IDENTIFIER_KINDS = ("passport", "national_id", "tax_id", "registration_number", "other")


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


NAME = StructType(_strings("value", "kind", "quality", "script"))
ADDRESS = StructType(_strings("street", "city", "state_province", "postal_code", "country", "note"))
IDENTIFIER = StructType([*_strings("kind", "value", "normalized_value", "country"), StructField("issued_on", PDATE), StructField("expires_on", PDATE), *_strings("note")])
ENTITY = StructType([
    *_strings("id", "source", "source_ref", "type"), StructField("names", ArrayType(NAME)), StructField("addresses", ArrayType(ADDRESS)),
    StructField("identifiers", ArrayType(IDENTIFIER)), StructField("dates_of_birth", ArrayType(PDATE)), StructField("nationalities", ArrayType(StringType())),
    StructField("programs", ArrayType(StringType())), StructField("listed_on", PDATE), *_strings("remarks"),
])
QUERY = StructType([
    *_strings("qid", "name", "type"), StructField("dates_of_birth", ArrayType(PDATE)), StructField("nationalities", ArrayType(StringType())),
    StructField("identifiers", ArrayType(IDENTIFIER)), StructField("sources", ArrayType(StringType())), StructField("threshold", DoubleType()), StructField("limit", IntegerType()),
])
REASON = StructType([*_strings("factor", "detail"), StructField("contribution", DoubleType())])
WARNING = StructType([StructField("line", LongType()), *_strings("message", "snippet")])
COLLECTIONS = ("names", "addresses", "identifiers", "dates_of_birth", "nationalities", "programs")
SCALARS = ("source", "source_ref", "type", "listed_on", "remarks")


def clean(value: Column) -> Column:
    """Stripped; blank is null."""
    return F.nullif(F.trim(value), F.lit(""))


def conformed(df: DataFrame) -> DataFrame:
    """df with all columns of the model in order: missing ones null or empty, ids made of source and reference, blank names out,
    identifiers with their normal form."""
    have = set(df.columns)
    unknown = have - set(ENTITY.fieldNames())
    if unknown:
        raise InvalidArgument(f"unknown entity column(s): {', '.join(sorted(unknown))}")
    out = []
    for f in ENTITY.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.array().cast(f.dataType)) if isinstance(f.dataType, ArrayType) else c).alias(f.name))
    df = df.select(*out)
    df = df.withColumn("id", F.coalesce(F.col("id"), F.nullif(F.concat_ws(":", "source", "source_ref"), F.lit(""))))
    names = F.transform(F.filter("names", lambda x: clean(x["value"]).isNotNull()), lambda x: x.withField("value", F.trim(x["value"])).withField("kind", F.coalesce(x["kind"], F.lit("primary"))))
    papers = F.transform(
        F.filter("identifiers", lambda x: identifier_form(x["value"]) != ""),
        lambda x: x.withField("value", F.trim(x["value"])).withField("normalized_value", identifier_form(F.trim(x["value"]))).withField("kind", F.coalesce(x["kind"], F.lit("other"))),
    )
    places = F.filter("addresses", lambda x: F.coalesce(*[clean(x[n]) for n in ADDRESS.fieldNames()]).isNotNull())
    return df.withColumns({"names": names, "identifiers": papers, "addresses": places, "type": F.lower("type")})


def invalid(entities: DataFrame) -> DataFrame:
    """(id, problem) of the records that break the model."""
    kinds = lambda a, allowed: F.exists(a, lambda x: ~x["kind"].isin(*allowed))
    problem = F.when(F.col("id").isNull(), "no id").when(F.size("names") == 0, "no name").when(F.col("type").isNull() | ~F.col("type").isin(*TYPES), "unknown type")
    problem = problem.when(kinds("names", NAME_KINDS), "unknown name kind").when(kinds("identifiers", IDENTIFIER_KINDS), "unknown identifier kind")
    return entities.select("id", problem.alias("problem")).where(F.col("problem").isNotNull())


def primary_name(names: Column) -> Column:
    """The first primary name, else the first name."""
    first = F.get(F.filter(names, lambda x: x["kind"] == "primary"), F.lit(0))
    return F.coalesce(first["value"], F.get(names, F.lit(0))["value"])
