"""The two lists of the U.S. Treasury: three headerless tables joined on a number, and remarks in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.operators.changes import column_shape, orphans
from veritrace.schema import ADDRESS, IDENTIFIER, NAME, clean
from veritrace.sources.delimited import DelimitedTable
from veritrace.sources.registry import SOURCES, Adapter, Definition, Parsed
from veritrace.sources.remarks import composed, read_remarks

#: The tables' columns, the null sign, types, and columns that go to the remarks.
PRIMARY = ("ent_num", "sdn_name", "sdn_type", "program", "title", "call_sign", "vessel_type", "tonnage", "gross_registered_tonnage", "vessel_flag", "vessel_owner", "remarks")
ALT = ("ent_num", "alt_num", "alt_type", "alt_name", "alt_remarks")
ADD = ("ent_num", "add_num", "address", "city_state_province_postal_code", "country", "add_remarks")
TYPES = ("individual", "vessel", "aircraft")
IN_REMARKS = {"title": "Title", "vessel_type": "Vessel type", "tonnage": "Tonnage", "gross_registered_tonnage": "GRT", "vessel_flag": "Vessel flag", "vessel_owner": "Vessel owner"}
#: The sub-lists of the consolidated list, the programs that name them, and the one that two of them share.
LISTS = {
    "ssi": "Sectoral Sanctions Identifications List", "cmic": "Non-SDN CMIC List", "ns_plc": "Non-SDN Palestinian Legislative Council List", "ns_mbs": "Non-SDN Menu-Based Sanctions List", "capta": "CAPTA List", "fse": "FSE List",
}
PROGRAMS = {
    "UKRAINE-EO13662": "ssi", "UKRAINE-EO13685": "ssi", "VENEZUELA-EO13850": "ssi", "IRAN-CON-ARMS-EO": "ssi", "CMIC-EO13959": "cmic", "NS-PLC": "ns_plc", "HKAA": "ns_mbs", "CAATSA - RUSSIA": "ns_mbs", "BURMA-EO14014": "ns_mbs",
    "ILLICIT-DRUGS-EO14059": "ns_mbs", "561-Related": "capta", "CAPTA": "capta", "FSE-IR": "fse", "FSE-SY": "fse",
}
SHARED, WITH, ALONE = "RUSSIA-EO14024", "ssi", "ns_mbs"


def table(columns: tuple[str, ...]) -> DelimitedTable:
    return DelimitedTable(columns=columns, null="-0-", encoding="windows-1252")


def program_codes(program: Column) -> Column:
    codes = F.transform(F.split(program, r"\]\s*\["), lambda x: F.trim(F.translate(x, "[]", "")))
    return F.coalesce(F.filter(codes, lambda x: x != ""), F.array().cast("array<string>"))


def sub_lists(programs: Column) -> Column:
    """The names of the sub-lists that a record's programs put it on."""
    of = F.create_map(*[F.lit(x) for pair in PROGRAMS.items() for x in pair])
    certain = F.array_distinct(F.array_compact(F.transform(programs, lambda p: of[p])))
    shared = F.when(F.array_contains(programs, SHARED), F.array(F.when(F.array_contains(certain, WITH), F.lit(WITH)).otherwise(F.lit(ALONE)))).otherwise(F.array().cast("array<string>"))
    names = F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair])
    return F.transform(F.array_union(certain, shared), lambda k: names[k])


class Treasury(Adapter):
    """Records of the primary table with their aliases and addresses; what the remarks say of dates, nations, aliases and papers."""

    def extra(self) -> dict[str, Column]:
        return {}

    def noted(self, rows: DataFrame) -> DataFrame | None:
        return None

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        main, alt, add = self.definition.files
        (primary, w1), (aliases, w2), (places, w3) = (table(c).read(spark, paths[f]) for c, f in ((PRIMARY, main), (ALT, alt), (ADD, add)))
        kind = F.lower("alt_type")
        alias = F.struct(F.col("alt_name").alias("value"), F.when(kind.isin("aka", "fka", "nka"), kind).otherwise("aka").alias("kind"), F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("script"))
        place = F.struct(F.col("address").alias("street"), F.col("city_state_province_postal_code").alias("city"), F.lit(None).cast("string").alias("state_province"), F.lit(None).cast("string").alias("postal_code"), "country", F.col("add_remarks").alias("note"))

        def children(rows: DataFrame, value: Column, name: str) -> DataFrame:
            kept = rows.where(F.col("ent_num").isNotNull()).groupBy("ent_num").agg(F.array_sort(F.collect_list(F.struct("line", value.alias("v")))).alias("all"))
            return kept.select("ent_num", F.transform("all", lambda x: x["v"]).alias(name))

        rows = primary.join(children(aliases.where(F.col("alt_name").isNotNull()), alias, "aliases"), "ent_num", "left").join(children(places, place, "places"), "ent_num", "left")
        rows = rows.withColumns({"read": read_remarks(F.col("remarks")), "programs": program_codes(F.col("program"))}).cache()
        none = lambda t: F.array().cast(f"array<{t.simpleString()}>")
        first = F.struct(F.col("sdn_name").alias("value"), F.lit("primary").alias("kind"), F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("script"))
        published = F.concat(F.array(first), F.coalesce("aliases", none(NAME)))
        key = lambda x: F.regexp_replace(F.upper(x["value"]), r"(?U)[^\p{IsAlphabetic}\p{IsDigit}\p{M}]+", "")
        seen = F.transform(published, key)
        names = F.concat(published, F.filter(F.col("read.aliases"), lambda x: ~F.array_contains(seen, key(x))))
        sign = F.when(F.col("call_sign").isNotNull(), F.array(F.struct(
            F.lit("other").alias("kind"), F.col("call_sign").alias("value"), F.lit(None).cast("string").alias("normalized_value"), F.lit(None).cast("string").alias("country"),
            F.lit(None).cast(IDENTIFIER["issued_on"].dataType).alias("issued_on"), F.lit(None).cast(IDENTIFIER["expires_on"].dataType).alias("expires_on"), F.lit("call sign").alias("note"))))
        given = F.lower("sdn_type")
        fields = {label: F.array(F.col(c)) for c, label in IN_REMARKS.items()}
        entities = rows.where(F.col("sdn_name").isNotNull()).select(
            F.lit(self.definition.key).alias("source"), F.col("ent_num").alias("source_ref"), F.when(given.isin(*TYPES), given).otherwise("organization").alias("type"), names.alias("names"),
            F.coalesce("places", none(ADDRESS)).alias("addresses"), F.array_distinct(F.concat(F.coalesce(sign, none(IDENTIFIER)), F.col("read.identifiers"))).alias("identifiers"),
            F.array_distinct("read.dates_of_birth").alias("dates_of_birth"), F.array_distinct("read.nationalities").alias("nationalities"), "programs", composed(F.col("remarks"), {**fields, **self.extra()}).alias("remarks"),
        )
        warned = lambda df, message: df.select("line", message.alias("message"), F.lit(None).cast("string").alias("snippet"))
        quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
        unknown = warned(rows.where(F.col("sdn_type").isNotNull() & ~given.isin(*TYPES)), F.concat(F.lit("unknown SDN_Type "), quoted(F.col("sdn_type")), F.lit("; treated as an organization")))
        nameless = warned(rows.where(F.col("sdn_name").isNull()), F.concat(F.lit("row "), quoted(F.col("ent_num")), F.lit(" has no SDN_Name and was skipped")))
        warnings = w1.unionByName(w2).unionByName(w3).unionByName(unknown).unionByName(nameless)
        if (more := self.noted(rows)) is not None:
            warnings = warnings.unionByName(warned(rows.join(more, "line"), F.col("note")))
        numeric = column_shape(primary, F.col("ent_num"), F.col("ent_num").rlike("^[0-9]+$"), order=F.col("line")).select(F.lit("ent_num").alias("name"), F.lit("numeric").alias("description"), "*")
        known = column_shape(primary, F.col("sdn_type"), allowing=list(TYPES), at_least=0.75, order=F.col("line")).select(F.lit("sdn_type").alias("name"), F.lit("a published SDN_Type").alias("description"), "*")
        lost = {"aliases": orphans(primary, aliases, "ent_num"), "addresses": orphans(primary, places, "ent_num")}
        return Parsed(entities, warnings, lost, rows.select("read.*"), numeric.unionByName(known))


class TreasurySdn(Treasury):
    definition = Definition("ofac_sdn", "us", "U.S. Department of the Treasury, Office of Foreign Assets Control", "csv", ("sdn", "alt", "add"), {"remarks_coverage": 0.90})


class TreasuryConsolidated(Treasury):
    definition = Definition("ofac_consolidated", "us", "U.S. Department of the Treasury, Office of Foreign Assets Control", "csv", ("prim", "alt", "add"), {"remarks_coverage": 0.75})

    def extra(self) -> dict[str, Column]:
        return {"Consolidated list": sub_lists(F.col("programs"))}

    def noted(self, rows: DataFrame) -> DataFrame:
        text = F.concat(F.lit('row "'), F.col("ent_num"), F.lit('" carries no program naming a consolidated sub-list ('), F.array_join("programs", ", "), F.lit("); it is on none this adapter knows"))
        return rows.where(F.size(sub_lists(F.col("programs"))) == 0).select("line", text.alias("note"))


SOURCES.register(TreasurySdn())
SOURCES.register(TreasuryConsolidated())

__all__ = ["Treasury", "TreasuryConsolidated", "TreasurySdn", "clean", "program_codes", "sub_lists"]
