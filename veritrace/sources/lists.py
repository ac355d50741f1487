"""Lists in XML (United Nations, Canada, European Union, United Kingdom) and in a workbook (Australia)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from veritrace.errors import ParseError
from veritrace.functions.dates import PDATE, parse_date, partial_date, point_date
from veritrace.functions.fold import collapsed
from veritrace.schema import ADDRESS, IDENTIFIER, NAME
from veritrace.sources.registry import SOURCES, Adapter, Definition, Parsed, no_warnings
from veritrace.sources.remarks import composed
from veritrace.sources.spreadsheet import read_sheet
from veritrace.sources.xml import fields, inside, read_records, roots, text, texts

READ_DATES = StructType([StructField("dates", ArrayType(PDATE)), StructField("unread", ArrayType(StringType()))])


def date_reader(read: Callable[[str], list[dict]]):
    """A function of arrays of texts: the distinct dates that `read` finds, and the texts in which it finds none."""

    @F.pandas_udf(READ_DATES)
    def dates(lists: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in lists:
            found, unread = [], []
            for values in s:
                own, rest = [], []
                for v in values if values is not None else []:
                    got = read(v)
                    own += [d for d in got if d not in own]
                    rest += [] if got else [v]
                found.append(own)
                unread.append(rest)
            yield pd.DataFrame({"dates": pd.Series(found, dtype=object), "unread": pd.Series(unread, dtype=object)})

    return dates


def one_date(value: str) -> list[dict]:
    found = parse_date(value)
    return [found] if found else []


spelled_dates = date_reader(one_date)


def struct_of(shape: StructType, /, **values: Column) -> Column:
    return F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])


def name_of(value: Column, kind="aka", quality: Column | None = None) -> Column:
    return struct_of(NAME, value=value, kind=kind if isinstance(kind, Column) else F.lit(kind), quality=F.lit(None) if quality is None else quality)


def looked_up(table: dict[str, str], value: Column, default: str | None = None) -> Column:
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(F.trim(value))]
    return found if default is None else F.coalesce(found, F.lit(default))


def first_spellings(names: Column) -> Column:
    """Of names of one value the first."""
    return F.filter(names, lambda x, i: ~F.exists(F.slice(names, F.lit(1), i), lambda y: y["value"] == x["value"]))


def joined(*parts: Column, by: str = " ") -> Column:
    return F.nullif(F.array_join(F.array_compact(F.array(*[text(p) for p in parts])), by), F.lit(""))


def papers_with_dates(papers: Column) -> Column:
    """Identifiers whose dates are texts so far, without those that have no value."""
    return F.filter(papers, lambda x: text(x["value"]).isNotNull())


# United Nations

UN_FIELDS = (
    "DATAID VERSIONNUM FIRST_NAME SECOND_NAME THIRD_NAME FOURTH_NAME UN_LIST_TYPE* REFERENCE_NUMBER LISTED_ON GENDER NAME_ORIGINAL_SCRIPT COMMENTS1 "
    "NATIONALITY[VALUE*] TITLE[VALUE*] DESIGNATION[VALUE*] {k}_ALIAS[QUALITY ALIAS_NAME] {k}_ADDRESS[STREET CITY STATE_PROVINCE ZIP_CODE COUNTRY NOTE] "
    "{k}_DATE_OF_BIRTH[TYPE_OF_DATE DATE YEAR FROM_YEAR TO_YEAR] {k}_PLACE_OF_BIRTH[STREET CITY STATE_PROVINCE COUNTRY NOTE] "
    "{k}_DOCUMENT[TYPE_OF_DOCUMENT TYPE_OF_DOCUMENT2 NUMBER ISSUING_COUNTRY COUNTRY_OF_ISSUE CITY_OF_ISSUE DATE_OF_ISSUE DATE_OF_EXPIRY NOTE]"
)
#: Fixed values.
UN_PAPERS = {"passport": "passport", "numéro de passeport": "passport", "número de pasaporte": "passport", "national identification number": "national_id"}


def dated_papers(rows, papers: Column):
    """rows with `identifiers` of papers whose issued_on and expires_on are texts."""
    rows = rows.withColumn("_p", papers).withColumn("_i", spelled_all(F.transform("_p", lambda x: x["issued_on"]))).withColumn("_e", spelled_all(F.transform("_p", lambda x: x["expires_on"])))
    full = F.transform("_p", lambda x, i: struct_of(IDENTIFIER, kind=x["kind"], value=x["value"], country=x["country"], issued_on=F.get("_i", i), expires_on=F.get("_e", i), note=x["note"]))
    return rows.withColumn("identifiers", full).drop("_p", "_i", "_e").cache()  # what Python has read stands by itself


@F.pandas_udf(ArrayType(PDATE))
def spelled_all(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The date of each text, null where there is none."""
    for s in lists:
        yield pd.Series([None if x is None else [parse_date(v) for v in x] for x in s], dtype=object)


class UnitedNations(Adapter):
    definition = Definition("un_consolidated", "un", "United Nations Security Council", "xml")

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        version = roots(spark, paths["main"]).first()["attributes"].get("dateGenerated")
        parts = [self.records(spark, paths["main"], tag, kind) for tag, kind in (("INDIVIDUAL", "individual"), ("ENTITY", "organization"))]
        return Parsed(parts[0].unionByName(parts[1]), no_warnings(spark), source_version=version)

    def records(self, spark: SparkSession, path: str, tag: str, kind: str):
        rows = read_records(spark, path, tag, fields(UN_FIELDS.format(k=tag)))
        many = lambda suffix: F.coalesce(F.col(f"{tag}_{suffix}"), F.array())
        published, script = joined(*[F.col(f"{n}_NAME") for n in ("FIRST", "SECOND", "THIRD", "FOURTH")]), text(F.col("NAME_ORIGINAL_SCRIPT"))
        quality = lambda x: looked_up({"good": "good", "low": "low"}, x["QUALITY"])
        aliases = F.transform(F.filter(many("ALIAS"), lambda x: text(x["ALIAS_NAME"]).isNotNull()), lambda x: name_of(text(x["ALIAS_NAME"]), looked_up({"a.k.a.": "aka", "f.k.a.": "fka", "n.k.a.": "nka"}, x["QUALITY"], "aka"), quality(x)))
        names = F.concat(F.filter(F.array(name_of(published, "primary"), name_of(script)), lambda x: x["value"].isNotNull()), aliases)

        def born(x: Column) -> Column:
            spell = F.coalesce(text(x["DATE"]), text(x["YEAR"]))
            between = F.concat(text(x["FROM_YEAR"]), F.lit(" to "), text(x["TO_YEAR"]))
            return F.when(F.upper(x["TYPE_OF_DATE"]) == "BETWEEN", between).when(F.upper(x["TYPE_OF_DATE"]) == "APPROXIMATELY", F.concat(F.lit("circa "), spell)).otherwise(spell)

        note = lambda x: joined(x["TYPE_OF_DOCUMENT2"], x["CITY_OF_ISSUE"], x["NOTE"], by="; ")
        paper = lambda x: F.struct(looked_up(UN_PAPERS, collapsed(x["TYPE_OF_DOCUMENT"]), "other").alias("kind"), text(x["NUMBER"]).alias("value"), F.coalesce(text(x["ISSUING_COUNTRY"]), text(x["COUNTRY_OF_ISSUE"])).alias("country"),
                                   x["DATE_OF_ISSUE"].alias("issued_on"), x["DATE_OF_EXPIRY"].alias("expires_on"), note(x).alias("note"))
        place = lambda x: struct_of(ADDRESS, street=text(x["STREET"]), city=text(x["CITY"]), state_province=text(x["STATE_PROVINCE"]), postal_code=text(x["ZIP_CODE"]), country=text(x["COUNTRY"]), note=text(x["NOTE"]))
        values = lambda c: texts(F.flatten(F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.coalesce(x["VALUE"], F.array().cast("array<string>")))))
        birthplaces = F.transform(many("PLACE_OF_BIRTH"), lambda x: joined(x["STREET"], x["CITY"], x["STATE_PROVINCE"], x["COUNTRY"], x["NOTE"], by=", "))
        extras = {"Version": F.array("VERSIONNUM"), "Reference": F.array("REFERENCE_NUMBER"), "Gender": F.array("GENDER"), "Title": values("TITLE"), "Designation": values("DESIGNATION"), "Place of birth": birthplaces}
        rows = dated_papers(rows, papers_with_dates(F.transform(many("DOCUMENT"), paper)))
        rows = rows.withColumn("births", spelled_dates(F.filter(F.transform(many("DATE_OF_BIRTH"), born), lambda x: x.isNotNull()))).cache()
        return rows.where(F.size(names) > 0).select(
            F.lit("un_consolidated").alias("source"), text(F.col("DATAID")).alias("source_ref"), F.lit(kind).alias("type"), names.alias("names"), F.transform(many("ADDRESS"), place).alias("addresses"), "identifiers",
            F.col("births.dates").alias("dates_of_birth"), values("NATIONALITY").alias("nationalities"), texts(F.col("UN_LIST_TYPE")).alias("programs"), partial_date("LISTED_ON").alias("listed_on"), composed(F.col("COMMENTS1"), extras).alias("remarks"),
        )


# Canada

#: Elements of a record.
CA = {
    "country": "Country-Pays", "last": "LastName-NomDeFamille", "given": "GivenName-Prenom", "entity": "EntityOrShip-EntiteOuNavire", "aliases": "Aliases-Alias", "title": "TitleOrShipType-TitreOuTypeDeNavire",
    "imo": "ShipIMONumber-NumeroOMIDuNavire", "born": "DateOfBirthOrShipBuildDate-DateDeNaissanceOuDateDeConstructionDuNavire", "schedule": "Schedule-Annexe", "item": "Item-NumeroDarticle", "listed": "DateOfListing-DateDinscription",
}


def alternatives(value: str) -> list[dict]:
    """A date, or the dates of "a or b" and "a / b"."""
    return one_date(value) or [d for part in re.split(r"\s+or\s+|\s*/\s*", value, flags=re.I) for d in one_date(part)]


alternative_dates = date_reader(alternatives)


class Canada(Adapter):
    definition = Definition("canada_sema", "ca", "Global Affairs Canada", "xml")

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        roots(spark, paths["main"]).collect()  # one row a document: refuses broken ones
        raw = read_records(spark, paths["main"], "record", fields(" ".join(CA.values())))
        rows = raw.select(*[text(F.col(f"`{name}`")).alias(k) for k, name in CA.items()])
        primary = F.coalesce("entity", joined(F.col("given"), F.col("last")))
        vessel = F.col("imo").isNotNull()
        rows = rows.withColumn("primary", primary).withColumn("kind", F.when(vessel, "vessel").when(F.col("entity").isNull(), "individual").otherwise("organization"))
        key = lambda x: F.lower(F.regexp_replace(x["value"], r"(?U)[^\p{IsAlphabetic}\p{IsDigit}\p{M}]+", ""))
        more = F.transform(texts(F.split("aliases", ";")), lambda x: name_of(x))
        all_names = F.concat(F.array(name_of(F.col("primary"), "primary")), F.coalesce(more, F.array().cast(ArrayType(NAME))))
        names = F.filter(all_names, lambda x, i: ~F.exists(F.slice(all_names, F.lit(1), i), lambda y: key(y) == key(x)))
        ref = F.substring(F.sha2(F.array_join(F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("country", "schedule", "item", "primary")]), "\x00"), 256), 1, 16)
        rows = rows.withColumn("births", alternative_dates(F.when(~vessel & F.col("born").isNotNull(), F.array("born")))).cache()
        number = F.when(vessel, F.array(struct_of(IDENTIFIER, kind=F.lit("registration_number"), value=F.col("imo"), note=F.lit("IMO number"))))
        extras = {"Country": F.array("country"), "Schedule": F.array("schedule"), "Item": F.array("item"), "Vessel type": F.array(F.when(vessel, F.col("title"))), "Title": F.array(F.when(~vessel, F.col("title"))), "Built": F.array(F.when(vessel, F.col("born"))), "Date of birth": F.col("births.unread")}
        program = text(F.get(F.split("country", r"\s*\|\s*|\s+/\s+", 2), F.lit(0)))
        entities = rows.where(F.col("primary").isNotNull()).select(
            F.lit("canada_sema").alias("source"), ref.alias("source_ref"), F.col("kind").alias("type"), names.alias("names"), number.alias("identifiers"), F.col("births.dates").alias("dates_of_birth"),
            F.array_compact(F.array(program)).alias("programs"), partial_date("listed").alias("listed_on"), composed(F.lit(None).cast("string"), extras).alias("remarks"),
        )
        odd = rows.where(F.size("births.unread") > 0)
        message = F.concat(F.lit('"'), F.col("primary"), F.lit('" has a date this parser does not read ("'), F.col("born"), F.lit('"); it was kept in remarks instead'))
        return Parsed(entities, odd.select(F.lit(None).cast("long").alias("line"), message.alias("message"), F.lit(None).cast("string").alias("snippet")))


# European Union

EU_FIELDS = (
    "@euReferenceNumber @designationDate @designationDetails @unitedNationId @logicalId remark subjectType[@code] nameAlias[@wholeName @function @title @gender remark] citizenship[@countryIso2Code @countryDescription] "
    "birthdate[@circa @calendarType @city @region @place @countryIso2Code @countryDescription @birthdate @year @monthOfYear @dayOfMonth @yearRangeFrom @yearRangeTo] "
    "identification[@identificationTypeCode @identificationTypeDescription @number @issuedBy @issueDate @validFrom @validTo @region @countryIso2Code @countryDescription @knownFalse @knownExpired @revokedByIssuer @reportedLost @diplomatic remark] "
    "address[@street @city @region @zipCode @poBox @place @asAtListingTime @countryIso2Code @countryDescription remark contactInfo[@key @value]] regulation[@programme @numberTitle publicationUrl]"
)
#: Fixed values.
EU_PAPERS = {"passport": "passport", "id": "national_id", "ssn": "national_id", "unssn": "national_id", "fiscalcode": "tax_id", "taxid": "tax_id", "euvat": "tax_id", "regnumber": "registration_number", "tradelic": "registration_number"}
EU_FLAGS = {"_knownFalse": "known false", "_knownExpired": "known expired", "_revokedByIssuer": "revoked by issuer", "_reportedLost": "reported lost", "_diplomatic": "diplomatic"}
CLAUSE = r"(?iU)(?:^|[\n;])[\s(\"'‘]*"


def eu_country(x: Column) -> Column:
    name = text(x["_countryDescription"])
    return F.when((F.coalesce(x["_countryIso2Code"], F.lit("")) == "00") | (name == "UNKNOWN"), None).otherwise(name)


class EuropeanUnion(Adapter):
    definition = Definition("eu_fsf", "eu", "European Commission", "xml")

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        root = roots(spark, paths["main"]).first()["attributes"]
        rows = read_records(spark, paths["main"], "sanctionEntity", fields(EU_FIELDS))
        many = lambda c: F.coalesce(F.col(c), F.array())
        says = lambda x, words: F.coalesce(x["remark"], F.lit("")).rlike(CLAUSE + f"(?:{words})")
        graded = lambda x: F.when(says(x, r"low\s+quality\s+(?:alias|a\.k\.a)"), "low").when(says(x, r"(?:good|high)\s+quality\s+(?:alias|a\.k\.a)"), "good")
        former = lambda x: F.when(says(x, r"formerly\s+known\s+as|former\s+name|f\.k\.a|maiden\s+name"), "fka").otherwise("aka")
        named = F.filter(many("nameAlias"), lambda x: text(x["_wholeName"]).isNotNull())
        rows = rows.withColumn("_names", F.transform(named, lambda x: name_of(text(x["_wholeName"]), former(x), graded(x))))
        rows = rows.withColumn("_names", first_spellings(F.col("_names")))
        # The first ungraded alias becomes the primary name; the first name where there is none.
        places = F.transform("_names", lambda x, i: F.when((x["kind"] == "aka") & x["quality"].isNull(), i))
        chosen = F.coalesce(F.array_min(F.array_compact(places)), F.lit(0))
        names = F.transform("_names", lambda x, i: F.when(i == chosen, x.withField("kind", F.lit("primary"))).otherwise(x))

        def born(x: Column) -> Column:
            two = lambda v: F.lpad(v, 2, "0")
            day = F.concat_ws("-", x["_year"], two(x["_monthOfYear"]), F.when(x["_monthOfYear"].isNotNull(), two(x["_dayOfMonth"])))
            span = F.concat(x["_yearRangeFrom"], F.lit(" to "), x["_yearRangeTo"])
            spelled = F.coalesce(F.when(x["_year"].isNotNull(), day), span)
            about = F.when(x["_circa"] == "true", F.concat(F.lit("circa "), spelled)).otherwise(spelled)
            published = F.concat_ws(" ", x["_birthdate"], x["_year"], F.when(x["_yearRangeFrom"].isNotNull() | x["_yearRangeTo"].isNotNull(), F.concat(F.coalesce(x["_yearRangeFrom"], F.lit("?")), F.lit(" to "), F.coalesce(x["_yearRangeTo"], F.lit("?")))))
            calendar = F.coalesce(x["_calendarType"], F.lit(""))
            other = F.concat(published, F.lit(" ("), F.lower(calendar), F.lit(" calendar)"))
            return F.struct(F.when(calendar == "GREGORIAN", about).otherwise(x["_birthdate"]).alias("spelled"), F.when(published != "", F.when(calendar == "GREGORIAN", published).otherwise(other)).alias("published"))

        rows = rows.withColumn("_born", F.transform(many("birthdate"), born)).withColumn("_dates", spelled_all(F.transform("_born", lambda x: x["spelled"]))).cache()
        dates = F.array_distinct(F.array_compact("_dates"))
        unread = F.array_compact(F.transform("_born", lambda x, i: F.when(F.get("_dates", i).isNull(), x["published"])))
        flags = lambda x: [F.when(x[a] == "true", F.lit(label)) for a, label in EU_FLAGS.items()]
        paper = lambda x: F.struct(looked_up(EU_PAPERS, x["_identificationTypeCode"], "other").alias("kind"), text(x["_number"]).alias("value"), eu_country(x).alias("country"), F.coalesce(x["_issueDate"], x["_validFrom"]).alias("issued_on"),
                                   x["_validTo"].alias("expires_on"), joined(x["_identificationTypeDescription"], x["_issuedBy"], x["_region"], x["remark"], *flags(x), by="; ").alias("note"))
        rows = dated_papers(rows, papers_with_dates(F.transform(many("identification"), paper)))
        contacts = lambda x: F.array_join(F.transform(F.coalesce(x["contactInfo"], F.array()), lambda c: F.concat(c["_key"], F.lit(": "), c["_value"])), "; ")
        note = lambda x: joined(F.concat(F.lit("P.O. Box "), x["_poBox"]), x["_place"], x["remark"], contacts(x), F.when(x["_asAtListingTime"] == "true", "as at listing time"), by="; ")
        place = lambda x: struct_of(ADDRESS, street=text(x["_street"]), city=text(x["_city"]), state_province=text(x["_region"]), postal_code=text(x["_zipCode"]), country=eu_country(x), note=note(x))
        attribute = lambda c, a: F.array_distinct(texts(F.transform(many(c), lambda x: x[a])))
        birthplaces = F.array_distinct(F.transform(many("birthdate"), lambda x: joined(x["_place"], x["_city"], x["_region"], eu_country(x), by=", ")))
        regulation = F.get(many("regulation"), F.lit(0))
        extras = {
            "EU logical id": F.array("_logicalId"), "UN reference": F.array("_unitedNationId"), "Designation details": F.array("_designationDetails"), "Regulation": F.array(regulation["_numberTitle"]), "Official Journal": F.array(regulation["publicationUrl"]),
            "Function": attribute("nameAlias", "_function"), "Title": attribute("nameAlias", "_title"), "Gender": attribute("nameAlias", "_gender"), "Date of birth as published": unread, "Place of birth": birthplaces,
        }
        entities = rows.where(F.size("_names") > 0).select(
            F.lit("eu_fsf").alias("source"), text(F.col("_euReferenceNumber")).alias("source_ref"), looked_up({"person": "individual", "enterprise": "organization"}, F.get(many("subjectType"), F.lit(0))["_code"], "organization").alias("type"), names.alias("names"),
            F.transform(many("address"), place).alias("addresses"), "identifiers", dates.alias("dates_of_birth"), F.array_remove(attribute("citizenship", "_countryIso2Code"), "00").alias("nationalities"), attribute("regulation", "_programme").alias("programs"),
            partial_date("_designationDate").alias("listed_on"), composed(F.col("remark"), extras).alias("remarks"),
        )
        return Parsed(entities, no_warnings(spark), source_version=root.get("generationDate"))


# United Kingdom

UK_FIELDS = (
    "UniqueID OFSIGroupID UNReferenceNumber RegimeName* IndividualEntityShip DesignationSource SanctionsImposed DateDesignated LastUpdated OtherInformation UKStatementofReasons "
    "Names[Name[Name1 Name2 Name3 Name4 Name5 Name6 NameType AliasStrength]] NonLatinNames[NonLatinName[NameNonLatinScript NonLatinScriptType NonLatinScriptLanguage]] Titles[Title*] "
    "Addresses[Address[AddressLine1 AddressLine2 AddressLine3 AddressLine4 AddressLine5 AddressLine6 AddressPostalCode AddressCountry]] PhoneNumbers[PhoneNumber*] Websites[Website*] EmailAddresses[EmailAddress*] "
    "IndividualDetails[Individual[DOBs[DOB*] Nationalities[Nationality*] Genders[Gender*] Positions[Position*] BirthDetails[Location[TownOfBirth CountryOfBirth]] "
    "PassportDetails[Passport[PassportNumber PassportAdditionalInformation]] NationalIdentifierDetails[NationalIdentifier[NationalIdentifierNumber NationalIdentifierAdditionalInformation]]]] "
    "EntityDetails[Entity[BusinessRegistrationNumbers[BusinessRegistrationNumber*] TypeOfEntities[TypeOfEntity*] ParentCompanies[ParentCompany*] Subsidiaries[Subsidiary*]]] "
    "ShipDetails[Ship[IMONumbers[IMONumber*] CurrentOwnerOperators[CurrentOwnerOperator*] PreviousOwnerOperators[PreviousOwnerOperator*] CurrentBelievedFlagOfShips[CurrentBelievedFlagOfShip*] PreviousFlags[PreviousFlag*] "
    "TypeOfShipDetails[TypeOfShip*] TonnageOfShipDetails[TonnageOfShip*] LengthOfShipDetails[LengthOfShip*] YearsBuilt[YearBuilt*]]]"
)


def uk_date(value: str) -> list[dict]:
    """dd/mm/yyyy where zero or nothing stands for what is not known, or a year alone."""
    value = value.strip()
    if re.fullmatch(r"\d{4}", value):
        found = point_date(int(value))
    else:
        part = [int(p) if re.fullmatch(r"0*[1-9]\d*", p.strip()) else None for p in [*value.split("/", 2), "", ""][:3]]
        found = point_date(part[2], part[1], part[0] if part[1] else None) if part[2] else None
    return [found] if found else []


uk_dates = date_reader(uk_date)


class UnitedKingdom(Adapter):
    definition = Definition("uk_sanctions_list", "gb", "Foreign, Commonwealth and Development Office", "xml")

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        roots(spark, paths["main"]).collect()  # one row a document: refuses broken ones
        rows = read_records(spark, paths["main"], "Designation", fields(UK_FIELDS))

        def values(*path: str) -> Column:
            """The texts at a path; the last step is a repeated element or one of a record."""
            *above, last = path
            return texts(F.flatten(F.transform(F.filter(inside(F.col(above[0]), *above[1:]), lambda x: x[last].isNotNull()), lambda x: x[last]))) if above else texts(F.col(last))

        def single(*path: str) -> Column:
            *above, last = path
            return F.array_distinct(texts(F.transform(inside(F.col(above[0]), *above[1:]), lambda x: x[last])))

        person, firm, ship = ("IndividualDetails", "Individual"), ("EntityDetails", "Entity"), ("ShipDetails", "Ship")
        given = F.transform(inside(F.col("Names"), "Name"), lambda x: name_of(joined(*[x[f"Name{k}"] for k in range(1, 7)]), looked_up({"primary name": "primary", "primary name variation": "aka", "alias": "aka"}, x["NameType"], "aka"),
                                                                                 looked_up({"good quality a.k.a": "good", "low quality a.k.a": "low"}, x["AliasStrength"])))
        foreign = F.transform(inside(F.col("NonLatinNames"), "NonLatinName"), lambda x: name_of(text(x["NameNonLatinScript"])))
        rows = rows.withColumn("_names", F.filter(F.concat(given, foreign), lambda x: x["value"].isNotNull()))
        rows = rows.withColumn("births", uk_dates(values(*person, "DOBs", "DOB"))).withColumn("listed", uk_dates(F.array_compact(F.array("DateDesignated")))).cache()
        paper = lambda kind, value, note=None: struct_of(IDENTIFIER, kind=F.lit(kind), value=value, note=F.lit(None) if note is None else note)
        papers = F.concat(
            F.transform(inside(F.col(person[0]), person[1], "PassportDetails", "Passport"), lambda x: paper("passport", text(x["PassportNumber"]), text(x["PassportAdditionalInformation"]))),
            F.transform(inside(F.col(person[0]), person[1], "NationalIdentifierDetails", "NationalIdentifier"), lambda x: paper("national_id", text(x["NationalIdentifierNumber"]), text(x["NationalIdentifierAdditionalInformation"]))),
            F.transform(values(*firm, "BusinessRegistrationNumbers", "BusinessRegistrationNumber"), lambda x: paper("registration_number", x)),
            F.transform(values(*ship, "IMONumbers", "IMONumber"), lambda x: paper("other", F.regexp_replace(x, r"(?iU)^IMO\s*(?=\d)", ""), F.lit("IMO number"))),
        )
        place = lambda x: struct_of(ADDRESS, street=joined(*[x[f"AddressLine{k}"] for k in range(1, 6)], by=", "), city=text(x["AddressLine6"]), postal_code=text(x["AddressPostalCode"]), country=text(x["AddressCountry"]))
        prose = F.nullif(F.concat_ws("\n\n", F.nullif(F.trim("OtherInformation"), F.lit("")), F.nullif(F.trim("UKStatementofReasons"), F.lit(""))), F.lit(""))
        distinct = F.array_distinct
        extras = {
            "OFSI group id": F.array("OFSIGroupID"), "UN reference": F.array("UNReferenceNumber"), "Designation source": F.array("DesignationSource"), "Sanctions imposed": F.array("SanctionsImposed"), "Last updated": F.array("LastUpdated"),
            "Title": values("Titles", "Title"), "Date of birth as published": F.col("births.unread"), "Gender": distinct(values(*person, "Genders", "Gender")), "Position": values(*person, "Positions", "Position"),
            "Town of birth": single(*person, "BirthDetails", "Location", "TownOfBirth"), "Country of birth": single(*person, "BirthDetails", "Location", "CountryOfBirth"), "Type of entity": distinct(values(*firm, "TypeOfEntities", "TypeOfEntity")),
            "Parent company": values(*firm, "ParentCompanies", "ParentCompany"), "Subsidiary": values(*firm, "Subsidiaries", "Subsidiary"), "Current owner/operator": values(*ship, "CurrentOwnerOperators", "CurrentOwnerOperator"),
            "Previous owner/operator": values(*ship, "PreviousOwnerOperators", "PreviousOwnerOperator"), "Current believed flag": values(*ship, "CurrentBelievedFlagOfShips", "CurrentBelievedFlagOfShip"), "Previous flag": values(*ship, "PreviousFlags", "PreviousFlag"),
            "Type of ship": values(*ship, "TypeOfShipDetails", "TypeOfShip"), "Tonnage": values(*ship, "TonnageOfShipDetails", "TonnageOfShip"), "Length": values(*ship, "LengthOfShipDetails", "LengthOfShip"), "Year built": values(*ship, "YearsBuilt", "YearBuilt"),
            "Phone": values("PhoneNumbers", "PhoneNumber"), "Website": values("Websites", "Website"), "Email": values("EmailAddresses", "EmailAddress"), "Non-Latin script": single("NonLatinNames", "NonLatinName", "NonLatinScriptType"), "Non-Latin language": single("NonLatinNames", "NonLatinName", "NonLatinScriptLanguage"),
        }
        entities = rows.where(F.size("_names") > 0).select(
            F.lit("uk_sanctions_list").alias("source"), text(F.col("UniqueID")).alias("source_ref"), looked_up({"individual": "individual", "entity": "organization", "ship": "vessel"}, F.col("IndividualEntityShip"), "organization").alias("type"),
            first_spellings(F.col("_names")).alias("names"), F.transform(inside(F.col("Addresses"), "Address"), place).alias("addresses"), distinct(papers_with_dates(papers)).alias("identifiers"), F.col("births.dates").alias("dates_of_birth"),
            distinct(values(*person, "Nationalities", "Nationality")).alias("nationalities"), distinct(values("RegimeName")).alias("programs"), F.get("listed.dates", F.lit(0)).alias("listed_on"), composed(prose, extras).alias("remarks"),
        )
        return Parsed(entities, no_warnings(spark))


# Australia

#: The columns that the sheet must have, and how measures are called.
AU_COLUMNS = ("reference", "name_of_individual_or_entity", "type", "name_type", "alias_strength", "date_of_birth", "citizenship", "address", "additional_information", "listing_information", "imo_number", "committees", "control_date", "instrument_of_designation")
AU_MEASURES = {"targeted_financial_sanction": "targeted financial sanction", "travel_ban": "travel ban", "arms_embargo": "arms embargo", "maritime_restriction": "maritime restriction"}
ENUMERATOR = r"(?:^|\s)[a-z]\)\s*"


def au_dates(cell: str) -> list[dict]:
    """The dates of a cell: "a) 1/2/1960 b) approximately: 1961"."""
    out = []
    for part in (p for x in re.sub(ENUMERATOR, ",", cell).split(",") for p in re.split(r"(?<=\d)\s+(?=\d)", x)):
        part = " ".join(part.split())
        if m := re.fullmatch(r"(?:(\d{1,2})/)?(\d{1,2})/(\d{4})", part):
            found = point_date(int(m[3]), int(m[2]), m[1] and int(m[1]))
        else:
            found = parse_date(re.sub(r"\Aapproximately:", "approximately", part, flags=re.I))
        out += [found] if found else []
    return out


def au_listing(cell: str) -> list[dict]:
    """The day of listing; the day of an amendment is none."""
    day = r"\d{1,2}\s+[A-Za-z]+\.?,?\s+\d{4}"
    if m := re.match(day, cell):
        return one_date(m[0])
    m = re.search(rf"(\w[\w-]*)\s+on:?\s+({day})", cell)
    return [] if not m or re.match("amend|relist|re-list|updat|expir", m[1], re.I) else one_date(m[2])


read_au_dates, read_au_listing = date_reader(au_dates), date_reader(au_listing)


class Australia(Adapter):
    definition = Definition("australia_dfat", "au", "Department of Foreign Affairs and Trade", "xlsx")
    sheet = re.compile(r"^Consolidated List\b")

    def parse(self, spark: SparkSession, paths: dict[str, str]) -> Parsed:
        rows, warnings = read_sheet(spark, paths["main"], self.sheet)
        missing = [c for c in AU_COLUMNS if c not in rows.columns]
        if missing:
            raise ParseError(f"the sheet does not name the column(s) {', '.join(missing)}")
        optional = [c for c in ("place_of_birth", *AU_MEASURES) if c not in rows.columns]
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in optional}).withColumn("stem", F.nullif(F.regexp_replace(F.trim("reference"), "[a-z]+$", ""), F.lit("")))
        loose = rows.where(F.col("stem").isNull()).select("line", F.format_string("row %d carries no reference, so it cannot be joined to a record", "line").alias("message"), F.col("name_of_individual_or_entity").alias("snippet"))
        columns = [c for c in rows.columns if c not in ("stem", "line")]
        records = rows.where(F.col("stem").isNotNull()).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line", *columns))).alias("rows"))

        def column(name: str) -> Column:
            """A column's distinct values in order, in their first spelling."""
            cells = F.filter(F.transform("rows", lambda r: F.struct(collapsed(r[name]).alias("k"), F.trim(r[name]).alias("v"))), lambda x: x["k"].isNotNull())
            return F.transform(F.filter(cells, lambda x, i: ~F.exists(F.slice(cells, F.lit(1), i), lambda y: y["k"] == x["k"])), lambda x: x["v"])

        strength = {"strong": "good", "weak": "low"}
        named = F.transform("rows", lambda r: name_of(collapsed(r["name_of_individual_or_entity"]), looked_up({"primary name": "primary", "alias": "aka", "original script": "aka"}, r["name_type"], "aka"), looked_up(strength, r["alias_strength"])))
        records = records.withColumn("_names", F.filter(named, lambda x: x["value"].isNotNull()))
        first = F.coalesce(F.get(F.filter("rows", lambda r: F.lower(r["name_type"]) == "primary name"), F.lit(0)), F.get("rows", F.lit(0)))
        records = records.withColumns({"_born": column("date_of_birth"), "_listed": column("listing_information")}).cache()
        records = records.withColumn("births", read_au_dates("_born")).withColumn("listings", read_au_listing("_listed")).cache()
        places = F.array_distinct(F.filter(F.flatten(F.transform(column("address"), lambda x: F.transform(F.split(x, ENUMERATOR), collapsed))), lambda x: x.isNotNull()))
        prose = F.array_distinct(F.transform(F.concat(column("additional_information"), column("listing_information")), collapsed))
        measures = [F.when(F.exists(column(c), lambda x: F.lower(x).isin("1", "true", "yes", "y")), F.lit(label)) for c, label in AU_MEASURES.items()]
        extras = {"Place of birth": column("place_of_birth"), "Instrument of designation": column("instrument_of_designation"), "Control date (last edited, not listed)": column("control_date"), "Measures": F.array_compact(F.array(*measures)), "Date of birth, as published": F.col("births.unread")}
        entities = records.where(F.size("_names") > 0).select(
            F.lit("australia_dfat").alias("source"), F.col("stem").alias("source_ref"), looked_up({"individual": "individual", "entity": "organization", "vessel": "vessel"}, first["type"], "organization").alias("type"), first_spellings(F.col("_names")).alias("names"),
            F.transform(places, lambda x: struct_of(ADDRESS, street=x)).alias("addresses"), F.transform(column("imo_number"), lambda x: struct_of(IDENTIFIER, kind=F.lit("other"), value=x, note=F.lit("IMO number"))).alias("identifiers"), F.col("births.dates").alias("dates_of_birth"),
            F.array_distinct(texts(F.flatten(F.transform(column("citizenship"), lambda x: F.split(x, ";"))))).alias("nationalities"), column("committees").alias("programs"), F.get("listings.dates", F.lit(0)).alias("listed_on"),
            composed(F.nullif(F.array_join(prose, "\n\n"), F.lit("")), extras).alias("remarks"),
        )
        nameless = records.where(F.size("_names") == 0).select(F.get("rows", F.lit(0))["line"].alias("line"), F.format_string('reference "%s" has no name on any of its %d row(s) and was skipped', "stem", F.size("rows")).alias("message"), F.lit(None).cast("string").alias("snippet"))
        return Parsed(entities, warnings.unionByName(loose).unionByName(nameless))


for adapter in (UnitedNations(), Canada(), EuropeanUnion(), UnitedKingdom(), Australia()):
    SOURCES.register(adapter)
