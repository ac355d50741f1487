"""Scans and adapters on small files of their published shapes, storage, synchronising, differences, rescreening and streams."""

import datetime as dt
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from veritrace import Client
from veritrace.config import Settings
from veritrace.errors import CorruptSnapshot, IntegrityError, InvalidArgument, MalformedDocument, MissingSnapshot, ParseError
from veritrace.functions.dates import parse_date
from veritrace.operators import changes, profile, snapshots
from veritrace.operators.queries import subjects_of
from veritrace.operators.rescreen import Rescreen, ranked
from veritrace.operators.snapshots import Snapshot, Store
from veritrace.operators.sync import tallies
from veritrace.schema import ENTITY, conformed
from veritrace.sources import lists, remarks, treasury
from veritrace.sources.delimited import DelimitedTable, snake
from veritrace.sources.registry import SOURCES, Adapter, Definition, Parsed, no_warnings
from veritrace.sources.spreadsheet import Workbook, read_sheet
from veritrace.sources.xml import fields, read_records, roots
from veritrace.streaming.rescreening import alerts_to, event_counts, versions_to


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


# Delimited text


def test_delimited(spark, tmp_path):
    path = put(tmp_path / "a.csv", '﻿Ref No, Full Name ,Note\r\n1,"Smith, J.",-0- \r\n2,short\r\n3,"long ""x""",y,z\r\n\r\n4,"two\nlines",  \r\n\x1a')
    rows, warnings = DelimitedTable(null="-0-").read(spark, path)
    assert rows.columns == ["line", "ref_no", "full_name", "note"]
    assert [tuple(r) for r in rows.orderBy("line").collect()] == [(2, "1", "Smith, J.", None), (3, "2", "short", None), (4, "3", 'long "x"', "y"), (6, "4", "two\nlines", None)]
    assert sorted(r["message"] for r in warnings.collect()) == ["row has 2 of 3 fields", "row has 4 fields, the further than 3 were dropped"]
    assert snake(" Name of Individual / Entity ") == "name_of_individual_entity"


def test_encodings_and_files_of_another_kind(spark, tmp_path):
    latin = put(tmp_path / "w.csv", "1,Ñandú\n".encode("windows-1252"))
    assert DelimitedTable(("a", "b"), encoding="windows-1252").read(spark, latin)[0].first()["b"] == "Ñandú"
    rows, warnings = DelimitedTable(("a", "b")).read(spark, latin)
    assert "�" in rows.first()["b"] and "replaced" in warnings.first()["message"]
    for data in (b"", b" \n", ('"x" y,' * 3 + "\n").encode() * 150):
        with pytest.raises(Exception, match="empty|could not be read"):
            DelimitedTable(("a", "b")).read(spark, put(tmp_path / "bad.csv", data))[0].collect()


# XML


def test_xml(spark, tmp_path):
    path = put(tmp_path / "l.xml", '<?xml version="1.0"?><x:list xmlns:x="urn:x" made="2024"><x:item k="7"><x:id>007</x:id><x:n> a  b </x:n><x:n>c</x:n><x:in><x:v>1</x:v></x:in></x:item><x:item><x:id/></x:item></x:list>')
    root = roots(spark, path).first()
    assert root["root"] == "list" and root["attributes"]["made"] == "2024"
    rows = read_records(spark, path, "item", fields("@k id n* in[v]")).collect()
    assert (rows[0]["_k"], rows[0]["id"], len(rows[0]["n"]), rows[0]["in"][0]["v"], rows[1]["id"]) == ("7", "007", 2, "1", None)
    with pytest.raises(Exception, match="no whole XML document"):
        roots(spark, put(tmp_path / "cut.xml", "<list><item><id>1</id></item>")).collect()
    assert issubclass(MalformedDocument, ParseError)


UN = """<CONSOLIDATED_LIST dateGenerated="2024-05-01T00:00:00"><INDIVIDUALS><INDIVIDUAL><DATAID>110</DATAID><VERSIONNUM>1</VERSIONNUM><FIRST_NAME>OMAR</FIRST_NAME><SECOND_NAME> AL  </SECOND_NAME><THIRD_NAME>HADI</THIRD_NAME>
<UN_LIST_TYPE>Taliban</UN_LIST_TYPE><REFERENCE_NUMBER>TAi.1</REFERENCE_NUMBER><LISTED_ON>2001-01-25</LISTED_ON><NAME_ORIGINAL_SCRIPT>عمر</NAME_ORIGINAL_SCRIPT><COMMENTS1>A comment.</COMMENTS1>
<NATIONALITY><VALUE>Afghanistan</VALUE><VALUE/></NATIONALITY><DESIGNATION><VALUE>Minister</VALUE></DESIGNATION>
<INDIVIDUAL_ALIAS><QUALITY>Good</QUALITY><ALIAS_NAME>Omar Hadi</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>Mullah H</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ALIAS><QUALITY>f.k.a.</QUALITY><ALIAS_NAME>Old Name</ALIAS_NAME></INDIVIDUAL_ALIAS>
<INDIVIDUAL_ADDRESS><CITY>Kabul</CITY><COUNTRY>Afghanistan</COUNTRY></INDIVIDUAL_ADDRESS><INDIVIDUAL_ADDRESS><COUNTRY/></INDIVIDUAL_ADDRESS>
<INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>BETWEEN</TYPE_OF_DATE><FROM_YEAR>1960</FROM_YEAR><TO_YEAR>1963</TO_YEAR></INDIVIDUAL_DATE_OF_BIRTH><INDIVIDUAL_DATE_OF_BIRTH><TYPE_OF_DATE>APPROXIMATELY</TYPE_OF_DATE><YEAR>1962</YEAR></INDIVIDUAL_DATE_OF_BIRTH>
<INDIVIDUAL_PLACE_OF_BIRTH><CITY>Herat</CITY><COUNTRY>Afghanistan</COUNTRY></INDIVIDUAL_PLACE_OF_BIRTH>
<INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT><NUMBER>OR 12-3</NUMBER><COUNTRY_OF_ISSUE>Afghanistan</COUNTRY_OF_ISSUE><DATE_OF_ISSUE>1 Mar 2000</DATE_OF_ISSUE><NOTE>lost</NOTE></INDIVIDUAL_DOCUMENT><INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT></INDIVIDUAL_DOCUMENT>
</INDIVIDUAL></INDIVIDUALS><ENTITIES><ENTITY><DATAID>220</DATAID><FIRST_NAME>ACME TRADING</FIRST_NAME><UN_LIST_TYPE>DPRK</UN_LIST_TYPE><ENTITY_ALIAS><QUALITY>a.k.a.</QUALITY><ALIAS_NAME>Acme</ALIAS_NAME></ENTITY_ALIAS></ENTITY><ENTITY><DATAID>221</DATAID></ENTITY></ENTITIES></CONSOLIDATED_LIST>"""


def test_united_nations(spark, tmp_path):
    parsed = SOURCES["un_consolidated"].read(spark, put(tmp_path / "un.xml", UN))
    rows = {r["source_ref"]: r for r in parsed.entities.collect()}
    one = rows["110"]
    assert set(rows) == {"110", "220"} and parsed.source_version.startswith("2024-05-01") and one["id"] == "un_consolidated:110" and one["type"] == "individual"
    assert [(n["value"], n["kind"], n["quality"]) for n in one["names"]] == [("OMAR AL HADI", "primary", None), ("عمر", "aka", None), ("Omar Hadi", "aka", "good"), ("Mullah H", "aka", "low"), ("Old Name", "fka", None)]
    assert [(d["first_date"], d["last_date"], d["approximate"]) for d in one["dates_of_birth"]] == [(dt.date(1960, 1, 1), dt.date(1963, 12, 31), False), (dt.date(1962, 1, 1), dt.date(1962, 12, 31), True)]
    paper = one["identifiers"][0]
    assert len(one["identifiers"]) == 1 and (paper["kind"], paper["normalized_value"], paper["country"], paper["issued_on"]["first_date"], paper["note"]) == ("passport", "or123", "Afghanistan", dt.date(2000, 3, 1), "lost")
    assert one["nationalities"] == ["Afghanistan"] and one["programs"] == ["Taliban"] and one["listed_on"]["first_date"] == dt.date(2001, 1, 25) and len(one["addresses"]) == 1
    assert one["remarks"] == "A comment. [source fields] Version: 1; Reference: TAi.1; Designation: Minister; Place of birth: Herat, Afghanistan"
    assert rows["220"]["type"] == "organization" and [n["kind"] for n in rows["220"]["names"]] == ["primary", "aka"]


def ca(**values):
    return "<record>" + "".join(f"<{lists.CA[k]}>{v}</{lists.CA[k]}>" for k, v in values.items()) + "</record>"


def test_canada(spark, tmp_path):
    text = "<data-set>" + ca(country="Russia / Russie", last="Ivanov", given="Ivan", aliases="I. Ivanov; IVAN IVANOV", born="1960-01-02 or 1961", schedule="1", item="7", listed="2022-02-24") + ca(country="Iran | Iran", entity="Sea Star", imo="9187629", title="Tanker", born="1999") + ca(country="Syria", entity="Firm", born="soon") + ca(country="x") + "</data-set>"
    parsed = SOURCES["canada_sema"].read(spark, put(tmp_path / "ca.xml", text))
    rows = {r["names"][0]["value"]: r for r in parsed.entities.collect()}
    person, ship, firm = rows["Ivan Ivanov"], rows["Sea Star"], rows["Firm"]
    assert (person["type"], ship["type"], firm["type"]) == ("individual", "vessel", "organization") and [n["value"] for n in person["names"]] == ["Ivan Ivanov", "I. Ivanov"]
    assert [d["year"] for d in person["dates_of_birth"]] == [1960, 1961] and person["programs"] == ["Russia"] and re.fullmatch("[0-9a-f]{16}", person["source_ref"])
    assert ship["identifiers"][0]["value"] == "9187629" and "Built: 1999" in ship["remarks"] and "Vessel type: Tanker" in ship["remarks"] and not ship["dates_of_birth"]
    assert "Date of birth: soon" in firm["remarks"] and "does not read" in parsed.warnings.first()["message"] and len(rows) == 3


EU = """<export generationDate="2024-06-01"><sanctionEntity euReferenceNumber="EU.1" designationDate="2014-03-17" logicalId="13" unitedNationId=""><remark>Prose.</remark><subjectType code="person"/><regulation programme="UKR" numberTitle="269/2014"><publicationUrl>http://x</publicationUrl></regulation>
<nameAlias wholeName="Ivan  Petrov" function="Minister" gender="M"><remark>Low quality alias</remark></nameAlias><nameAlias wholeName="Ivan Petrovich"/><nameAlias wholeName="Old Ivan"><remark>x; formerly known as</remark></nameAlias><nameAlias wholeName="Ivan Petrovich"/>
<citizenship countryIso2Code="RU" countryDescription="RUSSIA"/><citizenship countryIso2Code="00"/><birthdate calendarType="GREGORIAN" circa="true" year="1960" city="Omsk" countryIso2Code="RU" countryDescription="RUSSIA"/><birthdate calendarType="GREGORIAN" year="1961" monthOfYear="2" dayOfMonth="3"/><birthdate calendarType="ISLAMIC" year="1380"/>
<identification identificationTypeCode="passport" number="AB 1" countryIso2Code="RU" countryDescription="RUSSIA" knownExpired="true" issueDate="2001-02-03"><remark>seen</remark></identification><identification identificationTypeCode="id"/>
<address city="Omsk" poBox="12" countryIso2Code="00" countryDescription="UNKNOWN"><contactInfo key="EMAIL" value="a@b"/></address></sanctionEntity></export>"""


def test_european_union(spark, tmp_path):
    parsed = SOURCES["eu_fsf"].read(spark, put(tmp_path / "eu.xml", EU))
    r = parsed.entities.first()
    assert [(n["value"], n["kind"], n["quality"]) for n in r["names"]] == [("Ivan Petrov", "aka", "low"), ("Ivan Petrovich", "primary", None), ("Old Ivan", "fka", None)]
    assert [(d["year"], d["month"], d["approximate"]) for d in r["dates_of_birth"]] == [(1960, None, True), (1961, 2, False)] and r["nationalities"] == ["RU"] and r["programs"] == ["UKR"]
    assert "Date of birth as published: 1380 (islamic calendar)" in r["remarks"] and "Place of birth: Omsk, RUSSIA" in r["remarks"] and "Official Journal: http://x" in r["remarks"]
    assert len(r["identifiers"]) == 1 and r["identifiers"][0]["note"] == "seen; known expired" and r["identifiers"][0]["issued_on"]["day"] == 3
    assert r["addresses"][0]["country"] is None and r["addresses"][0]["note"] == "P.O. Box 12; EMAIL: a@b" and r["listed_on"]["year"] == 2014 and parsed.source_version == "2024-06-01"


UK = """<Designations><Designation><UniqueID>AFG0001</UniqueID><OFSIGroupID>12</OFSIGroupID><RegimeName>Afghanistan</RegimeName><IndividualEntityShip>Individual</IndividualEntityShip><DateDesignated>25/01/2001</DateDesignated><OtherInformation>Info.</OtherInformation>
<Names><Name><Name1>Omar</Name1><Name6>HADI</Name6><NameType>Primary Name</NameType></Name><Name><Name6>Mullah H</Name6><NameType>Alias</NameType><AliasStrength>Low Quality a.k.a</AliasStrength></Name></Names><NonLatinNames><NonLatinName><NameNonLatinScript>عمر</NameNonLatinScript><NonLatinScriptType>Arabic</NonLatinScriptType></NonLatinName></NonLatinNames>
<Addresses><Address><AddressLine1>Street 1</AddressLine1><AddressLine2>Block 2</AddressLine2><AddressLine6>Kabul</AddressLine6><AddressCountry>Afghanistan</AddressCountry></Address></Addresses>
<IndividualDetails><Individual><DOBs><DOB>00/00/1960</DOB><DOB>15/03/1961</DOB><DOB>--</DOB></DOBs><Nationalities><Nationality>Afghanistan</Nationality></Nationalities><PassportDetails><Passport><PassportNumber>P1</PassportNumber></Passport></PassportDetails></Individual></IndividualDetails></Designation>
<Designation><UniqueID>SHP1</UniqueID><IndividualEntityShip>Ship</IndividualEntityShip><DateDesignated>2019</DateDesignated><Names><Name><Name6>Sea Star</Name6><NameType>Primary Name</NameType></Name></Names><ShipDetails><Ship><IMONumbers><IMONumber>IMO 9187629</IMONumber></IMONumbers></Ship></ShipDetails></Designation></Designations>"""


def test_united_kingdom(spark, tmp_path):
    rows = {r["source_ref"]: r for r in SOURCES["uk_sanctions_list"].read(spark, put(tmp_path / "uk.xml", UK)).entities.collect()}
    one, ship = rows["AFG0001"], rows["SHP1"]
    assert [(n["value"], n["kind"], n["quality"]) for n in one["names"]] == [("Omar HADI", "primary", None), ("Mullah H", "aka", "low"), ("عمر", "aka", None)]
    assert [(d["year"], d["month"], d["day"]) for d in one["dates_of_birth"]] == [(1960, None, None), (1961, 3, 15)] and one["listed_on"]["first_date"] == dt.date(2001, 1, 25)
    assert one["addresses"][0]["street"] == "Street 1, Block 2" and one["identifiers"][0]["kind"] == "passport" and "Date of birth as published: --" in one["remarks"] and one["remarks"].startswith("Info. [source fields] OFSI group id: 12")
    assert ship["type"] == "vessel" and ship["identifiers"][0]["value"] == "9187629" and ship["listed_on"]["year"] == 2019


# Workbooks


def workbook(rows, sheet="Consolidated List (x)", formats=(0, 14, 164), more=()):
    """A workbook of one sheet: rows of cells, each text, number, or (number, style)."""

    def cell(k, j, v):
        at = f'r="{chr(65 + j)}{k}"'
        if v is None:
            return ""
        if isinstance(v, tuple):
            return f'<c {at} s="{v[1]}"><v>{v[0]}</v></c>'
        return f"<c {at}><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{k}">{"".join(cell(k, j, v) for j, v in enumerate(r))}</row>' for k, r in enumerate(rows, 1))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns}><sheets>{"".join(f"<sheet name={n!r} sheetId={str(k)!r} r:id={f"r{k}"!r}/>" for k, n in enumerate([sheet, *more], 1))}</sheets></workbook>'.replace("'", '"'),
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/sheet1.xml"/>' for k in range(1, 2 + len(more))) + "</Relationships>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="mmm\\ yyyy"/></numFmts><cellXfs>{"".join(f"<xf numFmtId={str(f)!r}/>" for f in formats)}</cellXfs></styleSheet>'.replace("'", '"'),
        "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    raw = workbook([["Ref", None, "Born"], ["1_x0041_", 2.0, (36526, 1)], [None, None, None], ["3", 1.5, (36526, 2), "wide"]])
    rows, warnings = read_sheet(spark, put(tmp_path / "b.xlsx", raw))
    assert rows.columns == ["line", "ref", "column_2", "born"] and [tuple(r) for r in rows.orderBy("line").collect()] == [(2, "1A", "2", "2000-01-01"), (4, "3", "1.5", "2000-01")]
    assert warnings.count() == 1
    with pytest.raises(ParseError):
        Workbook(b"no zip")
    with pytest.raises(ParseError, match="more than one"):
        Workbook(workbook([["a"]], more=["Consolidated List (y)"])).sheet(re.compile("^Consolidated List"))
    with pytest.raises(ParseError, match="no sheet"):
        Workbook(raw).sheet("nope")


def test_australia(spark, tmp_path):
    head = [*lists.AU_COLUMNS, "travel_ban"]
    row = lambda **v: [v.get(c) for c in head]
    raw = workbook([
        head, row(reference="12", name_of_individual_or_entity="Omar Hadi", type="Individual", name_type="Primary Name", date_of_birth="a) 1/2/1960 b) approximately: 1961", citizenship="Afghan; Pakistani", address="a) Kabul b) Herat", listing_information="Listed on 25 January 2001", committees="1988", travel_ban="TRUE"),
        row(reference="12a", name_of_individual_or_entity="Mullah H", type="Individual", name_type="Alias", alias_strength="Weak", citizenship="Afghan", date_of_birth="someday"), row(reference="13", name_of_individual_or_entity="Firm", type="Entity", name_type="Primary Name", listing_information="Amended on 1 May 2010"),
        row(name_of_individual_or_entity="Loose"), row(reference="14", type="Vessel"),
    ])
    parsed = SOURCES["australia_dfat"].read(spark, put(tmp_path / "au.xlsx", raw))
    rows = {r["source_ref"]: r for r in parsed.entities.collect()}
    one = rows["12"]
    assert set(rows) == {"12", "13"} and [(n["value"], n["kind"], n["quality"]) for n in one["names"]] == [("Omar Hadi", "primary", None), ("Mullah H", "aka", "low")]
    assert [(d["year"], d["month"], d["day"], d["approximate"]) for d in one["dates_of_birth"]] == [(1960, 2, 1, False), (1961, None, None, True)] and one["nationalities"] == ["Afghan", "Pakistani"]
    assert [a["street"] for a in one["addresses"]] == ["Kabul", "Herat"] and one["listed_on"]["first_date"] == dt.date(2001, 1, 25) and rows["13"]["listed_on"] is None
    assert "Measures: travel ban" in one["remarks"] and "Date of birth, as published: someday" in one["remarks"] and len(parsed.warnings.collect()) == 2
    with pytest.raises(ParseError, match="does not name"):
        SOURCES["australia_dfat"].read(spark, put(tmp_path / "x.xlsx", workbook([["reference"], ["1"]])))


# Treasury


def test_treasury(spark, tmp_path):
    dash = "-0- "
    sdn = [
        ["1", "ABBAS, Abu", "individual", "SDGT] [NPWMD", "Director", dash, dash, dash, dash, dash, dash, "DOB 10 Dec 1948; alt. DOB 1949; nationality Iraq; Passport A12345 (Iraq) issued 01 Jan 2000 expires 2010; a.k.a. 'ABU'; Digital Currency Address - XBT 1abc2; Secondary sanctions risk: x; strange thing 77 here."],
        ["2", "SEA STAR", "vessel", "IRAN", dash, "5BQ", "Tanker", dash, dash, "Iran", dash, dash], ["3", dash, dash, dash, dash, dash, dash, dash, dash, dash, dash, dash], ["4", "ACME", "enterprise", "IRAN", dash, dash, dash, dash, dash, dash, dash, dash],
    ]
    quoted = lambda rows: "\r\n".join(",".join('"' + c.replace('"', '""') + '"' for c in r) for r in rows) + "\r\n"
    paths = {"sdn": put(tmp_path / "s.csv", quoted(sdn)), "alt": put(tmp_path / "a.csv", quoted([["1", "9", "fka", "ABBAS, Muhammad", dash], ["77", "1", "aka", "NOBODY", dash]])), "add": put(tmp_path / "d.csv", quoted([["1", "5", "Street", "Baghdad", "Iraq", dash], ["2", "6", dash, dash, dash, dash]]))}
    parsed = SOURCES["ofac_sdn"].read(spark, paths)
    rows = {r["source_ref"]: r for r in parsed.entities.collect()}
    one = rows["1"]
    assert [(n["value"], n["kind"]) for n in one["names"]] == [("ABBAS, Abu", "primary"), ("ABBAS, Muhammad", "fka"), ("ABU", "aka")] and one["programs"] == ["SDGT", "NPWMD"] and one["nationalities"] == ["Iraq"]
    assert [d["year"] for d in one["dates_of_birth"]] == [1948, 1949] and [(i["kind"], i["value"], i["country"], i["note"]) for i in one["identifiers"]] == [("passport", "A12345", "Iraq", "Passport"), ("other", "1abc2", None, "XBT address")]
    assert one["identifiers"][0]["issued_on"]["day"] == 1 and one["identifiers"][0]["expires_on"]["year"] == 2010 and one["remarks"].endswith("[source fields] Title: Director") and one["addresses"][0]["city"] == "Baghdad"
    assert rows["2"]["type"] == "vessel" and rows["2"]["identifiers"][0]["note"] == "call sign" and not rows["2"]["addresses"] and rows["4"]["type"] == "organization" and "3" not in rows
    assert {k: df.count() for k, df in parsed.orphans.items()} == {"aliases": 1, "addresses": 0}
    messages = {r["message"] for r in parsed.warnings.collect()}
    assert 'unknown SDN_Type "enterprise"; treated as an organization' in messages and 'row "3" has no SDN_Name and was skipped' in messages
    covered = remarks.coverage(parsed.segments).first()
    assert (covered["segments"], covered["extracted"], covered["recognized"]) == (8, 6, 7) and remarks.unknown_shapes(parsed.segments).first()["shape"] == "strange thing ##"
    assert {r["name"]: r["ok"] for r in parsed.columns.collect()} == {"ent_num": True, "sdn_type": False}


def test_sub_lists(spark):
    df = spark.createDataFrame([(["UKRAINE-EO13662", "RUSSIA-EO14024"],), (["RUSSIA-EO14024"],), (["NS-PLC", "HKAA"],), (["SDGT"],)], "p array<string>")
    assert [r["s"] for r in df.select(treasury.sub_lists(F.col("p")).alias("s")).collect()] == [[treasury.LISTS["ssi"]], [treasury.LISTS["ns_mbs"]], [treasury.LISTS["ns_plc"], treasury.LISTS["ns_mbs"]], []]


# Registry


class Plain(Adapter):
    """The smallest adapter: a table with a header."""

    definition = Definition("plain_list", "xx", "Nobody", "csv")

    def parse(self, spark, paths):
        rows, warnings = DelimitedTable().read(spark, paths["main"])
        name = F.array(F.struct(F.col("name").alias("value"), F.lit("primary").alias("kind"), F.lit(None).cast("string").alias("quality"), F.lit(None).cast("string").alias("script")))
        return Parsed(rows.select(F.lit("plain_list").alias("source"), F.col("ref").alias("source_ref"), "type", name.alias("names")), warnings)


class Broken(Adapter):
    definition = Definition("broken_list", "xx", "Nobody", "csv")

    def parse(self, spark, paths):
        raise ParseError("not today")


@pytest.fixture
def registered():
    for a in (Plain(), Broken()):
        SOURCES.register(a)
    yield
    for k in ("plain_list", "broken_list"):
        SOURCES.unregister(k)


def test_registry(registered, spark):
    assert {"plain_list", "ofac_sdn", "ofac_consolidated", "un_consolidated", "canada_sema", "eu_fsf", "uk_sanctions_list", "australia_dfat"} <= set(SOURCES.keys()) and len(SOURCES.enabled(["eu_fsf"])) == 1
    with pytest.raises(InvalidArgument):
        SOURCES["nowhere"]
    with pytest.raises(InvalidArgument):
        SOURCES["ofac_sdn"].read(spark, {"sdn": "x"})
    with pytest.raises(InvalidArgument):
        Definition("Bad Key", "xx", "y", "csv")
    assert no_warnings(spark).count() == 0


# Stores and the client


def records(spark, *rows):
    out = [{"id": i, "source": "a", "type": "individual", "names": [{"value": n, "kind": "aka" if k else "primary"} for k, n in enumerate(names)], "dates_of_birth": [parse_date(d) for d in more.pop("born", [])], **more} for i, names, more in rows]
    return conformed(spark.createDataFrame(out, ENTITY))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = Snapshot.of("a", records(spark, ("1", ["X Y"], {}), ("2", ["Z"], {})))
    assert first.snapshot_id == Snapshot.of("a", records(spark, ("2", ["Z"], {}), ("1", ["X Y"], {}))).snapshot_id != Snapshot.of("b", first.entities).snapshot_id
    with pytest.raises(MissingSnapshot):
        store.read("a")
    assert store.write(first) and not store.write(first) and store.sources() == ["a"] and store.read("a").record_count == 2
    second = Snapshot.of("a", records(spark, ("1", ["X Y"], {})))
    assert store.write(second) and store.read("a").entities.count() == 1 and store.read("a", first.snapshot_id).entities.count() == 2 and store.history("a").count() == 2
    assert store.each_entity().count() == 1 and store.ages().first()["age_seconds"] >= 0
    records(spark, ("1", ["changed"], {})).write.mode("overwrite").parquet(store._folder("a", second.snapshot_id))
    with pytest.raises(CorruptSnapshot):
        store.read("a")
    assert store.delete("a") and not store.stored("a") and not store.delete("a") and store.each_entity().count() == 0


def test_bundles(spark, tmp_path):
    snapshot = Snapshot.of("a", records(spark, ("1", ["X Y"], {"born": ["circa 1960"]})), source_version="v1")
    snapshots.export(snapshot, str(tmp_path / "b"), b"key")
    again = snapshots.read_bundle(spark, str(tmp_path / "b"), b"key")
    assert again.snapshot_id == snapshot.snapshot_id and again.verified and again.source_version == "v1" and again.entities.collect() == snapshot.entities.collect()
    with pytest.raises(IntegrityError):
        snapshots.read_bundle(spark, str(tmp_path / "b"), b"other")
    with pytest.raises(IntegrityError):
        Snapshot.of("a", snapshot.entities, expected="sha256:0")


def test_flat_tables(spark):
    e = records(spark, ("1", ["X Y", "Q"], {"born": ["1960", "1961-02-03"], "addresses": [{"city": "Z"}], "identifiers": [{"value": "A1"}]}), ("2", ["Z"], {}))
    assert sorted(snapshots.reassembled(snapshots.normalised(e)).collect(), key=str) == sorted(e.collect(), key=str)


def test_client(spark, tmp_path, registered):
    client = Client(spark, str(tmp_path / "store"), Settings(threshold=60.0))
    one = put(tmp_path / "1.csv", "ref,name,type\n1,Abu Abbas,individual\n2,Sea Star,vessel\n")
    results = {r["source"]: r for r in client.sync({"plain_list": one, "broken_list": one}).collect()}
    assert results["plain_list"]["status"] == "updated" and results["broken_list"]["status"] == "failed" and "not today" in results["broken_list"]["message"]
    assert client.screen("Abu Abas").first()["entity_id"] == "plain_list:1" and client.screen("Abu Abas").first()["snapshot_id"] == results["plain_list"]["snapshot_id"]
    assert client.sync({"plain_list": one}).first()["status"] == "unchanged"
    two = put(tmp_path / "2.csv", "ref,name,type\n1,Abu Abbas,individual\n3,Vladimir Putin,individual\n")
    found = {r["check"]: r["severity"] for r in client.doctor("plain_list", two).collect()}
    assert "empty" not in found and client.store.read("plain_list").record_count == 2
    assert tallies(client.sync({"plain_list": two})).first()["updated"] == 1
    moved = client.diff("plain_list")
    assert {(r["id"], r["change"]) for r in moved.collect()} == {("plain_list:2", "removed"), ("plain_list:3", "added")}
    alerts = client.rescreen([{"id": "c1", "name": "Vladimir Putin"}, {"id": "c2", "name": "sea star"}, {"id": "c3", "name": "Abu Abbas"}], moved).collect()
    assert {(r["subject_id"], r["change"]) for r in alerts} == {("c1", "newly_listed"), ("c2", "delisted")}
    client.export("plain_list", str(tmp_path / "bundle"), b"k")
    other = Client(spark, str(tmp_path / "other"))
    other.import_(str(tmp_path / "bundle"), b"k")
    assert other.screen("Vladimir Putin").first()["score"] == 100.0


# Differences and rescreening


def two_versions(spark):
    before = records(spark, ("1", ["Abu Abbas"], {"born": ["1948"]}), ("2", ["Sea Star"], {"programs": ["p", "q"]}), ("3", ["Ivan Petrov"], {}), ("4", ["Same Man"], {}))
    after = records(spark, ("1", ["Abu Abbas"], {"born": ["1950"]}), ("2", ["Sea Star"], {"programs": ["q", "p"]}), ("4", ["Same Man"], {}), ("5", ["New Man"], {}), ("5", ["Second Row"], {}))
    return before, after


def test_entity_diff(spark):
    found = {r["id"]: r for r in changes.snapshot_diff(*two_versions(spark)).collect()}
    assert {k: (r["change"], r["fields"]) for k, r in found.items()} == {"1": ("modified", ["dates_of_birth"]), "3": ("removed", []), "5": ("added", [])}  # another order is no change
    assert '"added"' in found["1"]["details"]["dates_of_birth"] and changes.snapshot_diff(None, two_versions(spark)[1]).count() == 0
    lines = changes.summary(changes.snapshot_diff(*two_versions(spark)), 2)
    assert lines == ["modified 1: dates_of_birth", "removed 3", "... and 1 more"]
    with pytest.raises(InvalidArgument):
        changes.diff(spark.range(1), spark.range(1).withColumn("x", F.lit(1)), "id")
    papers = lambda *v: [{"value": x, "kind": "passport", "country": "ru"} for x in v]
    a, b = records(spark, ("1", ["X"], {"identifiers": papers("A-1")})), records(spark, ("1", ["X"], {"identifiers": [{"value": "a1", "kind": "passport", "country": "RU"}]}))
    assert changes.entity_diff(a, b).count() == 0  # identifiers compare by their normal form


def test_rescreen(spark):
    moved = changes.snapshot_diff(*two_versions(spark))
    book = subjects_of(spark, [{"id": "s1", "name": "Abu Abbas", "dob": "1948"}, {"id": "s2", "name": "Ivan Petrov"}, {"id": "s3", "name": "New Man", "threshold": 99}, {"id": "s4", "name": "Abu Abbas"}, {"id": "s5", "name": "Same Man"}])
    run = Rescreen(spark, moved, "new", "old", Settings(threshold=75.0))
    got = {r["subject_id"]: r for r in ranked(run.alerts(book)).collect()}
    assert {k: r["change"] for k, r in got.items()} == {"s1": "delisted", "s2": "delisted", "s3": "newly_listed", "s4": "details_changed"}
    assert got["s1"]["score"] == 65.0 and got["s1"]["previous_score"] == 100.0 and got["s1"]["fields"] == ["dates_of_birth"] and got["s1"]["snapshot_id"] == "new" and got["s2"]["score"] is None
    assert Rescreen(spark, moved.limit(0)).alerts(book).count() == 0


def test_streams(spark, tmp_path):
    book = subjects_of(spark, [{"id": "s2", "name": "Ivan Petrov"}, {"id": "s9", "name": "Nobody Here"}])
    book.write.parquet(str(tmp_path / "book"))
    run = Rescreen(spark, changes.snapshot_diff(*two_versions(spark)), "new", "old")
    alerts_to(spark.readStream.schema(book.schema).parquet(str(tmp_path / "book")), run, str(tmp_path / "alerts"), str(tmp_path / "c1")).awaitTermination()
    assert [r["subject_id"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()] == ["s2"]

    store, seen = Store(spark, str(tmp_path / "store")), []
    before, after = two_versions(spark)
    for k, version in enumerate((before, after)):
        version.write.mode("append").parquet(str(tmp_path / f"in{k}"))
        arrivals = spark.readStream.schema(ENTITY).parquet(str(tmp_path / f"in{k}"))
        versions_to(arrivals, store, "a", str(tmp_path / f"c{k + 2}"), lambda d, s: seen.append(d.count())).awaitTermination()
    assert seen == [0, 3] and store.history("a").count() == 2

    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "view"), (dt.datetime(2024, 1, 1, 0, 50), "view"), (dt.datetime(2024, 1, 1, 9, 0), "click")], "ts timestamp, event_type string")
    events.write.parquet(str(tmp_path / "events"))
    query = event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))).writeStream.format("memory").queryName("event_windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c9")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["n"] for r in spark.table("event_windows").collect()] == [2]  # the window behind the watermark is final


# Checkups


def test_findings(spark):
    many = records(spark, *[(str(k), [f"name {k}", f"alias {k}"][: 1 + k % 2], {"programs": ["p"], "born": ["1960"]}) for k in range(40)])
    warn = spark.createDataFrame([("row 12 is short",)] * 9 + [("row 7 is short",), ("odd  thing",)], "message string")
    was = profile.measure(many, "a", warnings=warn.limit(0), coverage=0.95)
    now = profile.measure(many.where(F.col("id").cast("int") < 30).withColumn("programs", F.array().cast("array<string>")), "a", warnings=warn, orphans={"alt": 4}, coverage=0.5)
    found = {(r["check"], r["message"]): r["severity"] for r in profile.ordered(profile.findings(now, was)).collect()}
    assert found == {
        ("fill_programs", "no record carries a program any more, 100% did"): "error", ("record_count", "30 records, was 40 (down 25%)"): "warn", ("remarks_coverage", "remarks coverage 50% (was 95%)"): "warn",
        ("warnings", "row ## is short (9 rows, new since the last sync)"): "warn", ("warnings", "row # is short (1 rows, new since the last sync)"): "info", ("warnings", "odd thing (1 rows, new since the last sync)"): "info", ("orphans", "4 child row(s) matched no record: 4 in alt"): "warn",
    }
    empty = profile.findings(profile.measure(many.limit(0), "a", orphans={"alt": 4}), was).collect()
    assert [(r["check"], r["severity"]) for r in empty] == [("empty", "error")]
    floors = {r["check"]: r["message"] for r in profile.findings(now, None, {"record_count": 100, "remarks_coverage": 0.9, "fill_aliases": 0.9}).collect()}
    assert floors["record_count"] == "30 records, below the floor of 100" and floors["remarks_coverage"] == "remarks coverage 50% (below the floor of 90%)" and floors["fill_aliases"] == "records with an alternate name 50%, below the floor of 90%"
    report = profile.report(profile.findings(now, was), ["a", "b"])
    assert {r["source"]: (r["severity"], r["ok"]) for r in report.collect()} == {"a": ("error", False), "b": (None, True)} and profile.exit_code(report) == 1 and profile.exit_code(report.where("ok")) == 0
    assert profile.baseline_of(was, "x", "x") is was and profile.baseline_of(was, "x", "y") is None
    assert profile.findings(now, was).join(profile.canary(spark, now, was), ["check", "message"], "left_anti").count() == 0 and changes.confirmed(profile.findings(now, was), profile.findings(was, was)).count() == 0
