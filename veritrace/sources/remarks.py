"""Remarks: composing them from what a source says besides the model's fields, and reading fields out of a published line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from veritrace.functions.dates import PDATE, parse_date
from veritrace.schema import IDENTIFIER, NAME, clean

MARKER = "[source fields]"


def composed(published: Column, fields: dict[str, Column]) -> Column:
    """The published text, and after a marker "label: value, value; ..." of the fields (texts or arrays of them) that have values."""
    entries = []
    for label, values in fields.items():
        kept = F.filter(F.transform(values, clean), lambda x: x.isNotNull())
        entries.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"{label}: "), F.array_join(kept, ", "))))
    listed = F.array_compact(F.array(*entries))
    more = F.when(F.size(listed) > 0, F.concat(F.lit(f"{MARKER} "), F.array_join(listed, "; ")))
    return F.nullif(F.concat_ws(" ", clean(published), more), F.lit(""))


def published(remarks: Column) -> Column:
    """What the source itself published, of composed remarks."""
    return clean(F.get(F.split(remarks, re.escape(MARKER), 2), F.lit(0)))


#: Labels of segments that are read into fields, into identifiers by kind, and of those that stay prose.
FIELDS = {"DOB": "dob", "POB": "pob", "nationality": "nationality", "citizen": "nationality", "Gender": "gender", "a.k.a.": "aka", "f.k.a.": "fka", "n.k.a.": "nka"}
DOCUMENTS = {
    "passport": ["Passport", "Diplomatic Passport"],
    "national_id": ["National ID No.", "Identification Number", "Cedula No.", "C.U.R.P.", "C.U.I.P.", "D.N.I.", "C.I.N.", "Driver's License No.", "Birth Certificate Number", "Residency Number"],
    "tax_id": ["Tax ID No.", "R.F.C.", "V.A.T. Number", "NIT", "RUC", "RIF", "Unified Social Credit Code (USCC)"],
    "registration_number": [
        "Registration Number", "Business Registration Number", "Business Registration Document", "Company Number", "Commercial Registry Number", "Registration ID", "Government Gazette Number",
        "Folio Mercantil No.", "Matricula Mercantil No", "Legal Entity Number", "Chamber of Commerce Number", "Trade License No.", "License", "C.R. No.", "Economic Register Number (CBLS)",
        "Central Registration System Number", "D-U-N-S Number", "Enterprise Number", "Business Number", "Entity Code", "Public Registration Number",
    ],
    "other": [
        "MMSI", "Vessel Registration Identification IMO", "Vessel Registration Identification", "Identification Number IMO", "Company Number IMO", "SWIFT/BIC", "Aircraft Manufacturer's Serial Number (MSN)", "Aircraft Tail Number",
        "Aircraft Construction Number (also called L/N or S/N or F/N)", "Aircraft Construction Number",
    ],
}
PROSE = [
    "Secondary sanctions risk", "Additional Sanctions Information", "Linked To", "Transactions Prohibited For Persons Owned or Controlled By U.S. Financial Institutions", "Organization Established Date", "Organization Type", "Target Type",
    "Executive Order", "CAATSA Section", "For more information", "Website", "Email Address", "Phone Number", "Telephone", "Fax", "Vessel Year of Build", "Former Vessel Flag", "Aircraft Manufacture Date", "Aircraft Model", "Aircraft Operator",
]
KIND_OF = {label.lower(): kind for kind, labels in DOCUMENTS.items() for label in labels}
FIELD_OF = {label.lower(): kind for label, kind in FIELDS.items()}


def labelled(labels) -> re.Pattern:
    """A segment that begins with one of the labels, the longest first."""
    either = "|".join(re.escape(x) for x in sorted(labels, key=lambda x: (-len(x), x)))
    return re.compile(rf"({either})\.?(?=[\s#:]|\Z)[\s#:]*(.*)", re.I | re.S)


FIELD, DOCUMENT, TALK = labelled(FIELDS), labelled(KIND_OF), labelled(PROSE)
CURRENCY = re.compile(r"Digital Currency Address\s*-\s*([^\W_]+)\s+(\S+)", re.I)
WHEN = r"\b(?:issued|expires|expired)\b"
DATED = re.compile(rf"(issued|expires|expired)\s+(?:on\s+)?(.*?)(?=\s+{WHEN}|\Z)", re.I | re.S)
QUALIFIER = re.compile(r"\s+\(([^)]*)\)\s*\Z")
CODE = re.compile(r"[^\W_](?:[^\W_]|[\s._()/-])*")
QUOTES = "'\"“”‘’"


def document_of(label: str, rest: str) -> dict | None:
    """The identifier of a document's segment; None where what follows the label is no code."""
    dates: dict[str, dict | None] = {}
    for word, date in DATED.findall(rest):
        dates.setdefault(word.lower(), parse_date(date))
    head, inner = re.split(rf"\s+{WHEN}", rest, maxsplit=1, flags=re.I)[0], []
    while m := QUALIFIER.search(head):
        inner.insert(0, m[1])
        head = head[: m.start()]
    value = head.strip()
    if not value or len(value) > 40 or not CODE.fullmatch(value) or not (re.search(r"\d", value) or value == value.upper()):
        return None
    note = label if len(inner) < 2 else f"{label} ({', '.join(inner[:-1])})"
    return paper(KIND_OF[label.lower()], value, note, inner[-1].strip() or None if inner else None, dates.get("issued"), dates.get("expires") or dates.get("expired"))


def paper(kind: str, value: str, note: str | None, country: str | None = None, issued: dict | None = None, expires: dict | None = None) -> dict | None:
    normal = "".join(c for c in value.lower() if c.isalnum())
    return {"kind": kind, "value": value, "normalized_value": normal, "country": country, "issued_on": issued, "expires_on": expires, "note": note} if normal else None


READ = StructType([
    StructField("dates_of_birth", ArrayType(PDATE)), StructField("places_of_birth", ArrayType(StringType())), StructField("nationalities", ArrayType(StringType())), StructField("genders", ArrayType(StringType())),
    StructField("aliases", ArrayType(NAME)), StructField("identifiers", ArrayType(IDENTIFIER)), StructField("segments", IntegerType()), StructField("extracted", IntegerType()), StructField("recognized", IntegerType()), StructField("unknown", ArrayType(StringType())),
])


@lru_cache(maxsize=50_000)
def read_line(text: str) -> dict:
    """What the segments of a line say."""
    out = {f.name: [] for f in READ.fields} | {"segments": 0, "extracted": 0, "recognized": 0}

    def field(label: str, value: str) -> bool:
        kind = FIELD_OF[label.lower()]
        if kind == "dob":
            date = parse_date(value)
            return date is not None and not out["dates_of_birth"].append(date)
        if kind in ("aka", "fka", "nka"):
            name = value.strip()
            for _ in range(2):  # one quote at each end
                name = name[1:] if name[:1] and name[0] in QUOTES else name[:-1] if name[-1:] and name[-1] in QUOTES else name
            return bool(name.strip()) and not out["aliases"].append({"value": name.strip(), "kind": kind, "quality": None, "script": None})
        out[{"pob": "places_of_birth", "nationality": "nationalities", "gender": "genders"}[kind]].append(value)
        return True

    def identifier(found: dict | None) -> bool:
        return found is not None and not out["identifiers"].append(found)

    trimmed = lambda x: re.sub(r"\s*\.\Z", "", x).strip()
    for segment in (s.strip() for s in text.split(";")):
        if not segment:
            continue
        out["segments"] += 1
        body = re.sub(r"\Aalt\.\s+", "", segment, flags=re.I)
        f, d, c = FIELD.fullmatch(body), DOCUMENT.fullmatch(body), CURRENCY.fullmatch(trimmed(body))
        if (f and trimmed(f[2]) and field(f[1], trimmed(f[2]))) or (d and trimmed(d[2]) and identifier(document_of(d[1], trimmed(d[2])))) or (c and identifier(paper("other", c[2], f"{c[1].upper()} address"))):
            out["extracted"] += 1
            out["recognized"] += 1
        elif TALK.fullmatch(body):
            out["recognized"] += 1
        else:
            out["unknown"].append(re.sub(r"\d", "#", " ".join(segment.split()[:3])))
    return out


@F.pandas_udf(READ)
def read_remarks(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The fields of each published line."""
    names = READ.fieldNames()
    for s in lines:
        rows = [read_line(x or "") for x in s]
        yield pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in names})


def coverage(segments: DataFrame) -> DataFrame:
    """(segments, extracted, recognized, ratio) over rows of read_remarks."""
    sums = segments.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("segments", "extracted", "recognized")])
    return sums.withColumn("ratio", F.when(F.col("segments") == 0, 0.0).otherwise(F.try_divide("recognized", "segments")))


def unknown_shapes(segments: DataFrame, limit: int = 10) -> DataFrame:
    """(shape, n): the commonest beginnings of segments that nothing recognised."""
    return segments.select(F.explode("unknown").alias("shape")).groupBy("shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape").limit(limit)
