"""Partial dates: a year, a month, a day or a range, perhaps approximate, with the interval that they cover."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, StructField, StructType

POINT = StructType([StructField("year", IntegerType()), StructField("month", IntegerType()), StructField("day", IntegerType())])
PDATE = StructType([*POINT.fields, StructField("from", POINT), StructField("to", POINT), StructField("approximate", BooleanType()), StructField("first_date", DateType()), StructField("last_date", DateType())])

MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if name} | {"sept": 9}
ABOUT = re.compile(r"(?:circa|approximately|approx|about|ca|c)\.?\s+|~\s*", re.I)
ZONE = re.compile(r"(?<=\d)(?:Z|[+-]\d\d:\d\d)\Z")
SPANS = [re.compile(r"(.+?)\s+(?:to|and|through|until)\s+(.+)", re.I | re.S), re.compile(r"(\d{4})\s*[-–—]\s*(\d{4})")]
#: Spellings of a point, by the order of their parts.
SPELLED = [
    (re.compile(r"(?P<y>\d{4})(?:-(?P<m>\d{1,2})(?:-(?P<d>\d{1,2}))?)?", re.A)),
    (re.compile(r"(?P<d>\d{1,2})\s+(?P<n>[a-z]+)\.?,?\s+(?P<y>\d{4})", re.I | re.A)),
    (re.compile(r"(?P<n>[a-z]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})", re.I | re.A)),
    (re.compile(r"(?P<n>[a-z]+)\.?,?\s+(?P<y>\d{4})", re.I | re.A)),
]


def point_date(year: int, month: int | None = None, day: int | None = None, approximate: bool = False) -> dict | None:
    """A point as a row; None where there is no such date."""
    if day is not None and month is None:
        return None
    try:
        first = dt.date(year, 1 if month is None else month, 1 if day is None else day)
    except ValueError:
        return None
    last = first if day is not None else dt.date(year, month or 12, calendar.monthrange(year, month or 12)[1])
    return {"year": year, "month": month, "day": day, "from": None, "to": None, "approximate": approximate, "first_date": first, "last_date": last}


def range_date(start: dict | None, end: dict | None, approximate: bool = False) -> dict | None:
    """The range between two points; None where one is missing, is a range itself, or they run backwards."""
    if not start or not end or start["from"] or end["from"] or start["first_date"] > end["last_date"]:
        return None
    ends = [{k: x[k] for k in ("year", "month", "day")} for x in (start, end)]
    return {"year": None, "month": None, "day": None, "from": ends[0], "to": ends[1], "approximate": approximate, "first_date": start["first_date"], "last_date": end["last_date"]}


@lru_cache(maxsize=100_000)
def _parsed(text: str) -> dict | None:
    text = ZONE.sub("", re.sub(" +", " ", text.strip()))
    about = ABOUT.match(text)
    text = re.sub(r"\Abetween\s+", "", text[about.end() :] if about else text, flags=re.I)
    for span in SPANS:
        if m := span.fullmatch(text):
            if found := range_date(_parsed(m[1]), _parsed(m[2]), bool(about)):
                return found
            break
    for spelled in SPELLED:
        if m := spelled.fullmatch(text):
            part = m.groupdict()
            month = MONTHS.get(part["n"].lower()) if part.get("n") else part.get("m") and int(part["m"])
            if part.get("n") and month is None:
                return None
            return point_date(int(part["y"]), month, part.get("d") and int(part["d"]), bool(about))
    return None


def parse_date(value) -> dict | None:
    """A partial date of a text, or of a row that is one; None where it can't be read, never an error."""
    if value is None:
        return None
    if isinstance(value, dict):
        if value.get("from") or value.get("to"):
            return range_date(parse_date(value.get("from")), parse_date(value.get("to")), bool(value.get("approximate")))
        return point_date(value["year"], value.get("month"), value.get("day"), bool(value.get("approximate"))) if value.get("year") is not None else None
    return _parsed(str(value))


@F.pandas_udf(PDATE)
def _read(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = PDATE.fieldNames()
    for s in texts:
        rows = [parse_date(x) for x in s]
        yield pd.DataFrame({k: pd.Series([None if r is None else r[k] for r in rows], dtype=object) for k in names})


def partial_date(text) -> Column:
    """The partial date of a text; null where it can't be read."""
    found = _read(text)
    return F.when(found["first_date"].isNotNull(), found)


def precision(d: Column) -> Column:
    return F.when(d["from"].isNotNull(), "range").when(d["day"].isNotNull(), "day").when(d["month"].isNotNull(), "month").otherwise("year")


def comparison_ends(d: Column) -> tuple[Column, Column]:
    """The interval that counts in comparisons: an approximate date covers a year more on both sides."""
    widened = lambda x, months: F.when(d["approximate"], F.add_months(x, months)).otherwise(x)
    return widened(d["first_date"], -12), widened(d["last_date"], 12)


def overlaps(a: Column, b: Column) -> Column:
    (a0, a1), (b0, b1) = comparison_ends(a), comparison_ends(b)
    return F.coalesce((a0 <= b1) & (b0 <= a1), F.lit(False))


def conflicts(a: Column, b: Column) -> Column:
    """No overlap; a missing date conflicts with nothing."""
    return a["first_date"].isNotNull() & b["first_date"].isNotNull() & ~overlaps(a, b)


def same_day(a: Column, b: Column) -> Column:
    exact = lambda x: x["from"].isNull() & x["day"].isNotNull() & ~x["approximate"]
    return F.coalesce(exact(a) & exact(b) & (a["first_date"] == b["first_date"]), F.lit(False))


def date_text(d: Column) -> Column:
    """YYYY[-MM[-DD]], "A to B", "circa ..."."""

    def point(x: Column) -> Column:
        two = lambda v: F.when(v.isNotNull(), F.format_string("-%02d", v)).otherwise("")
        return F.concat(F.format_string("%04d", x["year"]), two(x["month"]), two(x["day"]))

    text = F.when(d["from"].isNotNull(), F.concat(point(d["from"]), F.lit(" to "), point(d["to"]))).otherwise(point(d))
    return F.when(d["first_date"].isNotNull(), F.concat(F.when(d["approximate"], "circa ").otherwise(""), text))


def serial_date(serial: Column, base_1904: bool = False) -> Column:
    """The day of a spreadsheet's serial number; serial 60 is the day that the 1900 calendar has too many."""
    if base_1904:
        return F.date_add(F.lit(dt.date(1904, 1, 1)), serial)
    return F.when(serial == 60, None).otherwise(F.date_add(F.lit(dt.date(1899, 12, 30)), F.when(serial < 60, serial + 1).otherwise(serial)))
