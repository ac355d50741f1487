"""Queries: what is asked about one name, checked and put in rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from veritrace.config import Settings, threshold_of
from veritrace.errors import InvalidArgument, QueryError
from veritrace.functions.dates import parse_date
from veritrace.functions.fold import TYPES, fold_text
from veritrace.schema import IDENTIFIER_KINDS, QUERY

#: Other spellings of the fields.
ALIASES = {
    "date_of_birth": "dates_of_birth", "dob": "dates_of_birth", "dobs": "dates_of_birth", "country": "nationalities", "countries": "nationalities",
    "nationality": "nationalities", "identifier": "identifiers", "source": "sources",
}
MEMBERS = ("name", "type", "dates_of_birth", "nationalities", "identifiers", "sources", "threshold", "limit")
LISTS = ("dates_of_birth", "nationalities", "identifiers", "sources")


def _normal(given: dict) -> dict:
    out, written = {}, {}
    for key, value in given.items():
        member = ALIASES.get(str(key), str(key))
        if member not in MEMBERS:
            raise QueryError(f"unknown query field {key}")
        if written.setdefault(member, key) != key:
            raise QueryError(f"{written[member]} and {key} are the same field: pass one")
        out[member] = [value] if member in LISTS and value is not None and not isinstance(value, (list, tuple)) else value
    return out


def _identifier(value) -> dict:
    row = dict(value) if isinstance(value, dict) else {"value": value}
    unknown = set(row) - {"kind", "value", "country", "issued_on", "expires_on", "note"}
    if unknown:
        raise InvalidArgument(f"unknown identifier field(s): {', '.join(sorted(unknown))}")
    text = str(row.get("value") or "").strip()
    normal = "".join(c for c in text.lower() if c.isalnum())
    kind = str(row.get("kind") or "other").lower()
    if not normal or kind not in IDENTIFIER_KINDS:
        raise InvalidArgument(f"an identifier needs a value and a kind of {', '.join(IDENTIFIER_KINDS)}")
    dates = {}
    for k in ("issued_on", "expires_on"):
        dates[k] = None if row.get(k) is None else parse_date(row[k])
        if row.get(k) is not None and dates[k] is None:
            raise InvalidArgument(f"{k} is not a date: {row[k]!r}")
    return {"kind": kind, "value": text, "normalized_value": normal, "country": (row.get("country") or "").strip() or None, **dates, "note": row.get("note")}


def build(value=None, settings: Settings = Settings(), **overrides) -> dict:
    """One query as a row (without qid). A name, a dict of fields, or fields as keywords, which go before those of the dict."""
    if value is None:
        given = _normal(overrides)
    elif isinstance(value, dict):
        given = {**_normal(value), **_normal(overrides)}
    else:
        given = {**_normal(overrides), "name": value}
    name = str(given.get("name") or "").strip()
    if not fold_text(name):
        raise InvalidArgument("a name is required, with a letter or a digit")
    kind = str(given.get("type") or "").lower() or None
    if kind not in (None, *TYPES):
        raise InvalidArgument(f"unknown type {kind!r}, expected one of {', '.join(TYPES)}")
    dates = [parse_date(x) for x in given.get("dates_of_birth") or []]
    if None in dates:
        raise InvalidArgument(f"not a date of birth: {given['dates_of_birth']!r}")
    sources = given.get("sources")
    if sources is not None and not sources:
        raise QueryError("sources can't be empty: leave it out to screen against every list")
    limit = settings.limit if given.get("limit") is None else given["limit"]
    try:
        limit = int(limit)
    except (TypeError, ValueError):
        raise QueryError(f"limit must be a whole number, got {limit!r}") from None
    if limit < 1:
        raise QueryError(f"limit must be at least 1, got {limit}")
    countries = [str(x).strip() for x in given.get("nationalities") or []]
    return {
        "name": name, "type": kind, "dates_of_birth": dates, "nationalities": list(dict.fromkeys(c for c in countries if c)),
        "identifiers": [_identifier(x) for x in given.get("identifiers") or []], "sources": sources and list(dict.fromkeys(map(str, sources))),
        "threshold": threshold_of(settings.threshold if given.get("threshold") is None else given["threshold"]), "limit": limit,
    }


def queries_of(spark: SparkSession, asked: Iterable, settings: Settings = Settings(), **overrides) -> DataFrame:
    """The queries as a DataFrame; qid is a query's place, or its own "qid"."""
    rows = []
    for k, value in enumerate(asked):
        own = dict(value) if isinstance(value, dict) else value
        qid = str(own.pop("qid")) if isinstance(own, dict) and "qid" in own else str(k)
        rows.append({"qid": qid, **build(own, settings, **overrides)})
    return spark.createDataFrame(rows, QUERY)


def subjects_of(spark: SparkSession, book: Iterable[dict], settings: Settings = Settings()) -> DataFrame:
    """A book of subjects, for rescreening: each with an id of its own, none with sources or a limit. A null threshold takes the run's."""
    rows = []
    for value in book:
        own = {ALIASES.get(k, k): v for k, v in dict(value).items()}
        refused = {"sources", "limit"} & set(own)
        if refused:
            raise InvalidArgument(f"a subject does not take {', '.join(sorted(refused))}: a rescreen runs against one pair of versions and reports every match")
        sid = str(own.pop("id", "") or "").strip()
        if not sid:
            raise InvalidArgument("a subject needs an id")
        threshold = own.pop("threshold", None)
        rows.append({"qid": sid, **build(own, settings), "threshold": None if threshold is None else threshold_of(threshold)})
    return spark.createDataFrame(rows, QUERY)
