"""Name folding, stop words, identifiers, countries and message shapes as Column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

TYPES = ("individual", "organization", "vessel", "aircraft")

#: Letters that compatibility decomposition leaves alone, with their plain spelling.
LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "ð": "d", "þ": "th", "đ": "d", "ħ": "h", "ı": "i", "ł": "l", "ŀ": "l", "ŋ": "n", "ŧ": "t", "ĸ": "k", "ə": "e"}
PLAIN = str.maketrans(LETTERS)
#: Letters that count as punctuation: glottal signs and modifier letters.
SIGNS = {0x294, 0x295, *range(0x2B0, 0x300)}


def fold_text(value: str | None) -> str | None:
    """Decomposed, without marks, case-folded, punctuation as blanks."""
    if value is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) not in ("Mn", "Me"))
    plain = plain.casefold().translate(PLAIN)
    return " ".join("".join(c if (k := unicodedata.category(c))[0] in "LM" and ord(c) not in SIGNS or k == "Nd" else " " for c in plain).split())


@F.pandas_udf(StringType())
def _folded(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in names:
        seen = {x: fold_text(x) for x in s.unique()}
        yield s.map(seen)


def fold(name: Column) -> Column:
    """The folded name. Names in ASCII are folded by built-in functions; the others alone go to Python."""
    name = name if isinstance(name, Column) else F.col(name)
    ascii_only = ~name.rlike(r"[^\x00-\x7F]")
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.when(ascii_only, plain).otherwise(_folded(F.when(~ascii_only, name)))


@dataclass(frozen=True)
class Dictionary:
    """Word lists. Entries that hold a particle are never stop words."""

    #: Fixed values.
    honorifics: tuple[str, ...] = ("MR", "MRS", "MS", "DR", "PROF", "SIR", "HAJJI", "HAJJ", "SHAYKH", "SHEIKH", "SHAIKH", "MULLAH", "MAULAVI", "GENERAL", "COLONEL", "CAPT")
    legal_forms: tuple[str, ...] = (
        "LLC", "L.L.C.", "LTD", "LIMITED", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "PLC", "GMBH", "AG", "AB", "AS", "OY", "KG", "SA", "S.A.", "SARL", "SPA", "SRL", "BV", "NV", "PTE", "PVT", "KK",
        "OOO", "ZAO", "OAO", "PAO", "JSC", "PJSC", "OJSC", "JOINT STOCK COMPANY", "OPEN JOINT STOCK COMPANY", "CLOSED JOINT STOCK COMPANY", "PUBLIC JOINT STOCK COMPANY",
    )
    organization_stopwords: tuple[str, ...] = ("THE", "AND", "OF", "FOR", "AL")
    particles: tuple[str, ...] = ("bin", "ibn", "bint", "abu", "abd", "al", "el", "van", "von", "de", "da", "del", "della", "di", "dos")

    def merge(self, **more: list[str]) -> Dictionary:
        """With further entries of some lists."""
        unknown = set(more) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown word list(s): {', '.join(sorted(unknown))}")
        return replace(self, **{k: tuple(dict.fromkeys([*getattr(self, k), *v])) for k, v in more.items()})

    def phrases(self, kind: str) -> list[str]:
        """The folded stop phrases of an entity type, those of most words first."""
        lists = {"individual": self.honorifics, "organization": self.legal_forms + self.organization_stopwords}.get(kind, ())
        kept = {t for p in self.particles for t in fold_text(p).split()}
        found = {f for x in lists if (f := fold_text(x)) and kept.isdisjoint(f.split())}
        return sorted(found, key=lambda x: (-len(x.split()), x))


DEFAULT = Dictionary()


def without_stop_words(folded: Column, kind: Column, dictionary: Dictionary = DEFAULT) -> Column:
    """Stop phrases removed from left to right, the longest first; a name of nothing else stays as it is. No type: no stop words."""
    out = folded
    for k in TYPES:
        phrases = dictionary.phrases(k)
        if phrases:
            rest = F.trim(F.regexp_replace(F.concat(F.lit(" "), folded, F.lit(" ")), f"(?<= )(?:{'|'.join(map(re.escape, phrases))}) ", ""))
            out = F.when((kind == k) & (rest != ""), rest).otherwise(out)
    return out


def form_of(name: Column, kind: Column, dictionary: Dictionary = DEFAULT) -> Column:
    return without_stop_words(fold(name), kind, dictionary)


def prefilter_key(name: Column) -> Column:
    """The folded name's first 512 characters, for lookups by equality or prefix."""
    return F.substring(fold(name), 1, 512)


def collapsed(value: Column) -> Column:
    """White space as single blanks, none at the ends; blank is null."""
    return F.nullif(F.trim(F.regexp_replace(value, r"(?U)[\s\u0085]+", " ")), F.lit(""))


def identifier_form(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), r"(?U)[^\p{IsAlphabetic}\p{IsDigit}\p{M}]+", "")


def message_shape(line: Column, length: int = 100) -> Column:
    """Each digit masked, white space squeezed; what is longer than `length` is cut and ends in "..."."""
    masked = F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]", "#"), r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.length(masked) > length, F.concat(F.substring(masked, 1, length), F.lit("..."))).otherwise(masked)


# Countries

#: Spellings that lists use beside a country's English name, by code.
SPELLINGS = {
    "AE": ["UAE"], "AX": ["Aland Islands"], "BN": ["Brunei Darussalam"], "BO": ["Bolivia, Plurinational State of", "Plurinational State of Bolivia"],
    "BQ": ["Bonaire, Sint Eustatius and Saba"], "BS": ["The Bahamas"], "BY": ["Byelorussia"], "CC": ["Keeling Islands"],
    "CD": ["Congo, Democratic Republic of the", "Democratic Republic of the Congo", "DR Congo", "Zaire", "Congo (Democratic Republic)"],
    "CG": ["Congo", "Republic of the Congo", "Congo-Brazzaville"], "CI": ["Côte d'Ivoire", "Ivory Coast"], "CN": ["People's Republic of China"],
    "CV": ["Cabo Verde", "Cape Verde"], "CZ": ["Czechia", "Czech Republic"], "DE": ["Federal Republic of Germany"], "EG": ["Arab Republic of Egypt"],
    "FK": ["Falkland Islands (Malvinas)"], "FM": ["Micronesia, Federated States of", "Federated States of Micronesia"], "GB": ["United Kingdom of Great Britain and Northern Ireland", "UK", "Great Britain"],
    "GM": ["The Gambia"], "HK": ["Hong Kong"], "IR": ["Iran, Islamic Republic of", "Islamic Republic of Iran"], "KG": ["Kyrgyz Republic"],
    "KP": ["Korea, Democratic People's Republic of", "Democratic People's Republic of Korea", "DPRK"], "KR": ["Korea, Republic of", "Republic of Korea", "South Korea"],
    "LA": ["Lao People's Democratic Republic"], "LY": ["Libyan Arab Jamahiriya", "State of Libya"], "MD": ["Moldova, Republic of", "Republic of Moldova"],
    "MK": ["Macedonia", "The former Yugoslav Republic of Macedonia"], "MM": ["Burma"], "MO": ["Macao", "Macau"], "NL": ["Netherlands, Kingdom of the", "The Netherlands", "Holland"],
    "PS": ["Palestine, State of", "State of Palestine", "Palestine", "Palestinian"], "RU": ["Russian Federation"], "SH": ["Saint Helena, Ascension and Tristan da Cunha"],
    "SY": ["Syrian Arab Republic"], "SZ": ["Swaziland"], "TL": ["East Timor"], "TR": ["Türkiye", "Turkiye", "Turkey"], "TW": ["Taiwan, Province of China"],
    "TZ": ["Tanzania, United Republic of", "United Republic of Tanzania"], "US": ["United States of America", "USA"], "VA": ["Holy See"], "VE": ["Venezuela, Bolivarian Republic of", "Bolivarian Republic of Venezuela"],
    "VG": ["Virgin Islands (British)"], "VI": ["Virgin Islands (U.S.)"], "VN": ["Viet Nam", "Socialist Republic of Vietnam"],
}


def country_table(spark: SparkSession, spellings: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Folded spelling -> two-letter code: codes and English names of the JVM's locales, and `spellings`. Two claims on one spelling
    are an error."""
    locale = spark._jvm.java.util.Locale
    out: dict[str, str] = {}
    for code in locale.getISOCountries():
        place = locale("", code)
        own = [code, place.getISO3Country(), place.getDisplayCountry(locale.ENGLISH), *(SPELLINGS if spellings is None else spellings).get(code, ())]
        for value in own:
            key = fold_text(value)
            if key and out.setdefault(key, code) != code:
                raise ValueError(f"{value!r} is claimed by both {out[key]} and {code}")
    return out


def country_keys(values: Column, table: dict[str, str]) -> Column:
    """(key, known) of each value: its country's code, or the folded value where no country is known."""
    kind = ArrayType(StructType([StructField("key", StringType()), StructField("known", BooleanType())]))

    @F.pandas_udf(kind)
    def keys(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held: dict[str | None, dict] = {None: {"key": "", "known": False}}
        for batch in lists:
            for v in {v for x in batch if x is not None for v in x} - set(held):
                key = fold_text(v)
                held[v] = {"key": table.get(key, key), "known": key in table}
            yield pd.Series([None if x is None else [held[v] for v in x] for x in batch], dtype=object)

    return keys(values)
