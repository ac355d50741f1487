"""Workbooks (XLSX): the cells of one sheet as text, by the standard library alone. A numeric cell becomes a date only where its
style says so, with the precision that the style shows."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.errors import InvalidArgument, ParseError
from veritrace.schema import clean
from veritrace.sources.delimited import snake

#: Numbers of built-in date formats that show the day, and the largest serial number of a date (fixed values).
DAY_FORMATS = {14, 15, 16, 22, *range(27, 37), *range(50, 59)}
MONTH_FORMATS = {17}
LAST_SERIAL = 2_958_465
MOST_BYTES = 1 << 30


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def unescaped(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def plain_text(element) -> str:
    """The text of a string element, without phonetic runs."""
    parts = []
    for x in element:
        if local(x.tag) == "t":
            parts.append(x.text or "")
        elif local(x.tag) == "r":
            parts += [t.text or "" for t in x if local(t.tag) == "t"]
    return unescaped("".join(parts))


class Workbook:
    def __init__(self, raw: bytes):
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile as e:
            raise ParseError(f"no workbook: {e}") from None
        for x in self.archive.infolist():
            if x.flag_bits & 1:
                raise ParseError(f"{x.filename} is encrypted")
            if x.file_size > MOST_BYTES or x.header_offset >= 0xFFFFFFFF:
                raise ParseError(f"{x.filename} is larger than a workbook's part may be")
        book = self.part("xl/workbook.xml")
        self.base_1904 = any(local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book.iter())
        links = {x.get("Id"): x.get("Target") for x in self.part("xl/_rels/workbook.xml.rels").iter() if local(x.tag) == "Relationship"}
        self.sheets = [(x.get("name"), self.at(links[next(v for k, v in x.attrib.items() if local(k) == "id")])) for x in book.iter() if local(x.tag) == "sheet"]
        strings = self.part("xl/sharedStrings.xml", optional=True)
        self.strings = [plain_text(x) for x in strings if local(x.tag) == "si"] if strings is not None else []
        self.precisions = self.styles()

    @staticmethod
    def at(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def part(self, name: str, optional: bool = False):
        if name not in self.archive.namelist():
            if optional:
                return None
            raise ParseError(f"the workbook has no {name}")
        try:
            return ElementTree.fromstring(self.archive.read(name))  # reading verifies size and checksum
        except (zipfile.BadZipFile, ElementTree.ParseError) as e:
            raise ParseError(f"{name}: {e}") from None

    def styles(self) -> list[str | None]:
        """The date precision of each cell style."""
        root = self.part("xl/styles.xml", optional=True)
        if root is None:
            return []
        codes = {int(x.get("numFmtId")): x.get("formatCode") for x in root.iter() if local(x.tag) == "numFmt"}
        cells = next((x for x in root if local(x.tag) == "cellXfs"), [])
        return [self.precision(int(x.get("numFmtId") or 0), codes) for x in cells]

    @staticmethod
    def precision(number: int, codes: dict[int, str]) -> str | None:
        if number not in codes:
            return "day" if number in DAY_FORMATS else "month" if number in MONTH_FORMATS else None
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.', "", codes[number].split(";")[0]).lower()
        if "d" in code:
            return "day"
        if "y" in code:
            return "month" if "m" in code else "year"
        return None

    def sheet(self, wanted) -> str:
        if isinstance(wanted, int):
            found = self.sheets[wanted : wanted + 1]
        elif isinstance(wanted, re.Pattern):
            found = [s for s in self.sheets if wanted.search(s[0])]
            if len(found) > 1:
                raise ParseError(f"more than one sheet is named like {wanted.pattern}: {', '.join(s[0] for s in found)}")
        else:
            found = [s for s in self.sheets if s[0] == wanted]
        if not found:
            raise ParseError(f"no sheet {wanted!r}; there are {', '.join(s[0] for s in self.sheets)}")
        return found[0][1]

    def date(self, serial: int, precision: str) -> str | None:
        if not 1 <= serial <= LAST_SERIAL or not self.base_1904 and serial == 60:
            return None
        base = dt.date(1904, 1, 1) if self.base_1904 else dt.date(1899, 12, 31) if serial < 60 else dt.date(1899, 12, 30)
        return (base + dt.timedelta(serial)).isoformat()[: {"day": 10, "month": 7, "year": 4}[precision]]

    def cell(self, x) -> str | None:
        kind, inner = x.get("t") or "n", {local(c.tag): c for c in x}
        if kind == "inlineStr":
            return plain_text(inner["is"]) if "is" in inner else None
        raw = inner["v"].text if "v" in inner else None
        if raw is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(raw)] if int(raw) < len(self.strings) else None
        if kind == "b":
            return "true" if raw == "1" else "false"
        if kind == "str":
            return unescaped(raw)
        style = int(x.get("s") or 0)
        precision = self.precisions[style] if style < len(self.precisions) else None
        if precision:
            return self.date(int(float(raw)), precision) or raw
        return raw[:-2] if raw.endswith(".0") else raw

    def rows(self, wanted) -> Iterator[tuple[int, list[str | None]]]:
        number = 0
        for row in (x for x in self.part(self.sheet(wanted)).iter() if local(x.tag) == "row"):
            number = int(row.get("r") or number + 1)
            cells: list[str | None] = []
            for x in (c for c in row if local(c.tag) == "c"):
                letters = re.match("[A-Z]+", x.get("r") or "")
                at = len(cells)
                if letters:
                    at = 0
                    for c in letters[0]:
                        at = 26 * at + ord(c) - 64
                    at -= 1
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self.cell(x)
            if any(c is not None and c.strip() for c in cells):
                yield number, cells


def read_sheet(spark: SparkSession, path: str, sheet=0, null: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(line, columns ...) of a sheet's rows below its header, and warnings of rows wider than that."""
    if not isinstance(sheet, (int, str, re.Pattern)):
        raise InvalidArgument("a sheet is named by number, name or pattern")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = list(Workbook(raw).rows(sheet))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["line", "fields"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "line long, fields array<string>").cache()
    head = raw.orderBy("line").first()
    if head is None:
        raise ParseError(f"{path}: the sheet is empty")
    columns = [snake(x or "") or f"column_{k + 1}" for k, x in enumerate(head["fields"])]
    body = raw.where(F.col("line") != head["line"])
    value = lambda k: clean(F.get("fields", F.lit(k))) if null is None else F.nullif(clean(F.get("fields", F.lit(k))), F.lit(null))
    wide = F.exists(F.slice("fields", len(columns) + 1, 16384), lambda x: clean(x).isNotNull())
    warnings = body.where(wide).select("line", F.lit(f"row has cells past the {len(columns)} columns of the header").alias("message"), F.lit(None).cast("string").alias("snippet"))
    return body.select("line", *[value(k).alias(c) for k, c in enumerate(columns)]), warnings
