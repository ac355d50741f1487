"""Delimited text: rows with line numbers, and warnings for what was mended.

A published file is read whole by one task (they are tens of megabytes), many files by many tasks; what follows is columns.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.errors import ParseError
from veritrace.schema import clean

ROWS = "path string, line long, fields array<string>, problem string"
#: So many bad rows in a row are a file of another kind, not bad rows.
MOST_BAD = 100
SNIPPET = 120


def decoded(raw: bytes, encoding: str) -> tuple[str, bool]:
    """The text without byte order mark and DOS end-of-file, and whether bytes had to be replaced."""
    text = raw.decode("utf-8-sig" if encoding.lower().replace("-", "") == "utf8" else encoding, "replace")
    return text.rstrip("\x1a\r\n \t").rstrip("\x1a") if "\x1a" in text[-8:] else text, "�" in text


def records(text: str, sep: str, quote: str, liberal: bool) -> Iterator[tuple[int, list[str] | None, str | None]]:
    """(line, fields, problem) of each record; fields are None where the record can't be read."""
    lines, at = io.StringIO(text, newline="").readlines(), 0
    while at < len(lines):
        if not lines[at].strip("\r\n"):
            at += 1
            continue
        begin, taken = at, 0

        def feed():
            nonlocal taken
            for x in lines[begin:]:
                taken += 1
                yield x

        try:
            fields = next(csv.reader(feed(), delimiter=sep, quotechar=quote, strict=not liberal))
            yield begin + 1, fields, None
            at = begin + max(taken, 1)
        except (csv.Error, StopIteration) as e:
            yield begin + 1, None, f"row could not be read: {e or 'it does not end'}"
            at = begin + 1


def snake(name: str) -> str:
    """A header cell as a column name."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower())).strip("_")


@dataclass(frozen=True)
class DelimitedTable:
    """columns: their names, or None where the first record names them. null: a value that means none."""

    columns: tuple[str, ...] | None = None
    null: str | None = None
    sep: str = ","
    quote: str = '"'
    encoding: str = "utf-8"
    liberal: bool = False

    def value(self, raw: Column) -> Column:
        """Stripped; blank or the null sign is null."""
        out = clean(raw)
        return out if self.null is None else F.nullif(out, F.lit(self.null.strip()))

    def scan(self, spark: SparkSession, path: str) -> DataFrame:
        sep, quote, encoding, liberal = self.sep, self.quote, self.encoding, self.liberal

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text, replaced = decoded(raw, encoding)
                    if not text.strip():
                        raise ParseError(f"{name} is empty")
                    out, bad = [], 0
                    for line, fields, problem in records(text, sep, quote, liberal):
                        bad = 0 if fields is not None else bad + 1
                        if bad >= MOST_BAD:
                            raise ParseError(f"{name}: {MOST_BAD} rows in a row could not be read; this is no such table")
                        out.append((name, line, fields, problem))
                    if replaced:
                        out.append((name, 0, None, "bytes that are no text in this encoding were replaced"))
                    columns = list(zip(*out)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()))], names=["path", "line", "fields", "problem"])

        files = spark.read.format("binaryFile").load(path).select("path", "content")
        return files.mapInArrow(read, ROWS)

    def read(self, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """(line, columns ...) of the rows, and (line, message, snippet) of the warnings. Short rows end in nulls, further fields go;
        both warn."""
        raw = self.scan(spark, path).cache()
        if raw.isEmpty():
            raise ParseError(f"{path} is empty")
        columns = self.columns
        if columns is None:
            head = raw.where(F.col("fields").isNotNull()).orderBy("line").first()
            columns = tuple(snake(x) or f"column_{k + 1}" for k, x in enumerate(head["fields"]))
            raw = raw.where((F.col("line") != head["line"]) | F.col("fields").isNull())
        n = len(columns)
        rows = raw.where(F.col("fields").isNotNull()).select("line", *[self.value(F.get("fields", F.lit(k))).alias(c) for k, c in enumerate(columns)])
        size = F.size("fields")
        message = F.when(F.col("fields").isNull(), F.col("problem")).when(size < n, F.concat(F.lit(f"row has "), size.cast("string"), F.lit(f" of {n} fields"))).when(
            size > n, F.concat(F.lit("row has "), size.cast("string"), F.lit(f" fields, the further than {n} were dropped")))
        warnings = raw.select("line", message.alias("message"), F.substring(F.array_join("fields", self.sep), 1, SNIPPET).alias("snippet")).where(F.col("message").isNotNull())
        return rows, warnings


def header_names(names: list[str]) -> list[str]:
    return [snake(n) for n in names]
