"""XML lists: records by element name through Spark's XML source, with a schema, so that ids stay text. A document that is cut off
or broken is refused as a whole."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from veritrace.errors import MalformedDocument
from veritrace.functions.fold import collapsed


def fields(text: str) -> StructType:
    """A schema of text elements: "a b @c d[e f] g*": @ marks an attribute, * a repeated element, [ ] what stands inside (always as an
    array of records)."""
    words, out = text.replace("[", " [ ").replace("]", " ] ").split(), StructType([])
    stack = [out]
    for k, w in enumerate(words):
        if w == "[":
            inner = StructType([])
            last = stack[-1].fields.pop()
            stack[-1].names.pop()
            stack[-1].add(StructField(last.name, ArrayType(inner)))
            stack.append(inner)
        elif w == "]":
            # The array type holds the record type itself, which is complete now.
            stack.pop()
        else:
            name = w.rstrip("*")
            name = "_" + name[1:] if name.startswith("@") else name
            stack[-1].add(StructField(name, ArrayType(StringType()) if w.endswith("*") else StringType()))
    return out


def roots(spark: SparkSession, path: str) -> DataFrame:
    """(path, root, attributes): checks that each document is whole and well formed, and gives its root element."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                first: list[tuple[str, dict]] = []
                parser = expat.ParserCreate()
                parser.StartElementHandler = lambda tag, attributes: first or first.append((tag.rpartition(":")[2], attributes))  # noqa: B023
                try:
                    parser.Parse(raw, True)
                except expat.ExpatError as e:
                    raise MalformedDocument(f"{name} is no whole XML document: {e}") from None
                tag, attributes = first[0]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([tag]), pa.array([list(attributes.items())], pa.map_(pa.string(), pa.string()))], names=["path", "root", "attributes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(check, "path string, root string, attributes map<string,string>")


def read_records(spark: SparkSession, path: str, element: str, schema: StructType) -> DataFrame:
    """The elements of one name as rows of the schema; namespaces are left out of names."""
    options = {"rowTag": element, "mode": "FAILFAST", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_text", "nullValue": "", "ignoreSurroundingSpaces": "true"}
    return spark.read.format("xml").options(**options).schema(schema).load(path)


def text(value: Column) -> Column:
    """White space collapsed; blank is null."""
    return collapsed(value)


def texts(value: Column) -> Column:
    """The texts of a repeated element, without blanks."""
    return F.filter(F.transform(F.coalesce(value, F.array().cast("array<string>")), collapsed), lambda x: x.isNotNull())


def inside(nested: Column, *path: str) -> Column:
    """The records at a path of nested arrays of records, as one array."""

    def step(records: Column, name: str) -> Column:
        return F.flatten(F.transform(F.filter(records, lambda x: x[name].isNotNull()), lambda x: x[name]))

    out = F.coalesce(nested, F.array())
    for name in path:
        out = step(out, name)
    return out
