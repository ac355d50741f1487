"""Shared pieces of the training-data operators: words, shared storage, row keys."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside these, as a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: Folders that this driver has made, and its temporary folder on a local master.
MADE: list[str] = []
_LOCAL: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; on a local master a temporary one will do."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="veritrace-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/veritrace/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a table in the shared folder, reread. It outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While it is open, batches for Python have at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders made by new_path(), once nothing will read them again."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in MADE:
            MADE.remove(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the tables of written() that df reads, when everything made from them is written elsewhere."""
    files = " ".join(df.inputFiles())
    removed(spark, [p for p in list(MADE) if p.rsplit("/", 1)[1] in files])


def text_of(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of non-space characters, in order."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often and in whatever lambda body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def row_key(*names: str) -> Column:
    """A hash that, beside the id, tells rows with one id but unlike content apart."""
    return F.xxhash64(*names)


def open_shared(uri: str):
    """A random-access file of the shared folder, opened from a worker."""
    from urllib.parse import unquote

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("file:///", "/").replace("file:/", "/") if uri.startswith("file:") else uri)
    return store.open_input_file(unquote(path) if uri.startswith("file:") else path)


def create_shared(uri: str):
    """A new file of the shared folder, written from a worker."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.removeprefix("file://") if uri.startswith("file:///") else uri)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def list_shared(uri: str) -> list[str]:
    """The files right below a folder of the shared folder, as URIs for open_shared()."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    head = uri[: len(uri) - len(path)]
    return sorted(head + x.path for x in store.get_file_info(fs.FileSelector(path)) if x.is_file)


def named_apart(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df has not (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_{name}"
        while new in taken:
            new = f"_{new}"
        out.append(new)
        taken.add(new)
    return out
