"""Line dedup (op10): a sharded minimal perfect hash over distinct line hashes, probed by the documents.

1. One scan gives each document's distinct keys as two independent 64-bit hashes (the seed is hashed first, so the second is
   no function of the first). Their documents are counted with map-side combine: a line that is everywhere is no hot key.
2. All distinct keys are dealt to shards of about ``shard_keys``. A shard is a minimal perfect hash, an array of 32-bit
   fingerprints and an array of counts, in the shared folder.
3. The documents' hashes probe the arrays: they are dealt by shard (Spark splits the shards that hold hot lines, as any
   number of tasks may read one), so a task opens each of its shards once and the index is read about once in all. Only
   hashes of lines at the limit come back, grouped by document.
4. A last scan drops those lines. Texts move once, for the join with the verdicts; lines are never joined.

Defined cases: null or empty text is one empty line; a key without characters is never dropped; each row is a document of
its own, even if its id repeats or is null; very long texts are hashed line by line in linear time; ties cannot arise; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from .common import SPACE_CHARS, list_shared, new_path, open_shared, text_of, written
from .mph import PerfectHash

SHARD = "shard long, bits binary, sizes binary, rest binary, prints binary, counts binary, twins binary"
MOST = (1 << 32) - 1


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), string.ascii_uppercase, string.ascii_lowercase)


def hash_of(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Arrays of a shard's keys (h1, h2, n). Keys that share h1 with another (one pair in 2**64) stand in a list of their own."""
    rows = rows.sort_values(["h1", "h2"], kind="stable")
    h1, h2, n = (rows[c].to_numpy(np.int64) for c in ("h1", "h2", "n"))
    first = np.concatenate([[True], h1[1:] != h1[:-1]])
    keys = h1[first].view(np.uint64)
    table = PerfectHash.build(keys)
    slots = table.slots(keys)
    prints, counts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u4")
    prints[slots], counts[slots] = h2[first].view(np.uint64).astype("<u4"), np.minimum(n[first], MOST)
    twins = np.stack([h1[~first], h2[~first], n[~first]]).astype("<i8")
    return pd.DataFrame([{"shard": int(key[0]), **table.parts(), "prints": prints.tobytes(), "counts": counts.tobytes(), "twins": twins.tobytes()}])


class Shard:
    def __init__(self, folder: str, shard: int):
        import pyarrow.parquet as pq

        names = ["bits", "sizes", "rest", "prints", "counts", "twins"]
        (file,) = [x for x in list_shared(f"{folder}/shard={shard}") if x.endswith(".parquet")]
        with open_shared(file) as f:
            bits, sizes, rest, prints, counts, twins = (pq.ParquetFile(f).read([c]).column(0)[0].as_py() for c in names)
        self.table = PerfectHash.of(bits, sizes, rest)
        self.prints, self.counts = np.frombuffer(prints, "<u4"), np.frombuffer(counts, "<u4")
        self.twins = {(a, b): n for a, b, n in np.frombuffer(twins, "<i8").reshape(3, -1).T.tolist()}

    def counted(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents of each key; 0 where the fingerprint differs."""
        slots = self.table.slots(h1.view(np.uint64))
        at = np.maximum(slots, 0)
        n = np.where((slots >= 0) & (self.prints[at] == h2.view(np.uint64).astype(np.uint32)), self.counts[at], 0).astype(np.int64)
        for k in np.flatnonzero(n == 0) if self.twins else ():
            n[k] = self.twins.get((int(h1[k]), int(h2[k])), 0)
        return n


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(r1, r2, h1, h2): the distinct keys with characters of each row; r1 and r2 name the row by id and text."""
    keys = F.array_distinct(F.transform(F.split(text_of(), "\n"), key_of))
    pairs = F.transform(F.array_remove(keys, ""), lambda k: F.struct(hash_of(k, 1).alias("h1"), hash_of(k, 2).alias("h2")))
    # explode_outer: explode would be pushed down and compute the keys twice
    rows = docs.select(*named(), F.explode_outer(pairs).alias("k"))
    return rows.where(F.col("k").isNotNull()).select("r1", "r2", "k.h1", "k.h2")


def named() -> list[Column]:
    return [F.xxhash64(F.lit(seed), "doc_id", text_of()).alias(f"r{seed}") for seed in (1, 2)]


def index_lines(lines: DataFrame, shard_keys: int) -> tuple[str, int]:
    """Writes the shards of all distinct keys; their folder and number. Shard s holds the keys of h1 mod shards = s."""
    counted = written(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")), "lines-counted")
    shards = max(1, -(-counted.count() // shard_keys))
    path = new_path(lines.sparkSession, "lines-shards")
    dealt = counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long"))
    dealt.groupBy("shard").applyInPandas(build_shard, SHARD).write.partitionBy("shard").parquet(path)
    return path, shards


def probed(lines: DataFrame, folder: str, shards: int, min_documents: int) -> DataFrame:
    """(r1, r2, h1) of the lines whose count is at the limit."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Shard] | None = None
        for batch in batches:
            r1, r2, h1, h2, shard = (batch.column(i).to_numpy() for i in range(5))
            cuts = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(shard)]):
                if held is None or held[0] != shard[lo]:  # rows ascend by shard: each is opened once
                    held = int(shard[lo]), Shard(folder, int(shard[lo]))
                gone = held[1].counted(h1[lo:hi], h2[lo:hi]) >= min_documents
                if gone.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo:hi][gone]) for x in (r1, r2, h1)], names=["r1", "r2", "h1"])

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long")).hint("rebalance", "shard")
    return dealt.sortWithinPartitions("shard").mapInArrow(probe, "r1 long, r2 long, h1 long")


@F.pandas_udf(ArrayType(BooleanType()))
def _marks(hashes: pd.Series, gone: pd.Series) -> pd.Series:
    """Which of a row's line hashes are among those that go (0 stands for a line without characters)."""
    return pd.Series([None if g is None else np.isin(h, g[g != 0]) for h, g in zip(hashes, gone)], dtype=object)


def dedup(docs: DataFrame, *, min_documents: int = 10, shard_keys: int = 250_000) -> DataFrame:
    """Every document with `kept` (its text without the dropped lines), n_lines and n_dropped."""
    if not 0 < min_documents <= MOST:
        raise ValueError("min_documents is out of range")
    lines = written(hashed_lines(docs), "lines-hashed")
    folder, shards = index_lines(lines, shard_keys)
    bad = probed(lines, folder, shards, min_documents).groupBy("r1", "r2").agg(F.collect_set("h1").alias("gone"))
    rows = docs.select("doc_id", text_of().alias("text"), *named()).join(bad, ["r1", "r2"], "left")
    split = F.split("text", "\n")
    hashes = F.transform(split, lambda x: F.when(key_of(x) != "", hash_of(key_of(x), 1)).otherwise(F.lit(0).cast("long")))
    marks = _marks(F.when(F.col("gone").isNotNull(), hashes), F.col("gone"))
    rows = rows.select("doc_id", "text", marks.alias("marks"))
    kept = F.when(F.col("marks").isNull(), F.col("text")).otherwise(F.array_join(F.filter(split, lambda x, i: ~F.get("marks", i)), "\n"))
    dropped = F.coalesce(F.size(F.filter("marks", lambda x: x)), F.lit(0))
    return rows.select("doc_id", kept.alias("kept"), F.size(split).cast("long").alias("n_lines"), F.when(F.col("marks").isNull(), 0).otherwise(dropped).cast("long").alias("n_dropped"))


def report(docs: DataFrame, **options) -> DataFrame:
    return dedup(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
