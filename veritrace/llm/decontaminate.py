"""Benchmark decontamination (op2): a prefix-filtered set join, DataFrame operations only.

Every benchmark item is cut into windows of ``window`` consecutive words (an item with fewer words is one window). A
window is the set of its shingles of ``shingle`` words, each with its offset. Exact containment of a window needs all of
its shingles, so one of them is a sufficient prefix.

1. Order: one scan of all documents counts the shingles of the benchmark in them (with map-side combine).
2. Prefix: each distinct window keeps its rarest shingle. A window with a shingle of count 0 stands in no document and goes.
3. Join: a second scan joins the documents' shingles with the prefixes alone, by hash.
4. Bounds: the window must start at word 0 or later and end within the document.
5. Verification: the document's words from that start on are held against the window, word by word.

Shingles and prefixes are broadcast up to ``block`` of them; a larger benchmark takes shuffle joins, in which positions move
without texts and candidates fetch the words of their documents.

Defined cases: a null text has no words; an item without words has no window; a null item_id counts as an item, listed as
an empty string; rows that repeat an id are judged row by row, by id and content; repeated items count once by item_id;
ties between shingles go to the lower offset; very long texts are scanned whole; empty tables give no hits or no rows; other
columns are ignored, and `without` keeps them whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named_apart, row_key, text_of, written

#: Runs of characters that are in no word, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + k) for k in range(size)])


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words): the windows of each item, repeats once."""
    w = F.col("w")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    items = benchmark.select("item_id", item_words(text_of()).alias("w")).where(F.size("w") > 0)
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, window))).alias("words")).distinct()


def _hashed(words: Column, sizes: list[int]) -> Column:
    """The hashes of every shingle of these sizes, those of the first size first."""
    empty = F.array().cast("array<bigint>")

    def places(size: int) -> Column:
        return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: _hash(words, i, size))).otherwise(empty)

    return F.concat(*[places(s) for s in sizes]) if sizes else empty


def _position(place: Column, n_words: Column, sizes: list[int]) -> Column:
    """The word at which the shingle at a place of _hashed begins."""
    out, before = place, F.lit(0)
    for s in sizes[:-1]:
        before = before + F.greatest(n_words - s + 1, F.lit(0))
        out = F.when(place >= before, place - before).otherwise(out)
    return out


def shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(words, size, offset, hash): the shingles of each distinct window."""
    size = F.least(F.size("words"), F.lit(shingle)).cast("int")
    rows = windows.select("words").distinct().withColumn("size", size)
    hashed = F.lit(None).cast("long")
    for s in range(1, shingle + 1):
        hashed = F.when(F.col("size") == s, _hash(F.col("words"), F.col("offset"), s)).otherwise(hashed)
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("offset")).withColumn("hash", hashed)


def prefixes_of(docs: DataFrame, shingles: DataFrame, sizes: list[int], block: int) -> DataFrame:
    """(words, size, offset, hash): the rarest shingle of each window that can stand in a document."""
    parts = written(shingles.select("hash").distinct(), "decon-parts")
    few = parts.count() <= block
    spots = docs.select(F.explode(_hashed(F.col("w"), sizes)).alias("hash"))
    counts = spots.join(F.broadcast(parts) if few else parts, "hash").groupBy("hash").agg(F.count("*").alias("n"))
    ordered = shingles.join(written(counts, "decon-counts"), "hash", "left")
    rarest = ordered.groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "hash")).alias("r"))
    return rarest.where(F.col("r.n") > 0).select("words", "size", "r.offset", "r.hash")


def found_at(rows: DataFrame, prefixes: DataFrame, sizes: list[int], block: int) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, row_key, n_words), and (doc_id, row_key, start, words) of each window where it stands."""
    w, spark = F.col("w"), rows.sparkSession
    start = F.col("position") - F.col("offset")
    bounds = (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    verified = F.slice(w, F.col("start") + 1, F.size("words")) == F.col("words")
    counted = rows.select("doc_id", "row_key", F.size(w).alias("n_words"), "w")
    if prefixes.count() <= block:
        # A mark of each document rides along, so that one scan gives both.
        marks = spark.range(1).select(F.lit(None).cast("array<string>").alias("words"), F.lit(0).alias("size"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("hash"))
        spots = counted.select("*", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), _hashed(w, sizes))).alias("place", "hash"))
        spots = spots.withColumn("place", F.col("place") - 1)
        met = spots.join(F.broadcast(prefixes.unionByName(marks)), "hash").where((F.col("place") < 0) == F.col("words").isNull())
        met = met.withColumn("position", _position(F.col("place"), F.col("n_words"), sizes)).withColumn("start", start)
        met = met.where((F.col("place") < 0) | bounds & verified).select("doc_id", "row_key", "n_words", "start", "words")
        met = written(met, "decon-found")
        return met.where(F.col("words").isNull()).select("doc_id", "row_key", "n_words"), met.where(F.col("words").isNotNull()).drop("n_words").distinct()
    spots = counted.select("doc_id", "row_key", "n_words", F.posexplode(_hashed(w, sizes)).alias("place", "hash"))
    spots = spots.withColumn("position", _position(F.col("place"), F.col("n_words"), sizes))
    near = spots.join(prefixes, "hash").where(bounds).select(F.col("doc_id").alias("c_id"), F.col("row_key").alias("c_key"), start.alias("start"), "words").distinct()
    same = F.col("c_id").eqNullSafe(F.col("doc_id")) & (F.col("c_key") == F.col("row_key"))
    met = counted.join(near, same).where(verified).select("doc_id", "row_key", "start", "words").distinct()
    return counted.drop("w"), written(met, "decon-found")


def find(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shingle: int = 5, block: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, row_key, n_words), and hits as (doc_id, row_key, start, words, item_id): each window where it occurs."""
    windows = written(windows_of(benchmark, window), "decon-windows")
    shingles = written(shingles_of(windows, shingle), "decon-shingles")
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # at most `shingle` values
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), item_words(text_of()).alias("w"))
    prefixes = written(prefixes_of(rows, shingles, sizes, block), "decon-prefixes")
    marks, hits = found_at(rows, prefixes, sizes, block)
    return marks, hits.join(windows, "words").select("doc_id", "row_key", "start", "words", "item_id")


def covered_words(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")
    )
    return F.aggregate(spans, first, step)["n"]


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document with its words, the words hit, and the items whose windows occur."""
    marks, hits = find(docs, benchmark, **options)
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.size("words")).alias("end"))))
    items = F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    by = hits.groupBy("doc_id", "row_key").agg(spans.alias("spans"), items.alias("items"))
    by = by.withColumnsRenamed({"doc_id": "h_id", "row_key": "h_key"})
    rows = marks.join(by, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row_key") == F.col("h_key")), "left")
    n_hit = F.coalesce(covered_words(F.col("spans")), F.lit(0)).cast("long")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "row_key",
    )


def without(docs: DataFrame, contaminated: DataFrame) -> DataFrame:
    """The documents that are not in `contaminated` (doc_id, row_key)."""
    i, k, own = named_apart(docs, "id", "key", "own")
    bad = contaminated.select(F.col("doc_id").alias(i), F.col("row_key").alias(k)).distinct()
    keyed = docs.withColumn(own, row_key("doc_id", "text"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
