"""Mixing sources to target weights (op3): a low-discrepancy slot schedule over shuffled equal-token blocks.

1. Sizes by source give targets: shares of ``share`` times all words by weight, none above ``most`` times its source, the
   excess reshared by weight. Sources are labels: the driver holds one number for each.
2. The documents of each source stand in a shuffled order (by hash) on a line of words, cut into blocks of ``block`` words.
   Starts on that line are prefix sums over hash buckets, then inside each bucket: no source is one task's work.
3. Slot j of the schedule falls at the fractional part of j times the golden ratio, and belongs to the source whose
   stretch of cumulative targets holds that point. Slots are ranked per source by chunks of j, then inside each chunk.
4. The slot of rank r takes one block of its source: in each pass over the source's blocks, the golden ratio's multiplier
   (nearest to it of those prime to the number of blocks) steps from block to block, so every block comes once in a pass
   and the blocks of a part of a pass are spread evenly over the line.
5. A source takes slots up to its word budget, the last one in part; slots after that are empty, and a source that the
   schedule leaves short by a slot or two gets those at its end. So targets are met to a word, whatever the constant, while
   the constant decides which blocks are taken and when.
6. Slots and document pieces join by (source, block), and the taken words add up per document. `apply` gives the pieces of a
   document in a pass as one row, in the order of the slots.

Defined cases: a null text has size 0 and nothing is taken of it; a null source is a source, last in order; a source
without words has target 0; repeated rows are documents of their own; ties in the shuffled order go by id and then stand
for equal texts; very long texts span blocks; an empty table gives no rows; other columns stay out of the report, and `apply`
keeps them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import named_apart, text_of, words_of, written

GOLDEN = (math.sqrt(5) - 1) / 2
#: Weights by the place of a source, repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def targets_of(sizes: list[int], share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Water filling: what a full source can't take goes to the others by weight."""
    total, w = share * sum(sizes), [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while left:
        unit = rest / sum(w[i] for i in left)
        full = {i for i in left if w[i] * unit >= most * sizes[i]}
        for i in full or left:
            out[i] = most * sizes[i] if full else w[i] * unit
        if not full:
            break
        rest, left = rest - sum(out[i] for i in full), left - full
    return out


def keyed(docs: DataFrame) -> Column:
    """A hash that tells rows apart (by every column that can be hashed)."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def lined_up(docs: DataFrame, bucket_docs: int) -> DataFrame:
    """(doc_id, key, size, s, start): where each document begins on its source's line. Source is null-safe as `s`."""
    order = F.xxhash64(F.lit("mix"), "doc_id", F.xxhash64("text"))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = docs.select("doc_id", named.alias("s"), F.size(words_of(text_of())).cast("long").alias("size"), order.alias("o"), keyed(docs).alias("key"))
    rows = written(rows, "mix-sizes")
    buckets = max(1, rows.count() // bucket_docs)
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("o", 1) / float(2**63)) * buckets).cast("long"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("bucket")) - F.col("n")
    sums = sums.select(F.col("s").alias("b_s"), F.col("bucket").alias("b_bucket"), before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("s", "bucket").orderBy("o", "doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(sums, (F.col("s") == F.col("b_s")) & (F.col("bucket") == F.col("b_bucket")))
    return written(rows.select("doc_id", "key", "s", "size", (F.col("before") + F.col("inside")).alias("start")), "mix-line")


def step_of(blocks: int, ratio: float) -> int:
    """The whole number nearest to ratio * blocks that is prime to blocks: stepping by it reaches every block once."""
    near = round(ratio * blocks)
    for away in range(blocks + 1):
        for step in (near + away, near - away):
            if 0 < step <= blocks and math.gcd(step, blocks) == 1:
                return step
    return 1


def schedule(spark, highs: list[float], slots: int, chunk: int) -> DataFrame:
    """(i, rank, slot): the source of each slot (highs: upper ends of the sources' stretches of 0 to 1), ranked per source."""
    ratio, ends = np.uint64(int(GOLDEN * 2.0**64) % 2**64), np.array(highs)

    def sources_of(k: int) -> np.ndarray:
        j = np.arange(k * chunk, min((k + 1) * chunk, slots)).astype(np.uint64)
        with np.errstate(over="ignore"):
            point = (j * ratio).astype(np.float64) / 2.0**64
        return np.minimum(np.searchsorted(ends, point, side="right"), len(ends) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, n = np.unique(sources_of(k), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i.astype(np.int32)), pa.array(n.astype(np.int64))], names=["chunk", "i", "n"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, all_before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sources_of(k)
                order = np.argsort(own, kind="stable")
                sizes = np.bincount(own, minlength=len(ends))
                inside = np.empty(len(own), np.int64)
                inside[order] = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                before = np.zeros(len(ends), np.int64)
                for x in all_before:
                    before[x["i"]] = x["before"]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(before[own] + inside), pa.array(k * chunk + np.arange(len(own)))], names=["i", "rank", "slot"])

    chunks = spark.range(-(-slots // chunk)).select("id")
    per = chunks.mapInArrow(count, "chunk long, i int, n long")
    before = F.sum("n").over(Window.partitionBy("i").orderBy("chunk")) - F.col("n")
    per = per.select("chunk", F.struct("i", before.alias("before")).alias("x")).groupBy("chunk").agg(F.collect_list("x").alias("x"))
    return per.mapInArrow(emit, "i int, rank long, slot long")


def pieces_of(docs: DataFrame, *, share: float, most: float, block: int, chunk: int, bucket_docs: int) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, key, size, i, start, source_size, target), and the pieces taken of them (i, start, size, doc_id, key,
    pass, slot, lo, hi), lo and hi counting words of the document."""
    spark = docs.sparkSession
    line = lined_up(docs, bucket_docs)
    by = sorted(((r["s"]["none"], r["s"]["name"].encode(), r["s"], r["n"]) for r in line.groupBy("s").agg(F.sum("size").alias("n")).collect()), key=lambda r: r[:2])
    targets = targets_of([r[3] for r in by], share, most)
    total, high, plan, highs = sum(targets), 0.0, [], []
    for i, (_, _, s, size) in enumerate(by):
        high += targets[i] / total if total else 0.0
        highs.append(high)
        goal, blocks = round(targets[i]), max(1, -(-size // block))
        step, lacks = step_of(blocks, GOLDEN), blocks * block - size
        last = (blocks - 1) * pow(step, -1, blocks) % blocks if blocks > 1 else 0  # when in a pass the short block comes
        passes, rest = divmod(goal, size) if size else (0, 0)
        need = passes * blocks + (-(-rest // block) if rest <= last * block else -(-(rest + lacks) // block))
        plan.append((i, s["none"], s["name"], size, targets[i], goal, blocks, step, last, lacks, need))
    schema = "i int, none boolean, name string, source_size long, target double, goal long, blocks long, step long, last long, lacks long, need long"
    sources = spark.createDataFrame(plan, schema)  # one row per source
    rows = line.select("doc_id", "key", "size", "start", F.col("s.none").alias("none"), F.col("s.name").alias("name"))
    rows = rows.join(F.broadcast(sources.select("i", "none", "name", "source_size", "target")), ["none", "name"]).drop("none", "name")
    n = math.ceil(total / block)
    slots = schedule(spark, highs or [1.0], n, chunk)
    have = slots.groupBy("i").agg(F.max("rank").alias("most"))
    short = sources.join(F.broadcast(have), "i", "left").withColumn("have", F.coalesce(F.col("most") + 1, F.lit(0).cast("long"))).where(F.col("need") > F.col("have"))
    extra = short.select("i", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank")).withColumn("slot", F.lit(n) + F.col("rank"))
    slots = slots.unionByName(extra).join(F.broadcast(sources.drop("none", "name")), "i").where(F.col("rank") < F.col("need"))
    turn, passed = F.expr("rank % blocks"), F.expr("rank div blocks")
    at = F.expr("(rank % blocks) * step % blocks")
    begin = at * block
    before = passed * F.col("source_size") + turn * block - F.when(turn > F.col("last"), F.col("lacks")).otherwise(0)
    take = F.least(F.lit(block), F.col("source_size") - begin, F.col("goal") - before)
    slots = slots.select("i", at.alias("b"), begin.alias("begin"), take.alias("take"), passed.alias("pass"), "slot").where(F.col("take") > 0)
    spread = rows.where(F.col("size") > 0).withColumn("b", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo = F.greatest(F.col("begin") - F.col("start"), F.lit(0))
    hi = F.least(F.col("begin") + F.col("take") - F.col("start"), F.col("size"))
    pieces = spread.join(slots, ["i", "b"]).select("i", "start", "size", "doc_id", "key", "pass", "slot", lo.alias("lo"), hi.alias("hi"))
    return rows, pieces.where(F.col("hi") > F.col("lo"))


def mix(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, block: int = 4096, chunk: int = 65536, bucket_docs: int = 16384) -> DataFrame:
    """Every document with its size, its source's size and target, the words that the mix takes of it, and its first slot."""
    rows, pieces = pieces_of(docs, share=share, most=most, block=block, chunk=chunk, bucket_docs=bucket_docs)
    sums = pieces.groupBy("i", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot"))
    sums = sums.select(F.col("i").alias("t_i"), F.col("start").alias("t_start"), "taken", "first_slot")
    # A document without words shares its start with the next one, and has no piece.
    same = (F.col("i") == F.col("t_i")) & (F.col("start") == F.col("t_start")) & (F.col("size") > 0)
    out = rows.join(sums, same, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def apply(docs: DataFrame, *, share: float = 1.5, most: float = 2.0, block: int = 4096, chunk: int = 65536, bucket_docs: int = 16384) -> DataFrame:
    """The mix itself: the documents' rows in the order of the slots, one for each pass that takes of a document. A document that
    a pass takes in part has those words alone, joined by blanks."""
    _, pieces = pieces_of(docs, share=share, most=most, block=block, chunk=chunk, bucket_docs=bucket_docs)
    parts = pieces.groupBy("i", "start", "size", "doc_id", "key", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("parts"), F.min("slot").alias("slot"))
    key, plan, other, other_key = named_apart(docs, "key", "plan", "other", "other_key")
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"]) == F.col("size")
    # Rows that are there twice share one key: their plans are one list, and one of them stands for all.
    one = F.struct("slot", "pass", "start", whole.alias("whole"), "parts")
    plans = parts.select("doc_id", "key", one.alias("p")).groupBy("doc_id", "key").agg(F.collect_list("p").alias(plan))
    plans = plans.withColumnsRenamed({"doc_id": other, "key": other_key})
    rows = docs.withColumn(key, keyed(docs)).join(plans, (F.col(key) == F.col(other_key)) & F.col("doc_id").eqNullSafe(F.col(other)))
    rows = rows.dropDuplicates([key, other]).withColumn(plan, F.explode(plan))
    p = F.col(plan)
    words = words_of(text_of())
    part = F.array_join(F.flatten(F.transform(p["parts"], lambda x: F.slice(words, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), " ")
    rows = rows.withColumn("text", F.when(p["whole"], F.col("text")).otherwise(part))
    return rows.orderBy(p["slot"], p["pass"], p["start"]).select(*[F.col(f"`{c}`") for c in docs.columns])
