"""Token-id files (op6) and token counts (op4).

Writer: for an index, documents are range-partitioned and sorted by id; each task streams the ids of its documents into one payload file
(flat little-endian, 16 bits where the vocabulary allows, else 32) and, with ``keyed``, an index beside it: a minimal
perfect hash from a document's key (its id and number among rows of that id in the file) to slots with a stored
fingerprint, the offset and the length. A retried task writes under a fresh name; the manifest, committed by Spark, names
the files that count. Prefix sums over the manifest (a row per file) give global starts.

Reader (op6): each key goes through the hash, its fingerprint is checked, and its ids are read at the stored offset.

Counter (op4): files without index are read in blocks; each block is searched for the end id at once, and gives its number
of ends and the length of its open head and tail. A prefix scan over blocks stitches what crosses them: ordinals are sums
of earlier ends, and a document that ends in a block starts after the last end before it.

Defined cases: null text is empty (the end id alone); null ids come first; repeated rows are written each; an empty table
gives no files; a file without end ids counts as one open document (`closed` false); other columns are ignored.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import create_shared, new_path, open_shared, text_of, written
from .mph import PerfectHash, mix

MANIFEST = "shard int, part int, path string, n_docs long, n_tokens long, width int"
FEW = 256  # texts encoded at once
MOST_WORDS, LONG_WORD = 1_500_000, 64  # words whose ids a worker holds, and the length of the longest
PROBED = 2048  # by_word: one text in so many is encoded whole too, and must give the same ids
UNLIKE = "this tokenizer does not drop blanks"


def encoder(path: str, literal: bool = False):
    """texts -> lists of ids. literal: the strings of special tokens in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    t.encode_special_tokens = literal
    batch = getattr(t, "encode_batch_fast", t.encode_batch)
    return (lambda texts: [x.ids for x in batch(texts, add_special_tokens=False)]), t.get_vocab_size()


def split_words(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def word_encoder(path: str, literal: bool, kind: str):
    """words without blanks -> the bytes of each one's ids. One call for all of them: a special token stands between."""
    encode, _ = encoder(path, literal)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    special = {x.content: i for i, x in t.get_added_tokens_decoder().items() if x.special}
    if not special:
        return lambda words: [np.array(ids, kind).tobytes() for ids in encode(words)]
    mark, mark_id = next(iter(special.items()))
    joined, width, few = encoder(path)[0], int(kind[-1]), mark[:2]

    def packed(words: list[str]) -> list[bytes]:
        odd = {k: w for k, w in enumerate(words) if few in w}  # may hold a special token, or a part of one
        plain = ["" if few in w else w for w in words] if odd else words
        out: list[bytes] = []
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.array(joined([mark.join([*some, ""])])[0], kind)
            ends = np.flatnonzero(ids == mark_id).tolist()
            raw = ids.tobytes()
            out += [raw[i * width : j * width] for i, j in zip([0, *(e + 1 for e in ends)], ends)]
        for k, ids in zip(odd, encode(list(odd.values()))):
            out[k] = np.array(ids, kind).tobytes()
        return out

    return packed


@lru_cache(maxsize=1)  # a worker's tasks share the words
def packer(path: str, end_id: int, literal: bool, by_word: bool):
    """texts -> the bytes of each one's ids with the end id, and the bytes of an id. by_word: see write_files."""
    encode, vocabulary = encoder(path, literal)
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], kind).tobytes()
    if not by_word:
        return (lambda texts: [np.array(ids, kind).tobytes() + end for ids in encode(texts)]), int(kind[-1])
    for probe in (" a", "a b", "a \n\t b\r", "A. (b's"):
        if encode([probe])[0] != [i for x in encode(split_words(probe)) for i in x]:
            raise ValueError(UNLIKE)
    words_encoder = word_encoder(path, literal, kind)
    held: dict[str, bytes] = {}

    def packed(texts: list[str]) -> list[bytes]:
        words = [split_words(t) for t in texts]
        if len(held) > MOST_WORDS:
            held.clear()
        new = list(set().union(*words).difference(held))
        held.update(zip(new, words_encoder(new)))
        out = [b"".join(map(held.__getitem__, w)) + end for w in words]
        probes = [k for k, t in enumerate(texts) if zlib.crc32(t.encode("utf-8", "replace")) % PROBED == 0]
        for k, ids in zip(probes, encode([texts[k] for k in probes])) if probes else ():
            if np.array(ids, kind).tobytes() + end != out[k]:
                raise ValueError(UNLIKE)
        for w in new:  # what stays held is bounded in number and length
            if len(w) > LONG_WORD:
                del held[w]
        return out

    return packed, int(kind[-1])


def keys_of(ids: list, nth: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit keys of (id, number among equal ids) in one file."""
    raw = np.array([0 if x is None else x for x in ids], np.int64).view(np.uint64)
    none = np.array([x is None for x in ids], np.uint64)
    return mix(mix(raw, 101 + 10 * seed) + nth.astype(np.uint64), 102) ^ none


def numbered(ids: list) -> np.ndarray:
    """ids ascend: the number of each among its equals."""
    out = np.zeros(len(ids), np.int64)
    for i in range(1, len(ids)):
        if ids[i] == ids[i - 1]:
            out[i] = out[i - 1] + 1
    return out


def _index(ids: list, lengths: list[int]) -> bytes:
    seed, nth = 0, numbered(ids)
    while len(np.unique(keys := keys_of(ids, nth, seed))) < len(keys):
        seed += 1  # two documents share a key: another seed parts them
    table = PerfectHash.build(keys)
    slots = table.slots(keys)
    n = np.array(lengths, np.int64)
    prints, offsets, sizes = (np.zeros(len(keys), np.int64) for _ in range(3))
    prints[slots], offsets[slots], sizes[slots] = mix(keys, 103).view(np.int64), np.cumsum(n) - n, n
    out = io.BytesIO()
    none = np.array([x is None for x in ids], bool)
    parts = {k: np.frombuffer(v, np.uint8) for k, v in table.parts().items()}
    np.savez(out, seed=np.array([seed]), ids=np.array([x or 0 for x in ids], np.int64), none=none, prints=prints, offsets=offsets, lengths=sizes, **parts)
    return out.getvalue()


def write_files(docs: DataFrame, *, tokenizer: str, end_id: int, keyed: bool = True, literal: bool = False, by_word: bool = False, file_tokens: int = 1 << 27, file_docs: int = 1 << 20) -> DataFrame:
    """Writes the files; the manifest, a row per file.

    keyed: documents ascend by id, with an index; else they stay in their partitions (no shuffle), and the ids alone are
    listed beside the payload. by_word: the tokenizer drops blanks and no token reaches across one, so each distinct word
    between blanks is encoded once per worker (while held) and its ids are joined; the ids are those of the whole text. A sample
    of texts is held against whole encoding, and where that differs all is written anew without by_word.
    """
    folder = new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch], joined: bool) -> Iterator[pa.RecordBatch]:
        packed, width = packer(tokenizer, end_id, literal, joined)
        kinds = [("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]
        part, path, out, ids, lengths, total = 0, "", None, [], [], 0
        few = min(FEW, file_docs)

        def closed() -> pa.RecordBatch:
            out.close()
            with create_shared(f"{path}.idx") as f:
                f.write(_index(ids, lengths) if keyed else json.dumps(ids).encode())
            row = [TaskContext.get().partitionId(), part, path, len(ids), total, width]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(names), few):
                some = packed(texts.slice(k, few).to_pylist())
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}"
                    out = create_shared(f"{path}.bin")
                out.write(b"".join(some))
                lengths += [len(x) // width for x in some]
                total += sum(len(x) // width for x in some)
                ids += names[k : k + few]
                if total >= file_tokens or len(ids) >= file_docs:
                    yield closed()
                    part, out, ids, lengths, total = part + 1, None, [], [], 0
        if out is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if keyed:
        rows = rows.withColumn("tie", F.xxhash64("text"))
        rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    rows = rows.select("doc_id", "text")
    try:
        return written(rows.mapInArrow(lambda batches: write(batches, by_word), MANIFEST), "tokens-manifest")
    except Exception as e:
        if not by_word or UNLIKE not in str(e):
            raise
        return written(rows.mapInArrow(lambda batches: write(batches, False), MANIFEST), "tokens-manifest")


def _started(manifest: DataFrame) -> DataFrame:
    """(path, start, width) of each file, one per partition: the driver sums a number per file."""
    spark, at, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.collect(), key=lambda r: (r["shard"], r["part"])):
        rows.append((r["path"], at, r["width"], r["n_tokens"], r["shard"], r["part"]))
        at += r["n_tokens"]
    df = spark.createDataFrame(rows, "path string, start long, width int, n_tokens long, shard int, part int")
    return df.repartition(max(1, min(len(rows), 4096)), "path")


def read_files(manifest: DataFrame, block_bytes: int = 1 << 24) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every key, through the index and the payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_shared(f"{r['path']}.idx") as f:
                    z = dict(np.load(io.BytesIO(f.read())))
                table = PerfectHash.of(z["bits"].tobytes(), z["sizes"].tobytes(), z["rest"].tobytes())
                ids = [None if n else int(i) for i, n in zip(z["ids"], z["none"])]
                keys = keys_of(ids, numbered(ids), int(z["seed"][0]))
                slots = table.slots(keys)
                if len(keys) and not (slots.min() >= 0 and (z["prints"][slots] == mix(keys, 103).view(np.int64)).all()):
                    raise ValueError(f"{r['path']}: a key is not in the index")
                offsets, lengths = z["offsets"][slots], z["lengths"][slots]
                crcs, width = np.zeros(len(keys), np.int64), r["width"]
                order = np.argsort(offsets, kind="stable").tolist()
                with open_shared(f"{r['path']}.bin") as f:
                    raw, begin, end = b"", 0, 0
                    for k in order:
                        lo, n = int(offsets[k]) * width, int(lengths[k]) * width
                        if lo + n > end:
                            raw, begin = f.read_at(max(n, block_bytes), lo), lo
                            end = begin + len(raw)
                        own = np.frombuffer(raw, f"<u{width}", int(lengths[k]), lo - begin)
                        crcs[k] = zlib.crc32(own.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(offsets + r["start"]), pa.array(lengths), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _started(manifest).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def separator_scan(files: DataFrame, *, end_id: int, block_tokens: int = 1 << 20) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of every document in flat files (path, width, n_tokens)."""
    n_blocks = F.ceil(F.col("n_tokens") / block_tokens).cast("long")
    blocks = files.where(F.col("n_tokens") > 0).select("path", "width", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("block"))
    schema = "path string, block long, first long, last long, ends array<long>, n_tokens long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        for batch in batches:
            for r in batch.to_pylist():
                begin = r["block"] * block_tokens
                with open_shared(f"{r['path']}.bin") as f:
                    raw = f.read_at(min(block_tokens, r["n_tokens"] - begin) * r["width"], begin * r["width"])
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{r['width']}") == end_id) + begin
                row = [r["path"], r["block"], int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, ends, r["n_tokens"]]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["path", "block", "first", "last", "ends", "n_tokens"])

    found = written(blocks.repartition("path", "block").mapInArrow(search, schema), "tokens-ends")
    # The prefix scan runs over a few numbers per block, without the ends.
    line = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("path", "block", "last", F.size("ends").alias("n")).select(
        "path", "block", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(line), F.lit(-1)).alias("open")
    )
    rows = found.join(scan, ["path", "block"]).select("path", "before", "open", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.get("ends", F.col("k") - 1)) + 1
    closed = rows.select("path", (F.col("before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start + 1).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = found.groupBy("path", "n_tokens").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.sum(F.size("ends")).alias("ordinal"))
    tails = tails.where(F.col("last") < F.col("n_tokens") - 1).select("path", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n_tokens") - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def names_of(files: DataFrame) -> DataFrame:
    """(path, ordinal, doc_id) from the lists beside flat files: which document an ordinal is."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_shared(f"{path}.idx") as f:
                    ids = json.loads(f.read())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())], names=["path", "ordinal", "doc_id"])

    return files.select("path").mapInArrow(read, "path string, ordinal long, doc_id long")


def token_report(docs: DataFrame, *, tokenizer: str, end_id: int = 1, by_word: bool = False) -> DataFrame:
    return read_files(write_files(docs, tokenizer=tokenizer, end_id=end_id, by_word=by_word))


def count_report(docs: DataFrame, *, tokenizer: str, end_id: int = 49407, by_word: bool = False) -> DataFrame:
    """Token counts (end id included) of every document, out of flat files alone; the ids only name the ordinals."""
    files = _started(write_files(docs, tokenizer=tokenizer, end_id=end_id, keyed=False, literal=True, by_word=by_word))
    return separator_scan(files, end_id=end_id).join(names_of(files).hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")
