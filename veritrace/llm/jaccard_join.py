"""N-gram Jaccard join (op5): chosen-path similarity join over sets of word shingles.

1. One scan draws, for each document, the id of its set of shingle hashes, the set's size, a histogram of its tokens over 128
   hash ranges, and the set's first paths. Token sets are not stored. Documents with equal sets form one row of `sets`, so
   copies are never expanded. (A text of fewer words than a shingle is one token.)
2. In each of ``runs`` runs a set follows each of its tokens whose hash, with the path so far, falls under ``branches`` / size:
   about ``branches`` children per node, and sets of similarity t share each with the chance t. Sets on one path share a
   bucket. Tokens on the path itself are drawn anew like any other (their hash with the longer path is independent).
3. Survival of a pair is that of a branching process with mean branches * t > 1. `runs_for` repeats runs until the chance
   that a pair at the threshold shares no leaf is below 1 - ``recall``. Buckets with the same members are one bucket.
4. A bucket of at most ``small`` sets is a leaf. In a larger one a few pivots (sets of least hash) tell by the first
   paths whether half of the members or more have half of their tokens in common with one. If so, splitting would only repeat the bucket, so it is a dense leaf; dense
   leaves whose members mostly share an earlier one become one leaf with it. Other large buckets split by another level of
   tokens, up to ``depth`` levels; what is large then is a dense leaf too. Nothing is capped.
5. Leaves are screened without tokens: two sets' intersection is at most the sum of the smaller counts of their histograms,
   an exact bound. Only sets with a partner left fetch their tokens, by a second scan of their documents alone.
6. Each small leaf is compared in memory. A dense leaf is dealt in pairs of blocks (at most ``block`` sets and
   ``block_tokens`` tokens), so no task holds it whole and no pair is left out.
7. A pair counts in the least of the leaves that both sets are in, so link numbers add up without listing pairs. A leaf gives
   each set the least set of its component there; min-label propagation over those edges gives the classes. (Its joins have the label of a
   large class as hot key; their other side is one row a label, and Spark splits such partitions.)

Defined cases: null text has no words; documents without words have links 0 and a class each; a null or repeated id is a
row of its own; ties take the least id; very long texts are read whole and a few at a time; empty tables give no rows; other
columns are ignored, and `one_each` keeps them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MADE, arrow_rows, named_apart, removed, row_key, text_of, words_of, written
from .mph import mix

RANGES = 128
PIVOTS = 6
#: Rows of an Arrow batch while this runs: lists of hashes are wide.
BATCH_ROWS = 256
#: Rows up to which a list of document keys is broadcast (24 bytes each); a longer one is joined by shuffle.
BROADCAST_ROWS = 2_000_000


def runs_for(recall: float, threshold: float, branches: float) -> int:
    """Runs until pairs at the threshold share a leaf with the target recall, whatever the depth."""
    alive, mean = 1.0, branches * threshold
    for _ in range(200):
        alive = 1 - math.exp(-mean * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def word_hashes() -> Column:
    return F.transform(words_of(text_of()), lambda w: F.xxhash64(w))


# Sets of a batch


def parts_of(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and their lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def places_of(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the stretches of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def token_sets(column: pa.ListArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending tokens of each list of word hashes, one after the other, and how many each has."""
    flat, n = parts_of(column)
    words = flat.view(np.uint64)
    many = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    at = places_of(many) + np.repeat(np.cumsum(n) - n, many)
    width = np.repeat(np.minimum(n, shingle), many)
    token = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        on = width > k
        if on.all():
            token = mix(token ^ words[at + k], k)
        elif on.any():
            token[on] = mix(token[on] ^ words[at[on] + k], k)
    ends = np.cumsum(many)
    sets = [np.unique(token[e - m : e]) for e, m in zip(ends.tolist(), many.tolist())]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64) of stretches."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def drawn_paths(tokens: np.ndarray, sizes: np.ndarray, path: np.ndarray, runs: np.ndarray, branches: float) -> tuple[np.ndarray, np.ndarray]:
    """Paths one level on (uint64) from a path for each set, and the set's row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    limit = np.minimum(branches / np.maximum(sizes, 1), 1.0) * 2.0**64
    paths, rows = [], []
    for r in range(int(runs.max()) if len(runs) else 0):
        h = mix(tokens ^ mix(path, 7 + r)[row], 11 + r)
        hit = h.astype(np.float64) < np.where(runs > r, limit, 0.0)[row]
        paths.append(mix(h[hit], 13))
        rows.append(row[hit])
    if not paths:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(paths), np.concatenate(rows)


def listed(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    """Values as one list for each of n rows."""
    order = np.argsort(rows, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values[order]))


def drawn(docs: DataFrame, shingle: int, runs: int, branches: float) -> DataFrame:
    """(doc_id, row_key, id, size, sig, paths) of each document; id is null without words."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                tokens, sizes = token_sets(batch.column(2), shingle)
                n = len(sizes)
                name = mix(summed(mix(tokens, 21), sizes) ^ mix(sizes.astype(np.uint64), 22), 23).view(np.int64)
                row = np.repeat(np.arange(n), sizes)
                sig = np.bincount(row * RANGES + (tokens >> np.uint64(57)).astype(np.int64), minlength=n * RANGES).reshape(n, RANGES)
                sig = np.minimum(sig, 65535).astype("<u2")
                paths, rows = drawn_paths(tokens, sizes, np.zeros(n, np.uint64), np.full(n, runs), branches)
                columns = [pa.array(name, mask=sizes == 0), pa.array(sizes), pa.array([x.tobytes() for x in sig], pa.binary()), listed(paths.view(np.int64), rows, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row_key", "id", "size", "sig", "paths"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), word_hashes().alias("words"))
    return rows.mapInArrow(walk, f"doc_id {kind}, row_key long, id long, size long, sig binary, paths array<long>")


def sets_of(rows: DataFrame) -> DataFrame:
    """(id, copies, least, rep, size, sig, paths) of each distinct set."""
    rep = F.min(F.struct("row_key", "doc_id")).alias("rep")
    one = [F.first(c).alias(c) for c in ("size", "sig", "paths")]  # equal in all copies
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), rep, *one)


def with_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of `wanted` and the word hashes of the document that each row's `rep` names."""
    keys = wanted.select(F.col("rep.row_key").alias("w_key"), F.col("rep.doc_id").alias("w_id"), *[c for c in wanted.columns if c != "rep"])
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    same = (F.col("row_key") == F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    few = keys.select("w_key", "w_id")
    if wanted.count() <= BROADCAST_ROWS:  # texts that nobody asks for don't move
        rows = rows.join(F.broadcast(few), same, "left_semi")
    # A shuffle join on purpose: it deals the texts evenly before they are hashed.
    return rows.join(keys.hint("merge"), same).select(word_hashes().alias("words"), *[c for c in wanted.columns if c != "rep"])


def children(docs: DataFrame, wanted: DataFrame, shingle: int, branches: float) -> DataFrame:
    """wanted: id, rep, starts (path, runs) -> (path, id) of the next level."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 128):
                batch = whole.slice(k, 128)
                tokens, sizes = token_sets(batch.column(0), shingle)
                starts, n = parts_of_structs(batch.column(2))
                ids, begin = batch.column(1).to_numpy(), np.cumsum(sizes) - sizes
                for j in range(int(n.max()) if len(n) else 0):  # the j-th path of each set that has one
                    own = np.flatnonzero(n > j)
                    at = (np.cumsum(n) - n)[own] + j
                    pick = np.repeat(begin[own], sizes[own]) + places_of(sizes[own])
                    paths, rows = drawn_paths(tokens[pick], sizes[own], starts["path"][at].view(np.uint64), starts["runs"][at], branches)
                    yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids[own][rows])], names=["path", "id"])

    return with_words(docs, wanted).select("words", "id", "starts").mapInArrow(walk, "path long, id long").distinct()


def parts_of_structs(column: pa.ListArray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    values = column.flatten()
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}, n


# Screening by histograms


def may_be_near(size_a, size_b, sig_a: np.ndarray, sig_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether pairs of sets can have the similarity: the intersection is at most the sum of the smaller counts."""
    most = np.minimum(sig_a, sig_b).sum(-1, dtype=np.int64)
    full = np.maximum(size_a, size_b) >= 65535  # counts of such a set may be cut
    most = np.where(full, np.minimum(size_a, size_b), most)
    return most >= threshold * (size_a + size_b - most) - 1e-6


def sigs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, RANGES)


def pivot_shares(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, share): of the pivots of a bucket, the greatest share of the members held against it that are like it. First paths are a
    sample of tokens, so their overlap tells what splitting by further tokens would part."""
    rows = members.join(sets.select("id", "paths"), "id")
    salt = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(PIVOTS)).cast("int").alias("salt")
    first = F.min(F.struct(F.xxhash64("id").alias("o"), F.col("paths").alias("p_paths"))).alias("p")
    pivots = rows.groupBy("path", salt(1)).agg(first)
    pairs = rows.select("path", salt(2), "paths").join(pivots, ["path", "salt"]).select("path", "salt", "paths", "p.p_paths")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sides = []
                for column in (b.column(2), b.column(3)):
                    flat, n = parts_of(column)
                    row = np.repeat(np.arange(len(n)), n)
                    sides.append((mix(flat.view(np.uint64) ^ mix(row.astype(np.uint64), 31), 32), row, n))
                (x, row, n), (y, _, m) = sides
                common = np.bincount(row[np.isin(x, y)], minlength=b.num_rows)
                like = 2 * common >= np.maximum(n, m)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(like.astype(np.int64))], names=["path", "salt", "like"])

    each = pairs.mapInArrow(test, "path long, salt int, like long").groupBy("path", "salt").agg(F.avg("like").alias("share"))
    return each.groupBy("path").agg(F.max("share").alias("share"))


def overlaps(x: np.ndarray, row: np.ndarray, n: int, y: np.ndarray | None = None, row_y: np.ndarray | None = None, m: int = 0) -> np.ndarray:
    """Sizes of all intersections of n sets (values x of the sets `row`) with each other, or with m sets y."""
    alone = y is None
    values = x if alone else np.concatenate([x, y])
    _, at, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts >= 2
    column = np.cumsum(often) - 1
    keep = often[at]

    def sides(lo: int, hi: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = keep[lo:hi]
        c, r = column[at[lo:hi][own]], rows[own]
        order = np.argsort(c, kind="stable")
        return c[order], r[order]

    a = sides(0, len(x), row)
    b = a if alone else sides(len(x), len(values), row_y)
    wide, high = int(often.sum()), n if alone else m
    out = np.zeros((n, high), np.float32)
    for begin in range(0, wide, 2048):  # memory stays bounded however many values there are
        end = min(begin + 2048, wide)

        def dense(side: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
            lo, hi = np.searchsorted(side[0], [begin, end])
            part = np.zeros((rows, end - begin), np.float32)
            part[side[1][lo:hi], side[0][lo:hi] - begin] = 1
            return part

        one = dense(a, n)
        out += one @ (one if alone else dense(b, high)).T
    return out


def rows_of(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def earlier_shared(path: int, lists: list[np.ndarray], other: list[np.ndarray] | None = None) -> np.ndarray | None:
    """Which pairs share a leaf before this one."""
    first = [p[p < path] for p in lists]
    second = None if other is None else [p[p < path] for p in other]
    if not sum(map(len, first)) or second is not None and not sum(map(len, second)):
        return None
    if second is None:
        return overlaps(*rows_of(first), len(first)) > 0
    return overlaps(*rows_of(first), len(first), *rows_of(second), len(second)) > 0


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups: rows of one value in column 0 stand together, and no group is cut."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
        if held and held[0].column(0)[0].as_py() != int(key[0]):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
            held = []
        held.append(t.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def cuts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    return begin, np.concatenate([begin[1:], [len(keys)]])


def column_of(t: pa.Table, i: int) -> pa.Array:
    c = t.column(i)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    flat, n = parts_of(column)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def screened(rows: DataFrame, threshold: float) -> DataFrame:
    """rows: path, id, size, sig, paths of small leaves -> (path, id) of sets with a possible partner whose least leaf this is."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            path, ids, size = (column_of(t, i).to_numpy() for i in range(3))
            sig, lists = sigs_of(column_of(t, 3)), lists_of(column_of(t, 4))
            begin, end = cuts_of(path)
            keep = np.zeros(len(path), bool)
            # All pairs of the groups of a few rows at once.
            few = np.flatnonzero((end - begin >= 2) & (end - begin <= 8))
            left = np.concatenate([np.arange(b, e - 1) for b, e in zip(begin[few], end[few])]) if len(few) else np.zeros(0, np.int64)
            to = np.repeat(end[few], end[few] - begin[few] - 1)
            i = np.repeat(left, to - left - 1)
            j = i + 1 + places_of(to - left - 1)
            close = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6
            i, j = i[close], j[close]
            for k in range(0, len(i), 50_000):
                a, b = i[k : k + 50_000], j[k : k + 50_000]
                near = may_be_near(size[a], size[b], sig[a], sig[b], threshold)
                for x, y in zip(a[near].tolist(), b[near].tolist()):
                    both = np.intersect1d(lists[x], lists[y])
                    if both[0] == path[x]:
                        keep[x] = keep[y] = True
            for b, e in zip(begin, end):
                if e - b <= 8:
                    continue
                near = np.zeros((e - b, e - b), bool)
                for x in range(b, e - 1):
                    near[x - b, x - b + 1 :] = may_be_near(size[x], size[x + 1 : e], sig[x], sig[x + 1 : e], threshold)
                if near.any() and (again := earlier_shared(int(path[b]), lists[b:e])) is not None:
                    near &= ~again
                keep[b:e] = near.any(0) | near.any(1)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(path[keep]), pa.array(ids[keep])], names=["path", "id"])

    return rows.repartition("path").sortWithinPartitions("path").select("path", "id", "size", "sig", "paths").mapInArrow(walk, "path long, id long")


# Exact comparison


def compare(threshold: float):
    """Over rows sorted by key: each set's links there, and its least linked set."""
    names = ["id", "root", "links"]

    def near_pairs(path: int, a: list[int], b: list[int] | None, tokens, paths, size) -> np.ndarray:
        of = lambda x, rows: [x[i] for i in rows]
        other = () if b is None else (*rows_of(of(tokens, b)), len(b))
        near = overlaps(*rows_of(of(tokens, a)), len(a), *other)
        size_b = size[a if b is None else b]
        out = np.zeros(near.shape, bool)
        for k in range(0, len(a), 256):
            common = near[k : k + 256]
            out[k : k + 256] = common >= threshold * (size[a[k : k + 256]][:, None] + size_b[None, :] - common) - 1e-6
        if b is None:
            np.fill_diagonal(out, False)
        if out.any() and (again := earlier_shared(path, of(paths, a), None if b is None else of(paths, b))) is not None:
            out &= ~again
        return out

    def least(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The least label linked to each row (the greatest number where there is none)."""
        order = np.argsort(labels)
        first = near[:, order].argmax(1)
        return np.where(near.any(1), labels[order][first], np.iinfo(np.int64).max)

    def leaf(t: pa.Table) -> pa.RecordBatch | None:
        path, ids, side, copies = (column_of(t, i).to_numpy() for i in range(1, 5))
        _, once = np.unique(ids, return_index=True)  # a row that is there twice has the same set
        tokens, paths = lists_of(column_of(t, 5)), lists_of(column_of(t, 6))
        size = np.array([len(x) for x in tokens])
        across = bool(side[0])  # of two blocks: side 1 and side 2
        a, b = (once[side[once] == k].tolist() for k in ((1, 2) if across else (0, 1)))
        if len(once) < 2 or across and not (a and b):
            return None
        near = near_pairs(int(path[0]), a, b if across else None, tokens, paths, size)
        if not near.any():
            return None
        if not across:
            return out_of(ids[a], settled(near, ids[a]), near @ copies[a])
        root_a, root_b = settled(near, ids[a], ids[b])
        one, two = out_of(ids[a], root_a, near @ copies[b]), out_of(ids[b], root_b, near.T @ copies[a])
        return pa.Table.from_batches([one, two]).combine_chunks().to_batches()[0]

    def settled(near: np.ndarray, a: np.ndarray, b: np.ndarray | None = None):
        """The least id of each set's component inside the leaf."""
        while True:
            other = np.minimum(a if b is None else b, least(near.T, a))
            new = np.minimum(a, least(near, other))
            if (new == a).all() and (b is None or (other == b).all()):
                return a if b is None else (a, b)
            a, b = new, None if b is None else other

    def out_of(ids, root, links) -> pa.RecordBatch:
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches):
            begin, end = cuts_of(column_of(t, 0).to_numpy())
            for b, e in zip(begin.tolist(), end.tolist()):
                if e - b > 1 and (out := leaf(t.slice(b, e - b))) is not None:
                    yield out

    return walk


def with_tokens(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted: id, rep, copies, paths, places (key, path, side) -> a row for each place, with the set's tokens."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                tokens, sizes = token_sets(batch.column(0), shingle)
                lists = listed(tokens.view(np.int64), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
                places, n = parts_of_structs(batch.column(4))
                row = np.repeat(np.arange(len(n)), n)
                for j in range(0, len(row), 2000):
                    r = pa.array(row[j : j + 2000])
                    columns = [pa.array(places[c][j : j + 2000]) for c in ("key", "path")]
                    columns += [batch.column(1).take(r), pa.array(places["side"][j : j + 2000]), batch.column(2).take(r), lists.take(r), batch.column(3).take(r)]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "path", "id", "side", "copies", "tokens", "paths"])

    rows = with_words(docs, wanted).select("words", "id", "copies", "paths", "places")
    return rows.mapInArrow(walk, "key long, path long, id long, side int, copies long, tokens array<long>, paths array<long>")


def leaves_of(docs: DataFrame, sets: DataFrame, *, shingle: int, threshold: float, runs: int, branches: float, small: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(path, id) of small leaves and (leaf, id) of dense ones, each of two sets or more."""
    walked = sets.select(F.explode(F.array_distinct("paths")).alias("path"), "id")
    little, dense = None, None
    for level in range(depth):
        if level:
            walked = written(walked, f"jaccard-level{level}")
        counts = walked.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members")).where(F.col("n") > 1)
        counts = counts.groupBy("n", "members").agg(F.min("path").alias("path"), F.least(F.count("*"), F.lit(runs)).cast("int").alias("runs"))
        counts = written(counts.drop("members"), f"jaccard-counts{level}")
        found = walked.join(counts.where(F.col("n") <= small).select("path"), "path").select("path", "id")
        little = found if little is None else little.unionByName(found)
        large = counts.where(F.col("n") > small)
        if large.isEmpty():
            break
        members = written(walked.join(large.select("path", "runs", "n"), "path").select("path", "id", "runs", "n"), f"jaccard-large{level}")
        if level == depth - 1:
            alike = members
        else:
            shares = written(pivot_shares(members, sets), f"jaccard-pivots{level}")
            alike = members.join(shares.where(F.col("share") >= 0.5).select("path"), "path", "left_semi")
        alike = alike.select(F.col("path").alias("leaf"), "id", "n")
        dense = alike if dense is None else dense.unionByName(alike)
        if level == depth - 1:
            break
        unlike = members.join(shares.where(F.col("share") < 0.5).select("path"), "path", "left_semi")
        wanted = unlike.groupBy("id").agg(F.collect_list(F.struct("path", "runs")).alias("starts")).join(sets.select("id", "rep"), "id")
        walked = children(docs, written(wanted, f"jaccard-split{level}"), shingle, branches)
    little = written(little, "jaccard-small")
    if dense is None:
        return little, little.limit(0).withColumnRenamed("path", "leaf")
    return little, written(merged(written(dense, "jaccard-alike")), "jaccard-dense")


def merged(members: DataFrame) -> DataFrame:
    """Dense leaves (leaf, id); of members (leaf, id, n), a leaf whose members mostly share a larger one is joined with it."""
    largest = F.max(F.struct("n", "leaf")).over(Window.partitionBy("id"))  # a set is in a few leaves
    tally = members.withColumn("first", largest["leaf"]).groupBy("leaf", "first").agg(F.count("*").alias("n"))
    best = tally.groupBy("leaf").agg(F.max(F.struct("n", "first")).alias("b"), F.sum("n").alias("all"))
    to = best.select("leaf", F.when(2 * F.col("b.n") >= F.col("all"), F.col("b.first")).otherwise(F.col("leaf")).alias("to"))
    return members.join(to, "leaf").select(F.col("to").alias("leaf"), "id").distinct()


def propagated(edges: DataFrame) -> DataFrame:
    """(id, root) of the connected components: least label of the neighbours, then of the label, until nothing moves."""
    both = edges.select("id", "root").unionByName(edges.select(F.col("root").alias("id"), F.col("id").alias("root"))).where(F.col("id") != F.col("root")).distinct()
    both = written(both, "jaccard-edges")
    labels = written(both.groupBy("id").agg(F.least("id", F.min("root")).alias("label")), "jaccard-labels")
    while True:
        last = MADE[-1]
        near = both.join(labels.select(F.col("id").alias("root"), F.col("label").alias("l")), "root").groupBy("id").agg(F.min("l").alias("l"))
        moved = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("l"))
        moved = moved.join(jump, "label", "left").select("id", "old", F.least("label", "l").alias("label"))
        moved = written(moved, "jaccard-labels")
        removed(edges.sparkSession, [last])
        if moved.where(F.col("label") != F.col("old")).isEmpty():
            return moved.select("id", F.col("label").alias("root"))
        labels = moved.drop("old")


def linked_sets(docs: DataFrame, sets: DataFrame, little: DataFrame, dense: DataFrame, *, shingle: int, threshold: float, block: int, block_tokens: int) -> DataFrame:
    """(id, root, links): what each leaf gives each of its sets."""
    paths = little.unionByName(dense.withColumnRenamed("leaf", "path")).groupBy("id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    rows = little.join(sets.select("id", "size", "sig").join(paths, "id"), "id")
    active = written(screened(rows, threshold), "jaccard-active")
    weight = dense.join(sets.select("id", "size"), "id").groupBy("leaf").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("tokens") / block_tokens)).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("a"), F.greatest(F.col("own"), j).alias("b"), F.when(F.col("own") == j, 0).when(F.col("own") < j, 1).otherwise(2).alias("side")))
    cells = dense.join(weight.select("leaf", blocks.alias("blocks")), "leaf").withColumn("own", own).select("leaf", "id", F.explode(pair).alias("p"))
    places = cells.select("id", F.struct(F.xxhash64("leaf", "p.a", "p.b").alias("key"), F.col("leaf").alias("path"), "p.side").alias("place"))
    places = places.unionByName(active.select("id", F.struct(F.xxhash64("path", F.lit(0), F.lit(0)).alias("key"), "path", F.lit(0).alias("side")).alias("place")))
    places = places.groupBy("id").agg(F.collect_list("place").alias("places"), F.array_sort(F.collect_set("place.path")).alias("paths"))
    wanted = written(places.join(sets.select("id", "rep", "copies"), "id"), "jaccard-wanted")
    return with_tokens(docs, wanted, shingle).repartition("key").sortWithinPartitions("key").mapInArrow(compare(threshold), "id long, root long, links long")


def join(docs: DataFrame, *, shingle: int = 5, threshold: float = 0.8, recall: float = 0.99999, branches: float = 4.0, small: int = 400, depth: int = 3, block: int = 2500, block_tokens: int = 4_000_000) -> DataFrame:
    """Every document as (doc_id, row_key, class_id, n_links, root): links to other documents, copies counted each."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _join(docs, shingle, threshold, recall, branches, small, depth, block, block_tokens)


def _join(docs: DataFrame, shingle: int, threshold: float, recall: float, branches: float, small: int, depth: int, block: int, block_tokens: int) -> DataFrame:
    spark, runs = docs.sparkSession, runs_for(recall, threshold, branches)
    rows = written(drawn(docs, shingle, runs, branches), "jaccard-drawn")
    sets = written(sets_of(rows), "jaccard-sets")
    begun = len(MADE)
    little, dense = leaves_of(docs, sets, shingle=shingle, threshold=threshold, runs=runs, branches=branches, small=small, depth=depth)
    linked = linked_sets(docs, sets, little, dense, shingle=shingle, threshold=threshold, block=block, block_tokens=block_tokens)
    linked = written(linked, "jaccard-linked")
    removed(spark, MADE[begun:-1])
    roots = propagated(linked)
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    known = sets.select("id", "copies", "least").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(named, "root").select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", "root")
    out = rows.select("doc_id", "row_key", "id").join(known, "id", "left")
    return out.select("doc_id", "row_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "root")


def report(docs: DataFrame, **options) -> DataFrame:
    return join(docs, **options).select("doc_id", "class_id", "n_links")


def one_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, the one of least id (then least content hash); all documents without words stay."""
    rows = join(docs.select("doc_id", "text"), **options).select("doc_id", "row_key", "root")
    alone = rows.where(F.col("root").isNull()).select("doc_id", "row_key")
    least = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("k")).select("k.doc_id", "k.row_key")
    i, k, one = named_apart(docs, "id", "key", "one")
    stay = least.unionByName(alone).distinct().select(F.col("doc_id").alias(i), F.col("row_key").alias(k))
    # Of rows that are there twice one stays: the first of them by a number that only tells equal rows apart.
    keyed = docs.withColumn(one, row_key("doc_id", "text"))
    kept = keyed.join(stay, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(one) == F.col(k)), "left_semi")
    return kept.dropDuplicates(["doc_id", one]).select(*[F.col(f"`{c}`") for c in docs.columns])
