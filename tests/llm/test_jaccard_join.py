"""The Jaccard join against all pairs, its classes against a search, and the pieces that decide what is compared."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from veritrace.llm import jaccard_join
from veritrace.llm.jaccard_join import RANGES, may_be_near, overlaps

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    """Links of each text, and the least place in its class."""
    sets, by = [], defaultdict(list)
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        for x in sets[-1]:
            by[x].append(len(sets) - 1)
    near = [[] for _ in sets]
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x] if j != i)
        near[i] = [j for j, n in common.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)]
    least = list(range(len(sets)))
    for i in range(len(sets)):
        if least[i] == i:
            todo = [i]
            while todo:
                for j in near[todo.pop()]:
                    if least[j] > i:
                        least[j] = i
                        todo.append(j)
    return [len(x) for x in near], least


def test_every_pair_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    links, least = brute([r["text"] for r in rows])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.report(docs).collect()}
    found = sum(min(got[r["doc_id"]][1], n) for r, n in zip(rows, links))
    assert found >= 0.99 * sum(links) > 0 and all(got[r["doc_id"]][1] <= n for r, n in zip(rows, links))
    assert sum(got[r["doc_id"]][0] == rows[k]["doc_id"] for r, k in zip(rows, least)) >= 0.99 * len(rows)


@pytest.mark.parametrize("options", [{}, {"small": 5, "block": 7}, {"small": 5, "block_tokens": 900}, {"small": 3, "depth": 1, "block": 4}])
def test_chains_keep_one_class(spark, options):
    """Sliding windows over one long text: neighbours are near, the ends are not, and every text is in one class."""
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 300, 3)] + ["other words that stand here alone", None, ""]
    links, least = brute(texts)
    order = list(range(len(texts)))
    draw.shuffle(order)
    docs = spark.createDataFrame([(k, texts[k], "x", 1) for k in order], "doc_id long, text string, id string, path long")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.report(docs, **options).collect()}
    assert got == {k: (least[k], links[k]) for k in order}


def test_one_of_each_class_stays_with_all_its_columns(spark):
    base = [f"b{k}" for k in range(80)]
    rows = [(1, " ".join(base), "a", 1), (2, " ".join(base), "a", 2), (3, " ".join([*base, "tail"]), None, 3), (4, None, "a", 4), (5, "", "b", 5), (None, "quite another text", "b", 6), (None, "quite another text", "b", 6), (7, " ".join(base[:40]), "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k_id string, `row_key` long").withColumnRenamed("k_id", "_id")
    kept = jaccard_join.one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, [1, 4, 5, None, 7]))
    assert jaccard_join.one_each(docs.limit(0)).count() == 0


def test_histograms_never_rule_out_a_near_pair():
    draw = np.random.default_rng(3)
    for n in (1, 30, 700):
        a = draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        b = np.concatenate([a[: max(1, int(0.9 * n))], draw.integers(0, 2**63, n // 20).astype(np.uint64)])
        sig = [np.bincount((x >> np.uint64(57)).astype(int), minlength=RANGES).astype("<u2")[None] for x in (a, b)]
        size = [np.array([len(set(x.tolist()))]) for x in (a, b)]
        both = len(set(a.tolist()) & set(b.tolist()))
        if both >= 0.8 * (size[0] + size[1] - both):
            assert may_be_near(*size, *sig, 0.8).all()


def test_overlaps():
    draw = np.random.default_rng(4)
    sets = [set(draw.integers(0, 60, 20).tolist()) for _ in range(9)]
    flat, row = np.concatenate([sorted(s) for s in sets]), np.repeat(range(9), [len(s) for s in sets])
    assert (overlaps(flat, row, 9)[np.triu_indices(9, 1)] == [len(sets[i] & sets[j]) for i, j in zip(*np.triu_indices(9, 1))]).all()
    got = overlaps(flat[row < 4], row[row < 4], 4, flat[row >= 4], row[row >= 4] - 4, 5)
    assert (got == [[len(a & b) for b in sets[4:]] for a in sets[:4]]).all()
