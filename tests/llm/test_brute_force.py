"""Operators against plain Python on whole tables and on fixtures with nulls, repeats, ties and clashing names."""

import hashlib
import math
import re
import string
from collections import Counter

import numpy as np
import pytest

from veritrace.llm import classifier, decontaminate, mixing, quality_rules, tokens
from veritrace.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.collect()]


# op1


def base_of(text):
    w = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    twice, hit = Counter(windows), [False] * len(w)
    for k, x in enumerate(windows):
        if twice[x] > 1:
            hit[k : k + 5] = [True] * 5
    n = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(hit)
    return n, n[0] < 10 or 100 * n[4] > 20 * n[0]


def verdicts(rows, common=24, least=1000):
    """class and word distance of each (text, lang), by the definition in the module."""
    import unicodedata

    def classes(t):
        out = Counter()
        for c in t:
            kind = unicodedata.category(c)
            out["lower" if kind in ("Ll", "Lo") else "upper" if kind == "Lu" else "digit" if c in "0123456789" else "space" if c in " \t\n\x0b\x0c\r" else "punct" if c in ".,;:!?'\"()-" else "symbol" if c in "#*$%&|<>" else "other"] += 1
        return [out[k] for k in ("lower", "upper", "digit", "space", "punct", "symbol", "other")]

    def distance(p, q):
        h = lambda a, b: a * math.log(2 * a / (a + b)) if a > 0 else 0.0
        return math.sqrt(max(0, sum(h(a, b) + h(b, a) for a, b in zip(p, q)) / (2 * math.log(2))))

    rows = [(t or "", lang or "", WORD.findall(t or "")) for t, lang in rows]
    good = [not base_of(t)[1] for t, _, _ in rows]
    total = Counter()
    for (_, lang, w), g in zip(rows, good):
        total[lang] += len(w) * g
    known = {k for k, n in total.items() if n >= least}
    refs = {}
    for ref in [*known, "*"]:
        own = [(t, w, g) for (t, lang, w), g in zip(rows, good) if ref in (lang, "*")]
        df = Counter(x for _, w, _ in own for x in set(w))
        top = [x for x, _ in sorted(df.items(), key=lambda kv: (-kv[1], kv[0]))[:common]]
        char = np.sum([classes(t) for t, _, g in own if g] or [[0] * 7], axis=0)
        n = sum(len(w) for _, w, g in own if g)
        words = [sum(w.count(x) for _, w, g in own if g) / n if n else 0.0 for x in top] + [0.0] * (common - len(top))
        refs[ref] = top, char / max(1, char.sum()), [*words, max(0, 1 - sum(words))]
    out = []
    for t, lang, w in rows:
        top, char, words = refs[lang if lang in known else "*"]
        p = [w.count(x) / max(1, len(w)) for x in top] + [0.0] * (common - len(top))
        by_class = round(distance(np.array(classes(t)) / max(1, len(t)), char), 6) if len(t) >= 200 else None
        by_word = round(distance([*p, max(0, 1 - sum(p))], words), 6) if len(w) >= 50 else None
        out.append((by_class, by_word))
    return out


def test_quality_rules(spark, texts):
    rare = [(10**6 + k, " ".join(f"{a}{k % 3}" for a in "quo usque tandem abutere catilina patientia nostra".split() * 9), "la", "s") for k in range(2)]
    rows = [*texts, *rare, texts[3], (None, None, None, None), (7, "", "en", "s")]
    docs = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "doc_id long, text string, lang string, source string, n_words long, ref double, kept string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality_rules.judge(docs).collect()
    want = []
    for (i, t, _, _), (c, w) in zip(rows, verdicts([r[1:3] for r in rows])):
        base, failed = base_of(t)
        want.append((i, *base, failed, c, w, not failed and (c or 0) <= 0.25 and (w or 0) <= 0.32))
    near = lambda r: (str(r[:7]), *(-1 if x is None else x for x in r[7:9]), r[9])
    have = sorted(near((r["doc_id"], *(r[n] for n in names), r["base_failed"], r["class_distance"], r["word_distance"], r["kept"])) for r in got)
    for a, b in zip(have, sorted(map(near, want)), strict=True):
        assert a[0] == b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 2e-6 and abs(a[2] - b[2]) < 2e-6
    other = quality_rules.judge(docs, broadcast_rows=0).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))


# op2


def hits_of(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    lengths = sorted({len(x) for x in windows})
    for i, t, *_ in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit[k : k + n] = [True] * n
                    found |= own
        yield i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)


@pytest.mark.parametrize("block", [200_000, 0])
def test_decontamination(spark, texts, block):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(None, "one two three"), (900, ""), (901, None), (902, bench[0][1]), (902, bench[0][1])]
    rows = [*texts, texts[5], (None, "x one TWO; three four one two three", "en", "s"), (3, None, None, None), (4, "", None, None), (5, "w " * 30000 + (bench[1][1] or ""), "en", "s")]
    docs = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "doc_id long, text string, lang string, source string, w long, words string, start long")
    items = spark.createDataFrame([(*b, 5) for b in bench], "item_id long, text string, n long")
    got = decontaminate.report(docs, items, block=block).drop("row_key").collect()
    want = list(hits_of(rows, bench))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)) and sum(w[5] for w in want) > 5
    clean = decontaminate.without(docs, decontaminate.report(docs, items, block=block).where("contaminated"))
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)


# op3


def water(sizes, share, most):
    """Targets by bisection on the common unit: an independent way to the same water level."""
    weights = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    total, lo, hi = share * sum(sizes), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(most * s, w * mid) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(most * s, w * hi) for s, w in zip(sizes, weights)]


def test_mixing(documents, texts, monkeypatch):
    size = Counter()
    for _, t, _, s in texts:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    want = dict(zip(order, water([size[s] for s in order], 1.5, 2.0)))
    source = {i: s for i, _, _, s in texts}

    def taken(**options):
        rows = mixing.mix(documents, **options).collect()
        assert len(rows) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] and abs(r["target"] - want[source[r["doc_id"]]]) < 1e-3 for r in rows)
        by = Counter()
        for r in rows:
            by[source[r["doc_id"]]] += r["taken"]
        assert all(abs(by[s] - want[s]) <= 1 for s in order)
        return {r["doc_id"]: r["taken"] for r in rows}

    first = taken(block=256, chunk=100, bucket_docs=64)
    assert first == taken(block=256, chunk=64, bucket_docs=64) and taken() == taken()
    monkeypatch.setattr(mixing, "GOLDEN", 0.0123)
    assert first != taken(block=256, chunk=100, bucket_docs=64)


def test_mixture_rows(spark):
    rows = [(k, " ".join(f"{s}{k}w{j}" for j in range(5 + 7 * k % 40)), "en", s, 0, "c", 1, k) for k, s in enumerate(["a", "b", None, "c"] * 15)]
    rows += [rows[4], rows[4], (None, "no id here at all", "en", "a", 0, "c", 1, 2), (99, None, "en", "a", 0, "c", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, times string, m_id long, slot long")
    options = {"block": 16, "chunk": 8, "bucket_docs": 8}
    got = mixing.apply(docs, **options)
    assert got.columns == docs.columns
    got = got.collect()
    by, left = Counter(), Counter()
    for r in got:
        by[r["doc_id"]] += len(r["text"].split())
        left[r["source"]] += len(r["text"].split())
    want = Counter()
    for r in mixing.mix(docs, **options).collect():
        want[r["doc_id"]] += r["taken"]
    assert by == Counter({k: n for k, n in want.items() if n})
    whole = {r[0]: r[1] for r in rows}
    assert all(set(r["text"].split()) <= set(whole[r["doc_id"]].split()) for r in got)
    # In slot order the sources mix from the start on: each prefix has every source near its share.
    half = Counter()
    for r in got[: len(got) // 2]:
        half[r["source"]] += len(r["text"].split())
    assert all(abs(half[s] / sum(half.values()) - left[s] / sum(left.values())) < 0.15 for s in left)
    assert mixing.apply(docs.limit(0)).count() == 0


# op8


def test_classifier_on_held_out_labels(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in classifier.report(documents, labels).collect() if r["held_out"] and r["doc_id"] in known]
    good, bad = ([r["score"] for r in rows if known[r["doc_id"]] == y] for y in (1, 0))
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95 and sum(r["predicted"] == known[r["doc_id"]] for r in rows) >= 0.9 * len(rows)


def test_the_bound_on_labelled_rows_holds_where_ids_repeat(spark, documents):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(k % 40, f"text {k} " * (1 + k % 7), 0.5) for k in range(400)], "doc_id long, text string, quality_score double")
    seen = []
    real = classifier._sums
    try:
        classifier._sums = lambda rows, body, width: seen.append(rows.count()) or real(rows, body, width)
        classifier.fit(docs, labels, max_labelled=30)
    finally:
        classifier._sums = real
    assert set(seen) == {30}
    assert classifier.accepted(docs, labels, threshold=0.0).columns == docs.columns and classifier.accepted(docs, labels, threshold=0.0).count() == 400


# op6


def test_token_files_of_any_size(spark, documents):
    docs = documents.limit(200)
    path = tokenizer_path()
    want = sorted(map(tuple, tokens.token_report(docs, tokenizer=path).collect()))
    manifest = tokens.write_files(docs, tokenizer=path, end_id=1, by_word=True, file_tokens=3000, file_docs=7)
    assert manifest.count() > 20 and sorted(map(tuple, tokens.read_files(manifest, block_bytes=64).collect())) == want


def test_words_are_not_joined_where_a_tokenizer_keeps_blanks(monkeypatch):
    packed, _ = tokens.packer(tokenizer_path(), 1, False, True)
    monkeypatch.setattr(tokens, "split_words", lambda t: [t[: len(t) // 2], t[len(t) // 2 :]])
    with pytest.raises(ValueError, match="blanks"):
        packed([f"abcdefgh{k}" for k in range(3000)])
    tokens.packer.cache_clear()


def test_keys_that_collide_get_another_seed(monkeypatch):
    real = tokens.keys_of
    monkeypatch.setattr(tokens, "keys_of", lambda ids, nth, seed=0: np.zeros(len(ids), np.uint64) if seed == 0 else real(ids, nth, seed))
    import io

    z = np.load(io.BytesIO(tokens._index([1, 2, 2], [5, 6, 7])))
    assert z["seed"][0] == 1
