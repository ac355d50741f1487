"""Each operator against brute force on a small fixture with nulls, empty and repeated rows, and clashing column names."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veritrace.llm import classifier, decontaminate, html_text, jaccard_join, line_dedup, mixing, pii, quality_rules, tokens
from veritrace.llm.mph import PerfectHash
from veritrace.llm.queries import tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, path string, score double"
LONG = " ".join(f"w{i}" for i in range(400))
TEXTS = [None, "", " \n ", "one", LONG, LONG + " tail", LONG.replace("w7 ", "x7 "), "a b c d e f g h i j k l", "A B C D E F G H I J K L. x", "same line\nother", "x" * 5000,
         "mail a.b@c.example.com now +1 (743) 555-3824 and 4785 3805 9239 1139 or 10.0.0.255 10.0.0.256", LONG, "\U0001f600 été x.y@z.org"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None][i % 2], ["s1", None, "s0"][i % 3], 0, 1, "p", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, f"Common Line \n{i} body", "en", "s1", 0, 1, "p", 0.5) for i in range(10)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", "en", "s1", 0, 1, "p", 0.5)], SCHEMA)


def words(text):
    return re.findall(SPACE, text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    table = PerfectHash.of(**PerfectHash.build(np.unique(keys)).parts())
    assert sorted(table.slots(np.unique(keys))) == list(range(len(np.unique(keys))))


def test_line_dedup(docs, local):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for _, t, _ in local for k in {strip(x) for x in (t or "").split("\n")} if k)
    want = []
    for i, t, _ in local:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[strip(x)] < 10]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert rows_of(line_dedup.report(docs)) == sorted(want, key=str)


def test_mixing(docs, local):
    size = Counter()
    for _, t, s in local:
        size[s] += len(words(t))
    got = mixing.mix(docs, block=16, chunk=8, bucket_docs=4).collect()
    assert len(got) == len(local) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.targets_of([size[s] for s in order], 1.5, 2.0)))
    taken = Counter()
    for r in got:
        taken[r["target"]] += r["taken"]
    assert all(abs(taken[t] - t) < 1 for t in target.values() if t)


def test_jaccard_join(docs, local):
    sets = []
    for _, t, _ in local:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)
    links = [sum(near(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)]
    for options in ({}, {"small": 2, "depth": 2}):
        got = jaccard_join.report(docs, **options).collect()
        assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == sorted((str(d[0]), n) for d, n in zip(local, links))
    assert jaccard_join.one_each(docs).count() == len(local) - 4  # the copies and near copies of one text


def test_jaccard_join_keeps_the_links_of_large_groups(spark):
    """Each group has one core of its own and more than 400 members, so that its links are all pairs: no brute force needed."""
    groups, size = 40, 410
    core = lambda g: " ".join(f"g{g}c{k}" for k in range(60))
    rows = [(g * size + i, f"{core(g)} t{g}x{i} u{i}") for g in range(groups) for i in range(size)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(t) for _, t in rows[:size])]
    assert all(len(a & b) >= 0.8 * len(a | b) for a in sets[:5] for b in sets)
    got = Counter((r["class_id"], r["n_links"]) for r in jaccard_join.report(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(g * size, size - 1): size for g in range(groups)}


def test_tokens(docs, local):
    encode, _ = tokens.encoder(tokenizer_path())
    at, want = 0, []
    for i, t in sorted(((d[0], d[1]) for d in local), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = encode([t or ""])[0] + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    for by_word in (False, True):
        assert rows_of(tokens.token_report(docs, tokenizer=tokenizer_path(), by_word=by_word)) == sorted(want, key=str)
    files = tokens._started(tokens.write_files(docs, tokenizer=tokenizer_path(), end_id=49407, keyed=False, literal=True))
    for block in (3, 1 << 20):
        got = tokens.separator_scan(files, end_id=49407, block_tokens=block).join(tokens.names_of(files), ["path", "ordinal"])
        assert sorted(map(str, ((r["doc_id"], r["n_tokens"]) for r in got.collect()))) == sorted(str((i, n)) for i, _, n, _ in want)


def test_words_give_the_ids_of_the_whole_text():
    texts = ["", " ", "A's b'LL\t\r\n 12 x\x1cy\x0bz\u3000q\x85w", "e\u0301 \u0301\u0327 \u03a3\u03a3 \u03a3", "<|endoftext|> a<|startoftext|>b <| |>a", " ".join(f"n{i}.,x" for i in range(2500)), "x" * 500 + " " + "\U0001f600\u200d" * 70]
    for literal in (False, True):
        encode, _ = tokens.encoder(tokenizer_path(), literal)
        packed, width = tokens.packer(tokenizer_path(), 1, literal, True)
        for _ in range(2):
            assert [np.frombuffer(x, f"<u{width}").tolist() for x in packed(texts)] == [ids + [1] for ids in encode(texts)]


def test_decontamination(spark, docs, local):
    items = spark.createDataFrame([(1, "b C d e f g h i j k"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (3, None), (4, "Common, line"), (5, "no such words here")], "item_id long, text string")
    got = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["n_items"]) for r in decontaminate.report(docs, items).collect()}
    assert got[4, 400] == (11, 1) and got[7, 12] == (10, 1) and got[100, 4] == (2, 1) and got[0, 0] == (0, 0)


def test_quality_rules(docs, local):
    got = sorted((str(r["doc_id"]), r["n_words"], r["base_failed"]) for r in quality_rules.judge(docs).collect())
    assert got == sorted((str(i), len(words(t)), len(words(t)) < 10) for i, t, _ in local)


def test_classifier(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = classifier.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["score"] for r in classifier.report(docs, labels.limit(0)).collect()} == {1.0}


def base_of(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def passes(kind, value):
        digits = [int(c) for c in value if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    found = sorted((m.start(), n, m.end(), k) for n, (k, r) in enumerate(kinds.items()) for m in re.finditer(r, text) if passes(k, m.group()))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_pii(docs, local):
    want = [(i, hashlib.sha256(base_of(t or "").encode()).hexdigest(), base_of(t or "")) for i, t, _ in local]
    assert rows_of(pii.report(docs).select("doc_id", "base_sha256", "spans")) == sorted(want, key=str)


def test_pii_finds_what_stands_after_a_learnt_pattern(spark):
    rows = [(i, f"reach staff via 10.0.0.{i} today") for i in range(1, 9)] + [(20, "reach staff via host-2291.x now"), (21, "version of 2291.4 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == "ip:16:27" and got[21] == ""


def test_pii_learns_from_one_word_and_from_the_right(spark):
    names = "amber birch cedar dune ember fjord grove heath".split()
    rows = [(i, f"{n} email {n}@mail.example {n}") for i, n in enumerate(names)] + [(20 + i, f"{n}\n10.0.0.{i} pinged {n}") for i, n in enumerate(names)]
    rows += [(50, "iris email user2291.x now"), (51, "node-2291.y pinged us"), (52, "iris build 2291.4 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[50], got[51], got[52]) == ("email:11:21", "ip:0:11", "")


def test_pii_takes_runs_in_the_alphabet_of_a_kind(spark):
    names = "amber birch cedar dune ember fjord grove heath".split()
    rows = [(i, f"{n} mailto {n}@mail.example {n}") for i, n in enumerate(names)] + [(20 + i, f"{n} host 10.0.0.{i} {n}") for i, n in enumerate(names)]
    rows += [(40 + i, f"{n} dial +1 743 555 38{i}4 {n}") for i, n in enumerate(names)]
    cases = [("mailto jane.roe@localhost x", "email:7:25"), ("mailto jane(at)x.org x", "email:7:20"), ("dial (743) 555-3824 x", "phone:5:19"), ("dial 020 7946 0958.", "phone:5:18"),
             ("host fe80::1 x", "ip:5:12"), ("host 1.2.3 x", "ip:5:10"), ("mailto nobody", ""), ("host 12:30:45 x", ""), ("calls 020 7946 0958 x", "")]
    rows += [(100 + i, t) for i, (t, _) in enumerate(cases)]
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[100 + i] for i in range(len(cases))] == [w for _, w in cases]


def test_html(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><nav><a href=x>Home</a></nav><article><h1>T{i}</h1><p>a &amp;\n b{i}<br>c<p>d<div class='comments'>bad</div></article><footer>f</footer></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.report(spark.createDataFrame([*pages, (9, None, None)], "page_id long, url string, html string")).collect()}
    assert got == {0: "T0\na & b0 c\nd", 1: "T1\na & b1 c\nd", 2: "T2\na & b2 c\nd", 9: ""}


def test_html_keeps_articles_in_layout_wrappers_and_after_an_open_head():
    kept = lambda html: [t for _, t, _ in html_text.Blocks().done(html).blocks]
    for name in ("layout with-sidebar", "no-sidebar", "header-fixed", "has-banner"):
        assert kept(f"<body><div class='{name}'><article><p>a<p>b</article></div>") == ["a", "b"]
    for start in ("<html><head><title>t</title><body>", "<html><head><meta x><title>t</title>", "<head><script>s</script></head><body>"):
        assert kept(f"{start}<article><p>a</article>") == ["a"]
    assert kept("<body><article><p>a</article><div class='comments'><article>c</article></div><div class='site-banner'>x</div>") == ["a"]
    assert kept("<body><div class='comment-list'><article>c</article></div><p>a") == ["a"]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels, items = (spark.createDataFrame([], s) for s in ("doc_id long, quality int, toxic int", "item_id long, text string"))
    for df in (line_dedup.report(none), mixing.mix(none), jaccard_join.report(none), tokens.token_report(none, tokenizer=tokenizer_path()), quality_rules.judge(none), pii.report(none), classifier.report(none, labels), decontaminate.report(none, items)):
        assert df.count() == 0
