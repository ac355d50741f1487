"""Personal data: what the patterns learnt from the corpus find beyond the base patterns, and what they leave alone."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veritrace.llm import pii

SCHEMA = "doc_id long, text string, cue string, base string, kind string"


def spans_of(spark, rows, **options):
    got = pii.report(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), **options).collect()
    return {r["doc_id"]: r["spans"] for r in got}


def test_secrets_of_a_table_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    secret = {i: m for i, t in text.items() if (m := re.search(r'(?i)token = "([0-9A-F]{40})"', t))}
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    found = {i for i, r in got.items() if r["n_added"]}
    assert len(secret) > 5 and found == set(secret)  # recall and precision 1
    assert all(f"secret:{m.start(1)}:{m.end(1)}" in got[i]["spans"].split(",") for i, m in secret.items())
    assert all(r["personal"] == bool(r["spans"]) and r["n_spans"] == len([x for x in r["spans"].split(",") if x]) for r in got.values())


def planted(n, seed):
    """Texts with keys after "token" in known and unknown formats, and the same formats where no pattern stands."""
    draw = random.Random(seed)
    word = lambda: draw.choice("amber birch cedar dune ember fjord grove heath".split()) + str(draw.randrange(9))
    hexes = lambda k: "".join(draw.choice("0123456789abcdef") for _ in range(k - 2)) + "0a"
    odd = lambda: "".join(draw.choice("GHJKLMNPQRSTUVWXYZ0123456789_") for _ in range(23)) + "X7"
    known = [(k, f'{word()} {word()} token = "{hexes(40)}" {word()}') for k in range(n)]
    unseen = [(1000 + k, f'{word()} token="{odd()}" {word()}') for k in range(6)]
    clean = [(2000 + k, f"{word()} commit {hexes(40)} {word()} part {odd()}") for k in range(3)] + [(3000 + k, f"{word()} {draw.randrange(10**6)} {word()}") for k in range(50)]
    return known, unseen, clean


@pytest.mark.parametrize("seed", [1, 2])
def test_unseen_formats_after_a_learnt_pattern(spark, seed):
    known, unseen, clean = planted(40, seed)
    got = spans_of(spark, known + unseen + clean)
    assert all(got[i].startswith("secret:") for i, _ in known + unseen) and not any(got[i] for i, _ in clean)


def test_a_pattern_does_not_vouch_for_its_own_finds(spark):
    """A common word before eight addresses and eighty numbers is no pattern of addresses."""
    rows = [(k, f"von 10.0.0.{k}") for k in range(8)] + [(100 + k, f"von {k}991.{k}") for k in range(80)]
    got = spans_of(spark, rows)
    assert not any(got[100 + k] for k in range(80))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "mail a.b@c.example"), (None, "mail a.b@c.example"), (1, None), (1, ""), (2, "no data")]
    got = pii.report(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA))
    assert sorted(str((r["doc_id"], r["spans"])) for r in got.collect()) == sorted(map(str, [(None, "email:5:18"), (None, "email:5:18"), (1, ""), (1, ""), (2, "")]))
    assert pii.report(got.sparkSession.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_running_sums(spark, n):
    values = [(7 * k) % 13 for k in range(n)]
    df = spark.createDataFrame([(values,)], "v array<long>")
    got = df.select(F.when(F.size("v") > 0, pii.running(F.col("v"))).alias("r")).first()["r"]
    assert (got or []) == [sum(values[: k + 1]) for k in range(n)]


def test_many_matches_in_one_text_take_time_in_proportion(spark):
    def seconds(n):
        text = " ".join(f"10.1.{k % 250}.{k % 199} id{k}000" for k in range(n))
        began = time.time()
        spans_of(spark, [(1, text)])
        return time.time() - began

    seconds(100)
    assert seconds(8000) < 8 * max(seconds(2000), 2)
