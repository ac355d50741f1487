"""The pipeline, stage by stage, against brute force on a whole small table with repeated rows, nulls and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_brute_force import WORD, hits_of
from tests.llm.test_jaccard_join import brute
from veritrace.llm import common, tokens
from veritrace.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(None, docs.first()["text"], "en", "s", 1), (None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (900, "planted " * 12, "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("_score", F.lit(1)).withColumn("times", F.lit("x")).withColumn("words", F.array(F.lit("w")))
    docs.unionByName(docs.limit(3)).write.parquet(f"file://{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = common.written(stage(spark, docs, sf_dir), f"test-{name}")
        kept.append((name, before, docs.collect()))
        assert docs.columns == columns or name == "token_files"
    texts = {name: ([r["text"] for r in a], b) for name, a, b in kept}
    assert 0 < len(texts["quality_classifier"][1]) <= len(texts["quality_classifier"][0])

    before, after = texts["jaccard_join"]
    _, least = brute(before)
    alone = {(r["doc_id"], r["text"]) for r in kept[1][1] if not WORD.findall(r["text"] or "")}
    assert len(after) == len({c for c, t in zip(least, before) if WORD.findall(t or "")}) + len(alone)

    before, after = texts["decontamination"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [t for t, h in zip(before, hits_of(list(enumerate(before)), bench)) if not h[5]]
    assert Counter(r["text"] for r in after) == Counter(clean)

    _, before, after = kept[3]
    size = lambda t: len(WORD.findall(t or ""))
    have, taken = Counter(), Counter()
    for r in before:
        have[r["source"]] += size(r["text"])
    for r in after:
        taken[r["source"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert abs(sum(taken.values()) - 1.5 * sum(have.values())) <= len(have) and all(taken[s] <= 2 * have[s] + 1 for s in have)

    _, before, after = kept[4]
    encode, _ = tokens.encoder(tokenizer_path())
    want = Counter((r["doc_id"], zlib.crc32(np.array(encode([r["text"] or ""])[0] + [1], "<u4").tobytes())) for r in before)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in after) == want


def test_run_deletes_what_it_wrote_on_its_way(spark, sf_dir):
    begun = len(common.MADE)
    df = corpus_pipeline.run(spark, sf_dir)
    assert df.count() > 0
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common.MADE[begun:]]
    assert sorted(left) == ["pipeline-4-token_files", "tokens", "tokens-manifest"]


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
