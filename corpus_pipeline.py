"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread by the next.

Every stage but the last returns the columns of its input, whatever further columns that has. Defined cases: a null or empty
text is scored like any text and is in no group of copies, contaminated by nothing and taken by no mix; null and repeated
ids are rows of their own until the copies go; of equal documents the one of least id stays; very long texts pass whole;
an empty table passes every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrace.llm import classifier, common, decontaminate, jaccard_join, mixing, tokens
from veritrace.llm.common import new_path, table
from veritrace.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classifier.accepted(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    bad = decontaminate.report(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    return decontaminate.without(docs, bad)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its slots; a part taken is a row of those words alone."""
    mixed = mixing.apply(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and a row per document from them."""
    return tokens.token_report(docs, tokenizer=tokenizer_path(), by_word=True)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_files", token_files),
]

#: A trained model, a similarity join and a tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is deleted once its result is written; the token files stay."""
    docs, held = table(spark, sf_dir, "documents"), ""
    for k, (name, stage) in enumerate(STAGES):
        begun = len(common.MADE)
        df = stage(spark, docs, sf_dir)
        path = new_path(spark, f"pipeline-{k}-{name}")
        df.write.parquet(path)
        common.removed(spark, [p for p in common.MADE[begun:] if p != path and not p.rsplit("/", 1)[1].startswith("tokens-")] + [held] * bool(held))
        docs, held = spark.read.schema(df.schema).parquet(path), path
    return docs
