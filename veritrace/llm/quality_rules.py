"""Quality rules by distribution divergence (op1), DataFrame operations only.

Every document gets a character-class histogram and a histogram over the common words of its language. Both are held
against the reference of the language by the Jensen-Shannon distance (base 2, 0 to 1). Two guards keep short texts, whose
histograms are noise, from being judged: below ``min_chars`` the classes, below ``min_words`` the words don't count.

References come from all documents that pass the base rules. A language with fewer than ``min_reference_words`` words in
all is held against the pooled reference: the classes, and the words common over all languages, in the documents of all.
References are a row per language; they are broadcast up to ``broadcast_rows`` of them, and joined by shuffle beyond.

Defined cases: a null text is empty (no words, base fails); a null language is a language of its own; rows that repeat an
id are judged row by row (no join on the id); of words equally common the first by code point ranks higher; very long texts
are read whole; an empty table gives an empty result; columns other than ``doc_id``, ``text`` and ``lang`` are ignored,
whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, let, row_key, text_of, words_of, written

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "space", "punct", "symbol", "other")
WINDOW = 5


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows whose hash is found twice or more. hashes: of the window that starts at each word."""

    def covered(sorted_pairs: Column) -> Column:
        twice = F.filter(
            sorted_pairs,
            lambda x, i: (F.get(sorted_pairs, i - 1)["h"] == x["h"]) | (F.get(sorted_pairs, i + 1)["h"] == x["h"]),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
        total = F.aggregate(
            starts,
            first,
            lambda a, s: F.struct((a["n"] + s + window - F.greatest(a["end"], s)).alias("n"), (s + window).alias("end")),
        )
        return total["n"]

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def measured(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts, the class counts and base_failed."""
    df = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), row_key("doc_id", "text").alias("row_key"), text_of().alias("text")
    )
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.split("text", "\n"))
    w = F.col("words")
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    with_word = F.filter("lines", lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    n, text = F.length("text"), F.col("text")
    # One pass takes out most of a text; the other classes are counted in what it leaves.
    rest = F.regexp_replace(text, r"[\p{Ll}\p{Lo}\x20\x09-\x0D]+", "")
    df = df.select(
        "doc_id",
        "lang",
        "row_key",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(windows, repeat_words).cast("long").alias("n_repeat_words"),
        n.cast("long").alias("n_chars"),
        rest.alias("rest"),
    )
    text, n = F.col("rest"), F.length("rest")
    df = df.select(
        *[c for c in df.columns if c != "rest"],
        (n - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.col("word_chars") - n).cast("long").alias("c_lower"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("c_upper"),
        (n - _without(text, "0123456789")).cast("long").alias("c_digit"),
        (n - _without(text, PUNCTUATION)).cast("long").alias("c_punct"),
    )
    df = df.withColumn("c_space", F.col("n_chars") - F.col("word_chars")).withColumn("c_symbol", F.col("n_symbols"))
    known = sum((F.col(f"c_{c}") for c in CLASSES[1:-1]), F.col("c_lower"))
    df = df.withColumn("c_other", F.col("n_chars") - known)
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _half(p: Column, q: Column) -> Column:
    """p ln(p / m) with m the mean of p and q; 0 for p = 0."""
    return F.when(p > 0, p * F.ln(2 * p / (p + q))).otherwise(F.lit(0.0))


def _distance(shares: list[Column], reference: list[Column]) -> Column:
    each = F.zip_with(F.array(*shares), F.array(*reference), lambda p, q: _half(p, q) + _half(q, p))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(total / (2 * F.ln(F.lit(2.0))), F.lit(0.0)))


def distinct_words(docs: DataFrame) -> DataFrame:
    """A row per distinct word of each document. (explode() alone would split every text twice.)"""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode_outer(F.array_distinct(words_of(text_of()))).alias("word"))
    return rows.where(F.col("word").isNotNull())


def class_reference(stats: DataFrame, min_reference_words: int) -> DataFrame:
    """Class shares by language, over what passes the base rules; lang ``*`` pools all."""
    sums = [F.sum(f"c_{c}").alias(f"s_{c}") for c in CLASSES] + [F.sum("n_words").alias("all_words")]
    by = stats.where(~F.col("base_failed")).groupBy("lang").agg(*sums)
    pool = by.agg(*[F.sum(c).alias(c) for c in by.columns[1:]]).select(F.lit("*").alias("lang"), *by.columns[1:])
    by = by.where(F.col("all_words") >= min_reference_words).unionByName(pool)
    total = sum((F.col(f"s_{c}") for c in CLASSES[1:]), F.col("s_lower"))
    return by.select("lang", "all_words", *[F.try_divide(f"s_{c}", total).alias(f"q_{c}") for c in CLASSES])


def common_words_of(docs: DataFrame, count: int) -> DataFrame:
    """(lang, word, rank): the words in most documents of each language, and of all (``*``); ties by word."""
    n = distinct_words(docs).groupBy("lang", "word").agg(F.count("*").alias("n"))
    n = n.unionByName(n.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("*")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("rank", rank).where(F.col("rank") <= count).select("lang", "word", "rank")


def common_counts(docs: DataFrame, words: DataFrame, known: DataFrame, ranks: range, side) -> DataFrame:
    """By document: w_k, how often it has the word of rank k of its language, and g_k, the same of all languages' words."""
    # (ref, word, w, g): the common words of each reference, its own and those of all.
    own = words.join(side(known), "lang", "left_semi").select(F.col("lang").alias("ref"), "word", F.col("rank").alias("w"))
    refs = known.select(F.col("lang").alias("ref")).unionByName(words.sparkSession.createDataFrame([("*",)], "ref string"))
    pooled = refs.join(F.broadcast(words.where(F.col("lang") == "*").select("word", F.col("rank").alias("g"))), F.lit(True))
    looked_up = written(own.join(pooled, ["ref", "word"], "full_outer"), "quality-lookup")
    ref = F.when(F.col("known"), F.col("lang")).otherwise(F.lit("*"))
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), F.coalesce("lang", F.lit("")).alias("lang"), words_of(text_of()).alias("words"))
    rows = rows.join(side(known.withColumn("known", F.lit(True))), "lang", "left").select("doc_id", "row_key", ref.alias("ref"), F.explode_outer("words").alias("word"))
    common = rows.join(side(looked_up), ["ref", "word"])
    counts = [F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in ("w", "g") for k in ranks]
    return common.groupBy("doc_id", "row_key").agg(*counts)


def judge(
    docs: DataFrame,
    *,
    common_words: int = 24,
    min_reference_words: int = 1000,
    min_chars: int = 200,
    min_words: int = 50,
    max_class_distance: float = 0.25,
    max_word_distance: float = 0.32,
    broadcast_rows: int = 10_000,
) -> DataFrame:
    """Base counts, both distances (null where a guard holds them back) and the verdict of every document."""
    stats = written(measured(docs), "quality-stats")
    classes = written(class_reference(stats, min_reference_words), "quality-classes")
    words = written(common_words_of(docs, common_words), "quality-words")
    few = classes.count() <= broadcast_rows
    side = F.broadcast if few else lambda df: df
    known = classes.select(F.col("lang"), F.lit(True).alias("known"))
    ranks = range(1, common_words + 1)
    hits = written(common_counts(docs, words, classes.where(F.col("lang") != "*").select("lang"), ranks, side), "quality-hits")
    # A row that is there twice was counted twice: its twins share the counts.
    twins = Window.partitionBy("doc_id", "row_key")
    rows = stats.join(side(known), "lang", "left").withColumn("ref", F.when(F.col("known"), F.col("lang")).otherwise(F.lit("*"))).drop("known")
    rows = rows.withColumn("twins", F.count("*").over(twins))
    h = hits.withColumnsRenamed({"doc_id": "h_id", "row_key": "h_key"})
    rows = rows.join(h, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("row_key") == F.col("h_key")), "left")
    per_row = [(F.coalesce(f"{c}_{k}", F.lit(0)) / F.col("twins")).alias(f"{c}_{k}") for c in ("w", "g") for k in ranks]
    rows = written(rows.select(*[c for c in rows.columns if not re.fullmatch(r"[wg]_\d+|h_id|h_key|twins", c)], *per_row), "quality-rows")
    good = rows.where(~F.col("base_failed"))
    total = F.sum("n_words")
    by = good.where(F.col("ref") != "*").groupBy("ref").agg(*[F.try_divide(F.sum(f"w_{k}"), total).alias(f"q_{k}") for k in ranks])
    pool = good.agg(*[F.try_divide(F.sum(f"g_{k}"), total).alias(f"q_{k}") for k in ranks]).select(F.lit("*").alias("ref"), *[f"q_{k}" for k in ranks])
    shares = by.unionByName(pool)
    reference = written(classes.withColumnRenamed("lang", "ref").drop("all_words").join(shares, "ref", "left"), "quality-reference")
    rows = rows.join(side(reference), "ref", "left")
    n_chars, n_words = F.greatest("n_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    by_class = _distance([F.col(f"c_{c}") / n_chars for c in CLASSES], [F.coalesce(f"q_{c}", F.lit(0.0)) for c in CLASSES])
    p = [F.when(F.col("ref") == "*", F.col(f"g_{k}")).otherwise(F.col(f"w_{k}")) / n_words for k in ranks]
    q = [F.coalesce(f"q_{k}", F.lit(0.0)) for k in ranks]
    rest = lambda shares: F.greatest(1 - sum(shares[1:], shares[0]), F.lit(0.0))
    by_word = _distance([*p, rest(p)], [*q, rest(q)])
    rows = rows.withColumn("class_distance", F.when(F.col("n_chars") >= min_chars, F.round(by_class, 6)))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= min_words, F.round(by_word, 6)))
    odd = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "word_distance",
    )
