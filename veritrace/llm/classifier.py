"""Quality classifier (op8): random Fourier features over document statistics, ridge, isotonic calibration.

1. Statistics of the whole text, computed by built-in functions: log counts, mean word and line lengths, shares of
   characters (upper case, digits, punctuation, symbols, pipes), of distinct words and distinct lines.
2. Standardised, they go through ``features`` cosines with Gaussian frequencies: inner products of these approximate a
   Gaussian kernel. Frequencies come from a fixed seed.
3. Each partition sums its normal equations; the driver adds them (``features`` squared numbers from at most ``parts``
   partitions) and solves. At most ``max_labelled`` rows are learnt from, the first by a hash of the id (also where ids repeat).
4. Pool-adjacent-violators turns scores of folds that the ridge did not see into a monotone probability.

Only rows with crc32(doc_id as text) mod 5 other than 0 are learnt from. Defined cases: a null text is empty and gets a
score like any text; labels that are null or not 0/1, and labels of unlike quality for one id, are not learnt from; without
both labels every score is the share of label 1 (1 if there are none); repeated rows are scored each, ties alike; very long
texts are measured whole; an empty table gives no rows; other columns are ignored, and `accepted` keeps them whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, named_apart, text_of, words_of, written

FOLDS = 5


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % FOLDS


def statistics_of(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1))
    # One pass takes out most of a text; the other characters are counted in what it leaves.
    rest = F.regexp_replace(text, r"[\p{Ll}\p{Lo}\x20\x09-\x0D]+", "")

    def on_rest(r: Column) -> Column:
        def share(chars: str) -> Column:
            return (F.length(r) - F.length(F.translate(r, chars, ""))) / n

        upper = F.length(r) - F.length(F.regexp_replace(r, r"\p{Lu}+", ""))
        return F.array(upper / n, share("0123456789"), share(".,;:?'\"()-"), share("!"), share("|"), share("#*$%&<>"), share("@/_=+~^{}[]\\"))

    def on_words(w: Column) -> Column:
        size, distinct = F.greatest(F.size(w), F.lit(1)), F.size(F.array_distinct(w))
        return F.array(F.log1p(F.size(w).cast("double")), F.length(F.array_join(w, "")) / size, distinct / F.sqrt(size), distinct / size)

    def on_lines(x: Column) -> Column:
        return F.array(F.log1p(F.size(x).cast("double")), F.log1p(n / F.size(x)), F.size(F.array_distinct(x)) / F.size(x))

    return F.concat(F.array(F.log1p(F.length(text).cast("double"))), let(rest, on_rest), let(words_of(text), on_words), let(F.split(text, "\n"), on_lines))


class Model:
    """Scores of a matrix of statistics."""

    def __init__(self, width: int, features: int, bandwidth: float, seed: int):
        draw = np.random.default_rng(seed)
        self.frequencies = draw.normal(size=(width, features)) / bandwidth
        self.phases = draw.uniform(0, 2 * np.pi, features)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights: np.ndarray | None = None
        self.knots, self.levels = np.zeros(1), np.ones(1)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([cosines, z, np.ones((len(x), 1))])  # linear terms carry what lies outside the kernel's reach

    def raw(self, x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        r = self.raw(x, self.weights)
        # The step function has ties; a thousandth of the raw order breaks them and keeps it monotone.
        return 0.999 * np.interp(r, self.knots, self.levels) + 0.001 / (1 + np.exp(-4 * (r - 0.5)))


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the mean score and mean label of each pool, both ascending."""
    order = np.argsort(scores, kind="stable")
    pools: list[list[float]] = []  # score sum, label sum, rows
    for s, y in zip(scores[order].tolist(), labels[order].tolist()):
        pools.append([s, y, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], a)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _sums(rows: DataFrame, body, width: int) -> list[np.ndarray]:
    """body(x, y, fold) -> flat sums of a batch; summed by partition, then over the few partitions by fold."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y, fold = np.array(b["x"].tolist(), float).reshape(len(b), -1), b["y"].to_numpy(float), b["fold"].to_numpy()
            for k in np.unique(fold):
                own = fold == k
                total[int(k)] = total.get(int(k), 0) + body(x[own], y[own])
        if total:
            yield pd.DataFrame({"fold": list(total), "sums": [v.tolist() for v in total.values()]})

    out = [np.zeros(width) for _ in range(FOLDS)]
    for r in sorted(rows.mapInPandas(part, "fold int, sums array<double>").collect(), key=lambda r: (r["fold"], r["sums"])):
        out[r["fold"]] += np.array(r["sums"])
    return out


def fit(docs: DataFrame, labels: DataFrame, *, features: int = 192, bandwidth: float = 4.0, ridge: float = 1e-2, seed: int = 8, max_labelled: int = 100_000, parts: int = 32) -> Model:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    known = known.where((F.col("y") == F.col("z")) & (fold_of(F.col("doc_id")) != 0)).select("doc_id", "y")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", text_of().alias("text")).join(known, "doc_id")
    place = (F.xxhash64(F.lit(seed), "doc_id").alias("o1"), F.xxhash64("text").alias("o2"))
    rows = rows.select(fold_of(F.col("doc_id")).cast("int").alias("fold"), F.col("y").cast("int").alias("y"), statistics_of(F.col("text")).alias("x"), *place)
    rows = written(rows, "quality-known")
    if rows.count() > max_labelled:  # ids that repeat: the bound holds for rows too
        rows = rows.orderBy("o1", "o2", "x").limit(max_labelled)
    # Dealt by id and text, so that copies of one text spread; sums then come from a fixed number of partitions.
    rows = written(rows.repartition(parts, "o1", "o2").drop("o1", "o2"), "quality-labelled")
    width = len(first["x"]) if (first := rows.first()) else 1
    model = Model(width, features, bandwidth, seed)
    moments = sum(_sums(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * width))
    n, ones = moments[:2]
    if not 0 < ones < n:
        model.levels = np.array([ones / n if n else 1.0])
        return model
    model.mean = moments[2 : 2 + width] / n
    model.scale = np.sqrt(np.maximum(moments[2 + width :] / n - model.mean**2, 1e-9))
    d = features + width + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        m = model.mapped(x)
        return np.concatenate([(m.T @ m).ravel(), m.T @ y])

    sums = _sums(rows, normal, d * d + d)

    def solved(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[: d * d].reshape(d, d) + ridge * n / 100 * np.eye(d), s[d * d :])

    total = sum(sums)
    held = np.array([solved(total - sums[k]) for k in range(FOLDS)])

    def unseen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, fold = np.array(b["x"].tolist(), float).reshape(len(b), -1), b["fold"].to_numpy()
            yield pd.DataFrame({"r": (model.mapped(x) * held[fold]).sum(1), "y": b["y"]})

    pairs = rows.mapInPandas(unseen, "r double, y int").toPandas().sort_values(["r", "y"])  # at most max_labelled
    model.knots, model.levels = isotonic(pairs["r"].to_numpy(), pairs["y"].to_numpy(float))
    model.weights = solved(total)
    return model


def scored(docs: DataFrame, labels: DataFrame, name: str = "quality_score", **options) -> DataFrame:
    """The documents' columns and their score, in a new column of this name."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")
    model = fit(docs.select("doc_id", "text"), labels, **options)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(model.score(np.array(x.tolist(), float).reshape(len(x), -1)) if len(x) else [], dtype=float)

    return docs.withColumn(name, F.pandas_udf(score, "double")(statistics_of(text_of())))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score reaches the threshold."""
    (name,) = named_apart(docs, "score")
    return scored(docs, labels, name, **options).where(F.col(name) >= threshold).drop(name)


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    rows = scored(docs.select("doc_id", "text"), labels, **options)
    return rows.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted")
    )
