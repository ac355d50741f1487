"""String similarities and features as Column expressions; a pandas UDF only where there is no built-in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .phonetics import agreement

#: Share of each similarity in the name score, in the order in which they are summed (fixed values).
SHARES = {"jaro_winkler": 0.15, "token_set": 0.45, "token_sort": 0.25, "levenshtein": 0.10, "phonetic": 0.05}


def jaro_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, free, left = max(max(len(a), len(b)) // 2 - 1, 0), [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(left, (c for c, f in zip(b, free) if not f))) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_of(a: str, b: str) -> float:
    j = jaro_of(a, b)
    if j < 0.7:
        return j
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


def _pairwise(score):
    @F.pandas_udf(DoubleType())
    def udf(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else score(a, b) for a, b in zip(left, right)], dtype=float)

    return udf


jaro, jaro_winkler = _pairwise(jaro_of), _pairwise(jaro_winkler_of)


def jaro_winkler_ceiling(a: Column, b: Column) -> Column:
    """The most that two strings of these lengths can reach: the shorter one wholly matched, in order, with a common start."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    jaro = (2 + short / F.greatest(long, F.lit(1))) / 3
    return F.when(long == 0, 1.0).when(short == 0, 0.0).otherwise(jaro + F.least(short, F.lit(4)) * 0.1 * (1 - jaro))


def levenshtein_ceiling(a: Column, b: Column) -> Column:
    long = F.greatest(F.length(a), F.length(b))
    return F.when(long == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / F.greatest(long, F.lit(1)))


def at_least(score: Column, threshold: float) -> Column:
    """A score under the threshold counts as none."""
    if not 0 <= threshold <= 1:
        raise ValueError("a similarity threshold is between 0 and 1")
    return F.when(score < threshold, 0.0).otherwise(score)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(folded: Column) -> Column:
    return F.array_remove(F.split(folded, " "), "")


def sorted_line(words: Column) -> Column:
    """The tokens in order, as one line."""
    return F.array_join(F.sort_array(words), " ")


def sorted_set(words: Column) -> Column:
    return F.sort_array(F.array_distinct(words))


def token_sort(a: Column, b: Column) -> Column:
    return levenshtein_similarity(sorted_line(tokens(a)), sorted_line(tokens(b)))


def token_set(a: Column, b: Column) -> Column:
    return set_ratio(sorted_set(tokens(a)), sorted_set(tokens(b)))


def set_ratio(x: Column, y: Column) -> Column:
    """The best of what sorted sets of tokens share, against each of them, and of both. (These set operations keep their order.)"""
    both = F.array_intersect(x, y)
    one, two = (F.array_join(F.concat(both, F.array_except(s, t)), " ") for s, t in ((x, y), (y, x)))
    shared = F.array_join(both, " ")
    best = F.greatest(levenshtein_similarity(shared, one), levenshtein_similarity(shared, two), levenshtein_similarity(one, two))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(best)


def trigrams(folded: Column) -> Column:
    """Distinct three-letter pieces of each token, padded by one blank at both ends."""
    padded = F.transform(tokens(folded), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    pieces = F.transform(padded, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substring(t, i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def ratios(a: Column, b: Column, a_tokens: Column, b_tokens: Column, a_sounds: Column, b_sounds: Column) -> dict[str, Column]:
    """The five similarities of two folded names. Only Jaro-Winkler leaves the JVM."""
    return {
        "jaro_winkler": jaro_winkler(a, b), "token_set": token_set(a, b), "token_sort": token_sort(a, b),
        "levenshtein": levenshtein_similarity(a, b), "phonetic": agreement(a_tokens, a_sounds, b_tokens, b_sounds),
    }


def name_score(a: Column, b: Column, a_sounds: Column, b_sounds: Column) -> Column:
    """0 to 100, of folded names and the sound keys of their tokens (columns of their own, for a lambda can't hold a Python function)."""
    parts, total = ratios(a, b, tokens(a), tokens(b), a_sounds, b_sounds), F.lit(0.0)
    for k, share in SHARES.items():
        total = total + share * parts[k]
    return 100 * total
