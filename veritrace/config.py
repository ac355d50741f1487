"""Settings and weights: immutable, checked when made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .errors import InvalidArgument, QueryError

SHARES = ("jaro_winkler", "token_set", "token_sort", "levenshtein", "phonetic")


@dataclass(frozen=True)
class Weights:
    #: Shares of the name score, and what evidence adds.
    jaro_winkler: float = 0.15
    levenshtein: float = 0.10
    token_sort: float = 0.25
    token_set: float = 0.45
    phonetic: float = 0.05
    low_quality_alias: float = -10.0
    identifier_match: float = 40.0
    dob_exact: float = 15.0
    dob_overlap: float = 6.0
    dob_conflict: float = -35.0
    nationality_match: float = 6.0
    nationality_conflict: float = -12.0

    def __post_init__(self):
        total = sum(getattr(self, k) for k in SHARES)
        if abs(total - 1) > 1e-9 or any(getattr(self, k) < 0 for k in SHARES):
            raise InvalidArgument(f"name shares must be 0 or more and sum to 1, they sum to {total}")
        for name in ("low_quality_alias", "dob_conflict", "nationality_conflict"):
            if getattr(self, name) > 0:
                raise InvalidArgument(f"{name} is a penalty: 0 or less")
        for name in ("identifier_match", "dob_exact", "dob_overlap", "nationality_match"):
            if getattr(self, name) < 0:
                raise InvalidArgument(f"{name} is a boost: 0 or more")

    def shares(self) -> dict[str, float]:
        """In the order in which they are summed."""
        return {k: getattr(self, k) for k in SHARES}


def threshold_of(value) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise QueryError(f"threshold must be a number between 0 and 100, got {value!r}") from None
    if not 0 <= number <= 100:
        raise QueryError(f"threshold must be between 0 and 100, got {value!r}: a score is a percentage")
    return number


@dataclass(frozen=True)
class Settings:
    threshold: float = 75.0
    limit: int = 10
    candidate_limit: int = 200
    postings_budget: int = 5000
    tolerance: float = 0.10
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self):
        threshold_of(self.threshold)
        if self.limit < 1 or self.candidate_limit < 1 or self.postings_budget < 1:
            raise InvalidArgument("limits are 1 or more")
        if not 0 <= self.tolerance <= 1:
            raise InvalidArgument("tolerance is a share between 0 and 1")

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)
