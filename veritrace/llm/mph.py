"""A minimal perfect hash over 64-bit keys: cascaded bit arrays, built and probed with whole-array operations.

At each level every remaining key hashes to one bit of an array of ``gamma`` bits per key. Keys alone on their bit stay
there; the others go on. A key's slot is the rank of its bit among all set bits, so n keys get the slots 0 to n-1. Keys
left after ``LEVELS`` (in practice none) are held in a sorted list. A key outside the set gets some slot or -1: callers
tell it apart by a stored fingerprint.
"""

from __future__ import annotations

import numpy as np

LEVELS = 40
GAMMA = 2.0


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit keys (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    def __init__(self, bits: np.ndarray, sizes: np.ndarray, rest: np.ndarray):
        self.bits, self.sizes, self.rest = bits, sizes, rest
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        left, levels, sizes = keys.astype(np.uint64), [], []
        while len(left) and len(levels) < LEVELS:
            size = max(8, int(GAMMA * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        return cls(np.concatenate(levels) if levels else np.zeros(0, bool), np.array(sizes, np.int64), np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = self.offsets[level] + (mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            hit = self.rest[at] == keys[todo]
            out[todo[hit]] = (self.ranks[-1] + 1 if len(self.ranks) else 0) + at[hit]
        return out

    def parts(self) -> dict[str, bytes]:
        return {"bits": np.packbits(self.bits).tobytes(), "sizes": self.sizes.astype("<i8").tobytes(), "rest": self.rest.astype("<u8").tobytes()}

    @classmethod
    def of(cls, bits: bytes, sizes: bytes, rest: bytes) -> PerfectHash:
        n = np.frombuffer(sizes, "<i8")
        flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n.sum())).astype(bool)
        return cls(flags, n, np.frombuffer(rest, "<u8"))
