"""MinHash signatures: with array functions for tables, with numpy for the story engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
PERMUTATIONS, BANDS = 128, 16
_OTHER = regex.compile(r"[^\p{L}\p{N}]+")


def coefficients(n: int) -> list[tuple[int, int]]:
    """(a, b) below PRIME of n permutations, the same each time."""
    rng = np.random.default_rng(7)
    return [(int(a), int(b)) for a, b in zip(rng.integers(1, PRIME, n), rng.integers(0, PRIME, n))]


def shingle_hash(shingle: Column) -> Column:
    """60 bits of MD5: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(shingle), 1, 15), 16, 10).cast("long")


def permuted(h: np.ndarray, a: int, b: int) -> np.ndarray:
    """(h * a + b) modulo PRIME, exact in 64 bits: products of halves of 31 bits, in which 2 ** 61 counts as 1."""
    low, u = np.uint64(2**31 - 1), np.uint64
    h1, h0, a1, a0 = h >> u(31), h & low, u(a >> 31), u(a & (2**31 - 1))
    mid = h1 * a0 + h0 * a1
    total = ((h1 * a1) << u(1)) + (mid >> u(30)) + ((mid & u(2**30 - 1)) << u(31)) + h0 * a0
    return (total % u(PRIME) + u(b)) % u(PRIME)


def signature(hashes: Column, n: int) -> Column:
    """The least value of each permutation over the hashes, which are of 60 bits; null for no hashes. Over Arrow batches."""
    pairs = coefficients(n)

    @F.pandas_udf("array<long>")
    def run(lists: pd.Series) -> pd.Series:
        filled = [x is not None and len(x) > 0 for x in lists]
        out: list[np.ndarray | None] = [None] * len(lists)
        at = np.flatnonzero(filled)
        # Some hundred lists at a time, so that long ones take no more memory than they have elements.
        for s in range(0, len(at), 256):
            own = at[s : s + 256]
            flat = np.concatenate([np.asarray(lists.iloc[i], np.uint64) for i in own])
            starts = np.concatenate([[0], np.cumsum([len(lists.iloc[i]) for i in own])[:-1]])
            low = np.stack([np.minimum.reduceat(permuted(flat, a, b), starts) for a, b in pairs], axis=1).astype(np.int64)
            for i, row in zip(own, low):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run(hashes)


def bands(sig: Column, n: int, rows: int) -> Column:
    """(band, key) of each ``rows`` neighbouring values."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.md5(F.array_join(F.slice(sig, i * rows + 1, rows), ",")).alias("key")) for i in range(n // rows)])


def estimate(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return same / F.size(a)


_A = np.random.default_rng(11).integers(1, 2**63, PERMUTATIONS, np.uint64) | np.uint64(1)
_B = np.random.default_rng(13).integers(0, 2**63, PERMUTATIONS, np.uint64)


def normalize(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def sketch(text: str, size: int = 5) -> np.ndarray | None:
    """Signature of a text's 5-character shingles; null without any. Plays the part of the table form with other hashes."""
    t = normalize(text)
    return sketch_of(t, size) if t else None


def sketch_of(t: str, size: int = 5) -> np.ndarray:
    """The same of a normal text that is not empty."""
    cps = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(1, len(cps) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(cps))):
        h = h * np.uint64(0x100000001B3) + cps[k : k + n]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    # Some hundred shingles at a time, so that a long text takes no more memory than a short one.
    h, low = np.unique(h), np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(low, (h[i : i + 512, None] * _A + _B).min(axis=0), out=low)
    return low


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """One number per band of each signature (rows of PERMUTATIONS values)."""
    rows = sigs.reshape(len(sigs), BANDS, -1)
    key = np.zeros(rows.shape[:2], np.uint64)
    for r in range(rows.shape[2]):
        key = (key ^ rows[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key
