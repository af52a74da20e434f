"""Band sizing and permutation constants; plain driver-side arithmetic."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: The Mersenne prime of the hash family and the 32-bit mask.
MERSENNE_61 = (1 << 61) - 1
MASK_32 = (1 << 32) - 1


@lru_cache(maxsize=64)
def optimal_bands(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted false-positive plus false-negative area.

    The chance that two texts of similarity s share a band is
    1-(1-s^r)^b. Its integral below the threshold and that of its complement
    above are taken with Gauss-Legendre nodes; of equal errors the one with
    fewest bands, then fewest rows, wins.
    """
    if num_perm < 1:
        raise ValueError("num_perm must be at least 1")
    x, w = np.polynomial.legendre.leggauss(200)

    def scaled(lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
        return (hi - lo) / 2 * x + (hi + lo) / 2, (hi - lo) / 2 * w

    (lo_s, lo_w), (hi_s, hi_w) = scaled(0.0, threshold), scaled(threshold, 1.0)
    best, least = (1, 1), float("inf")
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            fp = float(np.dot(lo_w, 1 - (1 - lo_s**r) ** b))
            fn = float(np.dot(hi_w, (1 - hi_s**r) ** b))
            if (error := fp_weight * fp + fn_weight * fn) < least:
                best, least = (b, r), error
    return best


@lru_cache(maxsize=16)
def permutations(seed: int, num_perm: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers in [1, p) and offsets in [0, p), drawn in turns from one seeded generator."""
    draw = np.random.RandomState(seed)
    pairs = np.array([(draw.randint(1, MERSENNE_61, dtype=np.uint64), draw.randint(0, MERSENNE_61, dtype=np.uint64)) for _ in range(num_perm)], dtype=np.uint64)
    return pairs[:, 0].copy(), pairs[:, 1].copy()
