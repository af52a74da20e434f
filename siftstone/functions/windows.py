"""64-bit hashes of windows of code points, as array operations."""

from __future__ import annotations

import numpy as np

#: Base of the window hashes and the two factors of the finaliser.
FACTOR, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def code_points(text: str) -> np.ndarray:
    """The text's code points (uint32)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def unmixed(x: np.ndarray) -> np.ndarray:
    """What ``mixed`` was made from; both are one-to-one."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(int(MIX_2), -1, 1 << 64))
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * np.uint64(pow(int(MIX_1), -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` neighbouring codes; equal windows have equal hashes. Empty for shorter input.

    Hashes of windows of 1, 2, 4, ... codes come from those half as wide, and
    the wanted width is put together from its binary digits: about
    2*log2(width) array operations instead of width.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power = (codes.astype(np.uint64) + np.uint64(1)) * FACTOR
    out, done, size = None, 0, 1
    base = int(FACTOR)
    while size <= width:
        if width & size:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(base, size, 1 << 64)) + piece
            done += size
        if size * 2 <= width:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2
    return mixed(out)
