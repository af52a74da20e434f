"""MinHash signatures: one Arrow-batched Python function, everything else stays in the JVM."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.lsh import MASK_32, MERSENNE_61, permutations
from siftstone.functions.text import PUNCTUATION, WORD_BREAK
from siftstone.functions.windows import code_points, window_hashes
from siftstone.params import DedupParams

#: Values hashed against all permutations at once, so that the work arrays fit a core's cache.
CHUNK = 256
#: Windows of neighbouring texts whose distinct n-grams are hashed together; a longer text is a group of its own.
GROUP = 100_000
#: Token hashes remembered by a Python worker.
MEMO = 500_000
_PUNCT, _SPACE = re.compile(PUNCTUATION), re.compile(WORD_BREAK)


def shingle_set(text: str, params: DedupParams) -> set[str]:
    """Distinct runs of fragments between punctuation marks or white space; empty when there are too few."""
    n = params.ngram
    parts = (_PUNCT if params.tokenizer == "punctuation" else _SPACE).split(text)
    return {" ".join(parts[i : i + n]) for i in range(len(parts) - n + 1)}


def permuted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(h*a+b mod 2^64) mod (2^61-1) mod 2^32: one row per hash, one column per permutation."""
    out = np.empty((len(hashes), len(a)), dtype=np.uint32)
    p, bits = np.uint64(MERSENNE_61), np.uint64(61)
    y = np.empty((min(CHUNK, len(hashes)), len(a)), dtype=np.uint64)
    high, over = np.empty_like(y), np.empty(y.shape, dtype=bool)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK, None]
        k = len(h)
        np.multiply(h, a, out=y[:k])
        y[:k] += b
        np.right_shift(y[:k], bits, out=high[:k])
        y[:k] &= p
        y[:k] += high[:k]
        np.greater_equal(y[:k], p, out=over[:k])
        np.subtract(y[:k], p, out=y[:k], where=over[:k])
        out[at : at + k] = y[:k]
    return out


def signer(params: DedupParams) -> Callable[[pd.Series], pd.Series]:
    """Batch function: texts to signatures of ``num_perm`` unsigned 32-bit values held in bigints.

    An n-gram that occurs in several texts of a group is hashed and permuted
    once; each text then takes the least value per permutation over its rows.
    """
    a, b = permutations(params.seed, params.num_perm)
    memo: dict[str, int] = {}
    empty = None if params.short_docs == "keep" else np.full(params.num_perm, MASK_32, dtype=np.int64)

    def hashed(tokens) -> np.ndarray:
        if len(memo) > MEMO:
            memo.clear()
        out = np.empty(len(tokens), dtype=np.uint64)
        for k, token in enumerate(tokens):
            h = memo.get(token)
            if h is None:
                h = memo[token] = int.from_bytes(hashlib.sha1(token.encode("utf-8", "surrogatepass")).digest()[:4], "little")
            out[k] = h
        return out

    def least(values: np.ndarray) -> np.ndarray:
        return np.minimum.reduce(values, axis=0).astype(np.int64)

    def sign_group(texts: list[str], names: list[np.ndarray]) -> list[np.ndarray]:
        starts = np.cumsum([0] + [len(x) for x in names])
        _, first, row = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
        owner = np.searchsorted(starts, first, side="right") - 1
        at, n = (first - starts[owner]).tolist(), params.ngram
        hashes = hashed([texts[o][i : i + n] for o, i in zip(owner.tolist(), at)])
        if len(texts) == 1:  # perhaps a very long text: no table of all its values
            return [least(np.stack([permuted(hashes[k : k + GROUP // 8], a, b).min(axis=0) for k in range(0, len(hashes), GROUP // 8)]))]
        values = permuted(hashes, a, b)
        return [least(values[row[s:e]]) for s, e in zip(starts[:-1], starts[1:])]

    def sign_characters(texts: pd.Series) -> list:
        out: list = [None] * len(texts)
        where: list[int] = []
        group: list[str] = []
        names: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                for k, sig in zip(where, sign_group(group, names)):
                    out[k] = sig
            where.clear(), group.clear(), names.clear()
            size = 0

        for k, text in enumerate(texts):
            if text is None or text is pd.NA:
                continue
            windows = window_hashes(code_points(text), params.ngram)
            if not len(windows):
                out[k] = empty
                continue
            if size + len(windows) > GROUP:
                flush()
            where.append(k), group.append(text), names.append(windows)
            size += len(windows)
        flush()
        return out

    def sign_shingles(texts: pd.Series) -> list:
        out: list = []
        for text in texts:
            tokens = None if text is None or text is pd.NA else shingle_set(text, params)
            out.append(None if tokens is None else least(permuted(hashed(tokens), a, b)) if tokens else empty)
        return out

    def sign(texts: pd.Series) -> pd.Series:
        return pd.Series(sign_characters(texts) if params.tokenizer == "character" else sign_shingles(texts), dtype=object)

    return sign


def signature(normalized_text: Column, params: DedupParams) -> Column:
    """``array<bigint>``; all 2^32-1 for texts without tokens (null with short_docs="keep"), null for null."""
    sign = signer(params)

    @F.pandas_udf("array<bigint>")
    def minhash(texts: pd.Series) -> pd.Series:
        return sign(texts)

    # so marked, a filter on its result is not pushed below it, which would run it twice
    return minhash.asNondeterministic()(normalized_text)
