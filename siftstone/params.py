"""Validated run parameters; they live on the driver only."""

from __future__ import annotations

from dataclasses import dataclass, replace

from siftstone.functions.lsh import optimal_bands
from siftstone.operators.components import TASK_EDGES


@dataclass(frozen=True)
class DedupParams:
    """How texts become signatures, bands and links.

    ``strip_punctuation`` deletes ASCII punctuation after lower-casing, and
    ``ignore_pattern``, a Java regular expression, whatever it matches after that;
    ``tokenizer`` is "character" (code-point n-grams), "punctuation"
    (fragments between punctuation marks) or "space" (word n-grams).
    ``short_docs`` says what happens to texts with fewer than ``ngram``
    tokens: "merge" gives them one common signature, so one of them
    survives; "keep" leaves them alone. A null text is always kept and never
    linked. ``id_order`` is "native" or "string" and decides which member of a
    group is the smallest, hence kept. At most ``task_edges`` links are left to one
    task when components are formed; 0 contracts all of them in rounds.
    """

    threshold: float = 0.7
    num_perm: int = 128
    ngram: int = 5
    seed: int = 42
    lowercase: bool = True
    strip_punctuation: bool = False
    ignore_pattern: str | None = None
    tokenizer: str = "character"
    short_docs: str = "merge"
    id_order: str = "native"
    bands: int | None = None
    rows: int | None = None
    max_iterations: int = 100
    task_edges: int = TASK_EDGES

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must lie in [0, 1]")
        if self.num_perm < 1 or self.ngram < 1 or self.max_iterations < 1:
            raise ValueError("num_perm, ngram and max_iterations must be at least 1")
        if self.tokenizer not in ("character", "punctuation", "space"):
            if self.tokenizer == "sentencepiece":
                raise NotImplementedError("sentencepiece shingles are not offered")
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")
        if self.short_docs not in ("merge", "keep") or self.id_order not in ("native", "string"):
            raise ValueError("short_docs is merge|keep, id_order is native|string")
        if self.bands is None or self.rows is None:  # one alone is recomputed with the other
            bands, rows = optimal_bands(self.threshold, self.num_perm)
            object.__setattr__(self, "bands", bands)
            object.__setattr__(self, "rows", rows)
        if self.bands < 1 or self.rows < 1 or self.bands * self.rows > self.num_perm:
            raise ValueError("bands * rows must lie in [1, num_perm]")

    def with_(self, **changes) -> DedupParams:
        if {"threshold", "num_perm"} & set(changes) and "bands" not in changes:
            changes |= {"bands": None, "rows": None}
        return replace(self, **changes)


#: Lower-casing only, 5-grams, the document's own id.
PLAIN = DedupParams()
#: Lower-casing and punctuation deletion, 3-grams, threshold 0.8.
STRIPPED = DedupParams(threshold=0.8, ngram=3, strip_punctuation=True)
