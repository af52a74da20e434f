"""Words of scripts without spaces, from statistics of a whole corpus.

A clause is a run of such letters between marks, blanks and other scripts. The
first and last letters of every clause are counted by what stands beside them: a
sure sentence boundary, three dots, or anything else. A prefix (suffix) of clauses
is a word where what follows it is harder to foresee than what followed its own
front (branching entropy does not fall), or where most clauses end. Words and their counts make the
dictionary of the word lattice and tell opening and closing words from others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.layout import spread
from siftstone.operators.scratch import written

#: Letters counted from a clause's edge; words are at most one shorter.
EDGE = 5
#: A string is kept when it holds this share of all clause edges (or of those beside three dots), so the table is bounded
#: by 2 sides x EDGE lengths x 2/LEAST_SHARE rows whatever the corpus.
LEAST_SHARE = 2e-5
CLAUSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U000323af]+")
#: Marks that always end a sentence of these scripts; line ends; marks that open.
ENDS, LINES, OPENING = "。！？｡", "\n\r\x0b\x0c\x85\u2028\u2029", "「『（《〈【“\"([ \u3000\t"
SURE, DOTS, OTHER = 0, 1, 2


def _before(text: str, at: int) -> int:
    while at and text[at - 1] in OPENING:
        at -= 1
    if not at or text[at - 1] in ENDS or text[at - 1] in LINES:
        return SURE
    return DOTS if text[at - 1] == "…" or text[at - 2 : at] == ".." else OTHER


def _after(text: str, at: int) -> int:
    if at >= len(text) or text[at] in LINES:
        return OTHER  # perhaps a heading
    return SURE if text[at] in ENDS else DOTS if text[at] == "…" or text[at : at + 2] == ".." else OTHER


def count_edges(text: str, into: Counter) -> None:
    """Adds (side, place, string) of every clause; side 0 are prefixes, 1 suffixes."""
    for m in CLAUSE.finditer(text):
        a, b = m.span()
        front, back = _before(text, a), _after(text, b)
        for k in range(1, min(EDGE, b - a) + 1):
            into[0, front, text[a : a + k]] += 1
            into[1, back, text[b - k : b]] += 1


def _entropy(counts: list[int], total: int) -> float:
    return -sum(n / total * math.log(n / total) for n in counts if n)


def _words(counts: dict[str, list[int]], side: int) -> set[str]:
    """Strings of two letters or more at which the entropy of the next letter (outward from the edge) does not fall."""
    total = {s: sum(n) for s, n in counts.items()}
    next_of: dict[str, list[int]] = {}
    for s, n in total.items():
        next_of.setdefault(s[:-1] if side == 0 else s[1:], []).append(n)
    entropy, whole = {}, set()
    for s, n in total.items():
        if len(s) < EDGE:
            known = next_of.get(s, [])
            rest = max(0, n - sum(known))  # the clause ends, or the longer string is rare
            entropy[s] = _entropy([*known, rest], n)
            if 2 * rest >= n:
                whole.add(s)
    return {s for s in entropy if len(s) > 1 and (s in whole or entropy[s] >= entropy.get(s[:-1] if side == 0 else s[1:], 0.0))}


@dataclass(frozen=True)
class Lexicon:
    """Counts of clause edges, (sure, dots, other) for each string, and the words among them."""

    heads: dict[str, list[int]] = field(default_factory=dict)
    tails: dict[str, list[int]] = field(default_factory=dict)
    totals: tuple[tuple[int, int, int], tuple[int, int, int]] = ((0, 0, 0), (0, 0, 0))
    words: frozenset[str] = frozenset()

    def odds(self, side: int, word: str) -> float:
        """Log of how much more often clauses begin (end) with the word at sure boundaries than beside three dots; 0 for unknown words."""
        n = (self.tails if side else self.heads).get(word)
        if n is None:
            return 0.0
        total = self.totals[side]
        value = math.log((n[SURE] + 0.5) / (total[SURE] + 1)) - math.log((n[DOTS] + 0.5) / (total[DOTS] + 1))
        return max(-5.0, min(5.0, value))


def fit_lexicon(docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE) -> Lexicon:
    """Counts over all texts, whole; equal strings add up map-side. Only strings above the share reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            sides, places, strings = zip(*counts)
            return pa.RecordBatch.from_arrays([pa.array(sides, pa.int32()), pa.array(places, pa.int32()), pa.array(strings), pa.array(list(counts.values()), pa.int64())], ["side", "place", "string", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                count_edges(text, counts)
                if len(counts) > 200_000:
                    yield out(counts)
                    counts = Counter()
        if counts:
            yield out(counts)

    texts = spread(docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()))
    rows = texts.mapInArrow(run, "side int, place int, string string, n bigint")
    placed = [F.sum(F.when(F.col("place") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (SURE, DOTS, OTHER)]
    each = rows.groupBy("side", "string").agg(*placed)
    each = written(each, "clause-edges")
    totals = [(0, 0, 0), (0, 0, 0)]
    for r in each.where(F.length("string") == 1).groupBy("side").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (SURE, DOTS, OTHER))).collect():
        totals[r["side"]] = (r["n0"], r["n1"], r["n2"])
    kept = each.where((F.col("n0") + F.col("n1") + F.col("n2") >= least_share * sum(totals[0])) | ((F.col("n1") > 0) & (F.col("n1") >= least_share * totals[0][DOTS])))
    heads: dict[str, list[int]] = {}
    tails: dict[str, list[int]] = {}
    for r in kept.collect():
        (tails if r["side"] else heads)[r["string"]] = [r["n0"], r["n1"], r["n2"]]
    return Lexicon(heads, tails, (totals[0], totals[1]), frozenset(_words(heads, 0) | _words(tails, 1)))
