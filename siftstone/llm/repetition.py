"""Repetition inside a text: a hashed n-gram likelihood ratio over re-occurring n-grams, and the exact repeated share.

The ratio compares two multinomials over the n-grams of texts, that of the raw
corpus and that of a trusted target. Which n-grams a text has says nothing on
whether it repeats itself (``marked=False`` shows it), so the classes are: an
n-gram's first place in its text, one class, and n-grams that stood earlier in
the same text, hashed into bins. The trusted target are texts that repeat no
n-gram, unless the caller names others. A text's score is the mean log ratio of
its n-grams; the threshold follows from the fitted ratios as the least score
that a text with the wanted repeated share can have, so it loses none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.windows import window_hashes
from siftstone.llm.units import letters_and_digits
from siftstone.operators.layout import spread
from siftstone.operators.scratch import written

#: Letters and digits in an n-gram, bins of re-occurring n-grams, pseudo-count of each class.
WINDOW, BINS, SMOOTHING = 30, 4096, 1.0


def _again(hashes: np.ndarray) -> np.ndarray:
    """Places of the windows that also stand earlier."""
    ordered = np.sort(hashes)
    if len(hashes) < 2 or not (ordered[1:] == ordered[:-1]).any():
        return np.empty(0, dtype=np.int64)
    order = np.argsort(hashes, kind="stable")
    return order[1:][hashes[order][1:] == hashes[order][:-1]]


def _covered(places: np.ndarray, units: int, window: int) -> int:
    """How many of the units lie in a window that starts at one of the places."""
    edge = np.zeros(units + 1, dtype=np.int64)
    edge[places] += 1
    edge[places + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_units(text: str, window: int = WINDOW) -> tuple[int, int]:
    """(letters and digits, how many of them lie in a window that also starts earlier in the text)."""
    codes = letters_and_digits(text)
    again = _again(window_hashes(codes, window))
    return len(codes), _covered(again, len(codes), window) if len(again) else 0


def n_gram_events(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bins: int = BINS, marked: bool = True, trusted: Column | None = None) -> DataFrame:
    """(doc_id, n_units, n_repeated, n_windows, bins, counts, trusted) of every row: a text's n-grams by class.

    One Arrow pass, whole texts, no shuffle. ``bins`` names the classes that occur
    in the text besides the common one, ``counts`` how often each; with ``marked``
    these are n-grams that stood earlier in the text, else all n-grams. A row is
    trusted if the condition says so, by default if no n-gram re-occurs. A null
    text gives nulls.
    """

    @F.pandas_udf("struct<n_units: bigint, n_repeated: bigint, n_windows: bigint, bins: array<int>, counts: array<bigint>, again: boolean>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            if text is None:
                rows.append((None, None, None, None, None, None))
                continue
            codes = letters_and_digits(text)
            hashes = window_hashes(codes, window)
            again = _again(hashes)
            of = hashes[again] if marked else hashes
            named, counts = np.unique((of % np.uint64(bins)).astype(np.int32), return_counts=True)
            rows.append((len(codes), _covered(again, len(codes), window) if len(again) else 0, len(hashes), named, counts, bool(len(again))))
        out = pd.DataFrame(rows, columns=["n_units", "n_repeated", "n_windows", "bins", "counts", "again"])
        return out.astype({"n_units": "Int64", "n_repeated": "Int64", "n_windows": "Int64", "again": "boolean"})

    known = F.lit(None).cast("boolean") if trusted is None else trusted
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), known.alias("known")))
    got = texts.select("doc_id", "known", measure("text").alias("m")).select("doc_id", "m.*", "known")
    return got.select("doc_id", "n_units", "n_repeated", "n_windows", "bins", "counts", F.coalesce("known", ~F.col("again"), F.lit(False)).alias("trusted"))


@dataclass(frozen=True)
class Ratios:
    """log(raw share / target share) of the common class and of each bin; ``seen`` tells the bins that occur."""

    common: float
    binned: np.ndarray
    seen: np.ndarray

    def least_score(self, share: float, window: int = WINDOW) -> float:
        """No text that repeats at least ``share`` of its units scores lower.

        A re-occurring window covers ``window`` units, so at least share/window of
        the windows re-occur; each brings the least ratio of a bin or more.
        """
        low = float(self.binned[self.seen].min()) if self.seen.any() else self.common
        return self.common + share / window * (low - self.common) if low > self.common else min(low, self.common)


def fit_ratios(events: DataFrame, bins: int = BINS, smoothing: float = SMOOTHING) -> Ratios:
    """Both multinomials over all rows of ``events``. The driver gets one row a bin."""
    each = events.select("trusted", F.explode(F.arrays_zip("bins", "counts")).alias("e")).groupBy(F.col("e.bins").alias("bin"))
    binned = each.agg(F.sum("e.counts").alias("raw"), F.sum(F.when(F.col("trusted"), F.col("e.counts")).otherwise(0)).alias("target")).toPandas()
    total = events.agg(F.sum("n_windows").alias("raw"), F.sum(F.when(F.col("trusted"), F.col("n_windows"))).alias("target")).first()
    counts = {}
    for side in ("raw", "target"):
        of = np.zeros(bins + 1)
        of[1 + binned["bin"].to_numpy(np.int64)] = binned[side].to_numpy(np.float64)
        of[0] = float(total[side] or 0) - of.sum()
        counts[side] = of
    logs = {side: np.log((of + smoothing) / (of.sum() + smoothing * len(of))) for side, of in counts.items()}
    ratio = logs["raw"] - logs["target"]
    return Ratios(float(ratio[0]), ratio[1:], counts["raw"][1:] > 0)


def scored(events: DataFrame, ratios: Ratios) -> DataFrame:
    """``events`` and ``llr``, the mean log ratio of a text's n-grams; null for texts without any."""

    @F.pandas_udf("double")
    def total(bins: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([0.0 if b is None else float(np.dot(ratios.binned[np.asarray(b, dtype=np.int64)] - ratios.common, np.asarray(c, dtype=np.float64))) for b, c in zip(bins, counts)])

    return events.withColumn("llr", F.when(F.col("n_windows") > 0, total("bins", "counts") / F.col("n_windows") + F.lit(ratios.common)))


def likelihood_ratios(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.30, window: int = WINDOW, bins: int = BINS, marked: bool = True, trusted: Column | None = None) -> DataFrame:
    """(doc_id, n_units, n_repeated, n_windows, llr, flagged) of every row.

    ``flagged`` is true where the score reaches the least one that a text with the
    repeated share ``least`` can have; false for shorter texts and null texts,
    which have no score. Fitted over all rows; repeated rows count each time.
    """
    events = written(n_gram_events(docs, id_col, text_col, window, bins, marked, trusted), "events")
    ratios = fit_ratios(events, bins)
    threshold = ratios.least_score(least, window) - 1e-9  # for rounding
    return scored(events, ratios).select("doc_id", "n_units", "n_repeated", "n_windows", "llr", F.coalesce(F.col("llr") >= threshold, F.lit(False)).alias("flagged"))


def _share(units: str = "n_units", repeated: str = "n_repeated") -> Column:
    return F.when(F.col(units) > 0, F.col(repeated) / F.col(units)).when(F.col(units) == 0, F.lit(0.0))


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_units, n_repeated, repeated_share) of every row.

    A pure projection: no shuffle, each text once, whole. A null text gives null
    in all three; a text without letters or digits gives 0, 0 and 0.0. Repeated
    ids give a row each.
    """

    @F.pandas_udf("struct<n_units: bigint, n_repeated: bigint>")
    def measure(texts: pd.Series) -> pd.DataFrame:
        found = [(None, None) if t is None else repeated_units(t, window) for t in texts]
        return pd.DataFrame(found, columns=["n_units", "n_repeated"]).astype("Int64")

    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    got = texts.select("doc_id", measure("text").alias("m")).select("doc_id", "m.n_units", "m.n_repeated")
    return got.withColumn("repeated_share", _share())


def repetitive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.30) -> DataFrame:
    """(doc_id) of texts whose repeated share is at least ``least``: those that the ratio flags, then checked exactly.

    The share is measured in the pass that makes the n-gram classes, so no text
    is read twice or moved.
    """
    return likelihood_ratios(docs, id_col, text_col, least).where(F.col("flagged") & (_share() >= least)).select("doc_id")
