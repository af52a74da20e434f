import random

import numpy as np
from pyspark.sql import functions as F

from siftstone.functions.windows import window_hashes
from siftstone.llm.repetition import likelihood_ratios, repeated_units, repetition, repetitive


def brute(text, w=30):
    units = [c for c in text.casefold() if c.isalnum()]
    seen, marked = set(), set()
    for i in range(len(units) - w + 1):
        window = tuple(units[i : i + w])
        if window in seen:
            marked.update(range(i, i + w))
        seen.add(window)
    return len(units), len(marked)


def test_against_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        parts = ["".join(draw.choice("abcdé ,.1漢😀") for _ in range(draw.randrange(5, 60))) for _ in range(4)]
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 12)))
        assert repeated_units(text) == brute(text)


def test_edges():
    assert repeated_units("") == (0, 0) and repeated_units("?! ") == (0, 0)
    assert repeated_units("a" * 30) == (30, 0) and repeated_units("a" * 31) == (31, 30)
    assert repeated_units("A" * 20 + "a" * 20) == (40, 39)
    assert repeated_units(("Straße 1, " * 40_000)) == brute("Straße 1, " * 400)[:0] + (len("strasse1") * 40_000, len("strasse1") * 40_000 - 8)


def test_windows_of_all_widths():
    codes = np.array([1, 2, 3, 1, 2, 3, 1, 2, 9, 1, 2, 3], dtype=np.uint32)
    for w in range(1, 13):
        h = window_hashes(codes, w)
        windows = [tuple(codes[i : i + w]) for i in range(len(codes) - w + 1)]
        assert len(h) == len(windows)
        assert [[a == b for b in windows] for a in windows] == [[a == b for b in h] for a in h]
    assert len(window_hashes(codes, 13)) == 0


def test_table(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "ab " * 50, "z"), (3, "ab " * 50, "z"), (4, "short", "w"), (None, "ab " * 50, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_units string")
    got = {(r["doc_id"], r["n_units"]): r["repeated_share"] for r in repetition(df).collect()}
    assert got[1, None] is None and got[2, 0] == 0.0 and got[4, 5] == 0.0 and got[3, 100] > 0.9 and (None, 100) in got
    assert sorted(str(r["doc_id"]) for r in repetitive(df).collect()) == ["3", "3", "None"]
    assert repetitive(df.limit(0)).count() == 0


def test_the_ratio_loses_no_repetitive_text(spark):
    """Texts of every repeated share: whatever reaches the share reaches the threshold, and texts without repetition do not (while most texts are such)."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(7))
    rows = []
    for k in range(300):
        block = [word() for _ in range(draw.randrange(6, 60))]
        rest = [word() for _ in range(draw.randrange(0, 200))]
        rows.append((k, " ".join(rest + block * draw.choice([1, 1, 1, 1, 1, 1, 2, 3]))))
    rows += [(900, None), (901, ""), (902, "short"), (903, "z" * 5000), (903, "z" * 5000)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, bins int, llr double").repartition(3)
    got = likelihood_ratios(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["n_units"] and r["n_repeated"] >= 0.30 * r["n_units"]:
            assert r["flagged"]
        if not r["n_repeated"]:
            assert not r["flagged"]
    want = sorted(r["doc_id"] for r in got if r["n_units"] and r["n_repeated"] >= 0.30 * r["n_units"])
    assert sorted(r["doc_id"] for r in repetitive(df).collect()) == want and len(want) > 20
    scores = {r["doc_id"]: r["llr"] for r in got}
    assert scores[900] is None and scores[902] is None and scores[903] == max(x for x in scores.values() if x is not None)
    assert likelihood_ratios(df.limit(0)).count() == 0 and repetitive(df.where("text is null")).count() == 0


def test_a_named_target(spark):
    """Trusted rows given by the caller fill the target's classes; equal multinomials give scores of 0."""
    base = "the same line of words comes back again and again in this text "
    df = spark.createDataFrame([(k, base * 4, True) for k in range(5)], "doc_id long, text string, good boolean")
    got = [r["llr"] for r in likelihood_ratios(df, trusted=F.col("good")).collect()]
    assert all(abs(x) < 1e-9 for x in got)
