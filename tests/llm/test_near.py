import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import near
from siftstone.llm.near import SKETCH, SKETCH_ERRORS, _blocks, candidates, gram_hashes, minima, plan_bands, plan_rows, signatures, similar_groups, similar_pairs


def grams(t):
    t = t.lower()
    return {t[i : i + 5] for i in range(len(t) - 4)}


def brute(rows, threshold=0.7):
    have = [(i, grams(t)) for i, t in rows if t is not None and len(t) >= 40]
    return {(min(i, j), max(i, j)) for x, (i, a) in enumerate(have) for j, b in have[x + 1 :] if len(a & b) >= threshold * len(a | b)}


def corpus(seed=0, n=120):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzäñ漢😀") for _ in range(draw.randrange(3, 9))) for _ in range(400)]
    texts = []
    for _ in range(n):
        base = [draw.choice(words) for _ in range(draw.randrange(8, 120))]
        texts.append(" ".join(base))
        for _ in range(draw.randrange(0, 3)):
            changed = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 8)):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            texts.append(" ".join(changed))
    return list(enumerate(texts))


def test_bands_for_recall():
    b = plan_bands(0.7, 0.995, 7)
    assert 1 - (1 - 0.7**7) ** b >= 0.995 > 1 - (1 - 0.7**7) ** (b - 1)


def test_rows_follow_the_size():
    assert [plan_rows(n) for n in (0, 10, 500_000, 500_001, 5_000_000, 10**9)] == [7, 7, 7, 8, 8, 11]


def test_more_rows_find_the_same_pairs(spark):
    rows = corpus(5, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {(r["doc_a"], r["doc_b"]) for r in similar_pairs(df, rows=9).collect()}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_gram_hashes_are_the_set():
    for t in ("abc", "abcde", "aaaaaaaaaa", "日本語文字列😀ab", "ABCabcABC" * 9):
        assert len(gram_hashes(t)) == len(grams(t))


def test_pairs_against_brute_force(spark):
    rows = corpus() + [(9000, None), (9001, ""), (9002, "x" * 39), (9003, "y" * 40), (9004, "y" * 41), (9005, "Y" * 40), (9006, "z" * 100_000), (9007, "z" * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_a"], r["doc_b"]) for r in similar_pairs(df).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)


def test_large_band_groups_are_cut_into_blocks(spark):
    """Many near copies share their bands; blocks of 8 find the same pairs as one group."""
    draw = random.Random(3)
    base = [f"word{k:03d}" for k in range(60)]
    rows = [(i, " ".join(w if draw.random() > 0.01 else f"other{draw.randrange(99)}" for w in base)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r["doc_a"], r["doc_b"]) for r in similar_pairs(df).collect()}
    cut = {(r["doc_a"], r["doc_b"]) for r in similar_pairs(df, block=8).collect()}
    assert whole == cut == brute(rows) and len(whole) > 1000


def test_copies_and_groups(spark):
    text = "the same page stands here again and again, word for word and mark for mark"
    rows = [(7, text), (3, text), (9, text), (5, text + "!"), (1, "something else entirely that shares nothing with the rest of them")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep int, a int")
    pairs = sorted((r["doc_a"], r["doc_b"]) for r in similar_pairs(df).collect())
    assert pairs == [(3, 5), (3, 7), (3, 9), (5, 7), (5, 9), (7, 9)]
    groups = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in similar_groups(df).collect()}
    assert groups == {7: (3, 3), 3: (3, 3), 9: (3, 3), 5: (3, 3), 1: (1, 0)}
    assert similar_pairs(df.limit(0)).count() == 0 and similar_groups(df.limit(0)).count() == 0


def test_repeated_rows_and_ids(spark):
    text = "one page that stands in the table more than once, under more than one number"
    rows = [(1, text), (1, text), (2, text), (2, text), (3, text + "!"), (4, "a wholly different text which is under number four, twice"), (4, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_a"], r["doc_b"]) for r in similar_pairs(df).collect())
    assert got == [(1, 2), (1, 3), (2, 3)]


def test_signatures_do_not_depend_on_batches(spark):
    df = spark.createDataFrame(corpus(2, 20), "doc_id long, text string")
    one = {r["doc_id"]: r["bands"] for r in signatures(df.coalesce(1), 10).collect()}
    assert one == {r["doc_id"]: r["bands"] for r in signatures(df.repartition(7), 10).collect()}


@pytest.mark.parametrize("size", [1, 2, 40, 300, 5000])
def test_minima_agree_as_often_as_sets_do(size):
    draw = np.random.default_rng(size)
    for share in (0.0, 0.5, 0.85):
        got, want = [], []
        for _ in range(60 if size < 5000 else 20):
            both = round(size * share)
            x = draw.integers(0, 1 << 63, 2 * size - both).astype(np.uint64)
            one, two = x[:size], np.concatenate([x[:both], x[size:]])
            low = minima([np.sort(one), np.sort(two)], 434)
            got.append((low[0] == low[1]).mean()), want.append(both / (2 * size - both))
        assert abs(np.mean(got) - np.mean(want)) < 0.02, (size, share)


def test_minima_do_not_depend_on_company(monkeypatch):
    draw = np.random.default_rng(5)
    parts = [np.sort(draw.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 7, 90, 2000, 9000)]
    together = minima(parts, 300)
    assert all((minima([p], 300)[0] == row).all() for p, row in zip(parts, together))
    monkeypatch.setattr(near, "GROUP", 1000)  # arrays in pieces
    assert (minima(parts, 300) == together).all()


def test_the_sketch_loses_next_to_nothing():
    """Chance that a pair just at the threshold has too few equal bytes in its sketch."""
    least = math.ceil(SKETCH * (0.7 - SKETCH_ERRORS * math.sqrt(0.7 * 0.3 / SKETCH)))
    p = 0.7 + 0.3 / 256
    assert sum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(least)) < 1e-4


def test_blocks_bound_what_a_task_sees(spark):
    """One key of 100,000 rows: each pair of blocks holds about ``block`` rows, and any two rows meet once."""
    rows = spark.range(100_000).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("doc_id"), F.lit(10).alias("grams"), F.lit(100_000).cast("long").alias("n"))
    cut = _blocks(rows, "n", 4096)
    per = cut.groupBy("key", "part").count().agg(F.max("count").alias("most"), F.count("*").alias("parts")).first()
    assert per["most"] <= 4096 * 1.2 and per["parts"] == 49 * 50 // 2
    assert cut.count() == 49 * 100_000


@pytest.mark.parametrize("how", [{"block": 16}, {"block": 16, "hot_share": 0.2}, {"block": 100_000}])
def test_candidates_of_a_hot_key(spark, how):
    """A key with most rows, found by its share or only by its count, gives the pairs whose sizes fit."""
    draw = random.Random(9)
    sizes = [draw.randrange(10, 400) for _ in range(700)]
    signed = spark.createDataFrame([(i, n, [-5, 100 + i // 2]) for i, n in enumerate(sizes)], "doc_id long, grams int, bands array<long>").repartition(3)
    got = [(r["a"], r["b"]) for r in candidates(signed, 0.7, **how).collect()]
    want = {(i, j) for i, x in enumerate(sizes) for j, y in enumerate(sizes[i + 1 :], i + 1) if min(x, y) >= 0.7 * max(x, y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_many_copies_are_expanded_in_blocks(spark):
    text = "one page of which there are very many copies, all of them the same to the last mark"
    rows = [(i, text) for i in range(60)] + [(100 + i, text + "!") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_a"], r["doc_b"]) for r in similar_pairs(df, block=8).collect())
    ids = sorted(i for i, _ in rows)
    assert got == [(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :]]
