import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftstone.llm import mixing
from siftstone.operators.components import NotConverged
from siftstone.llm.mixing import clean_source, fit_classifier, fit_rates, mix

WORDS = {"news": "minister vote court budget price".split(), "code": "def return import class self".split(), "poem": "rose moon heart sigh night".split()}


def corpus(n=400, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        s = draw.choices(["news", "code", "poem"], [6, 3, 1])[0]
        text = " ".join(draw.choice(WORDS[s]) for _ in range(draw.randrange(5, 80)))
        spelled = draw.choice([s, s.upper(), s + " ", None]) if draw.random() < 0.2 else s
        rows.append((i, text, spelled, s))
    return rows


def test_classifier_on_held_out_texts(spark):
    draw = np.random.RandomState(0)
    labels = draw.randint(0, 3, 600)
    features = []
    for label in labels:
        tokens = np.where(draw.rand(60) < 0.3, label * 50 + draw.randint(0, 50, 60), draw.randint(150, 400, 60))
        features.append(np.unique(tokens, return_counts=True))
    rows = [(int(y), b.tolist(), c.tolist(), k % 4 == 3) for k, (y, (b, c)) in enumerate(zip(labels, features))]
    sample = spark.createDataFrame(rows, "label int, bins array<int>, counts array<int>, held boolean").repartition(3)
    model = fit_classifier(sample, 3)
    assert model.accuracy > 0.9
    assert abs(model.posterior(*features[0]).sum() - 1) < 1e-9
    empty = fit_classifier(sample.limit(0), 3)
    assert np.allclose(empty.posterior(*features[0]), 1 / 3)


def test_rates_that_do_not_settle_raise(spark):
    rows = [([0.5, 0.5], 1000.0, 9, 0.0), ([0.45, 0.55], 1000.0, 9, 0.0)]
    units = spark.createDataFrame(rows, "membership array<double>, tokens double, cap int, start double")
    with pytest.raises(NotConverged):
        fit_rates(units, np.array([950.0, 1000.0]), max_steps=3)
    steps, _ = fit_rates(units, np.array([950.0, 1000.0]), max_steps=3, strict=False)
    assert len(steps) == 3


def test_rates_are_the_same_when_written_between(spark, monkeypatch):
    rows = [([0.7, 0.3], 1000.0, 2, 0.1), ([0.2, 0.8], 500.0, 3, 0.1), ([0.4, 0.6], 100.0, 1, 0.5)]
    units = spark.createDataFrame(rows, "membership array<double>, tokens double, cap int, start double")
    steps, reached = fit_rates(units, np.array([900.0, 700.0]))
    assert len(steps) > mixing.REBASE and np.allclose(reached, [900, 700], rtol=1e-5)
    monkeypatch.setattr(mixing, "REBASE", 10_000)
    assert np.allclose(fit_rates(units, np.array([900.0, 700.0]))[1], reached, rtol=1e-9)


def test_rates_meet_targets_or_stop_at_caps(spark):
    rows = [([1.0, 0.0], 1000.0, 2, 0.5), ([0.0, 1.0], 500.0, 3, 0.5), ([0.4, 0.6], 100.0, 1, 0.5)]
    units = spark.createDataFrame(rows, "membership array<double>, tokens double, cap int, start double")
    _, reached = fit_rates(units, np.array([900.0, 700.0]))
    assert np.allclose(reached, [900, 700], rtol=1e-3)
    _, reached = fit_rates(units, np.array([5000.0, 100.0]))
    assert reached[0] <= 2040.1 and reached[0] >= 1999.9


def test_shares(spark):
    rows = corpus(2000)
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows] + [(9001, None, "news"), (9002, "", "code"), (None, "x y", "poem"), (9003, "stray words", "unlisted")], "doc_id long, text string, source string")
    docs = docs.withColumn("uses", F.lit("clash"))
    goals = spark.createDataFrame([("News", 0.4, 1), ("code", 0.3, 2), ("poem", 0.3, 3), ("absent", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, shares = mix(docs, goals)
    got = {r["source"]: r for r in shares.collect()}
    caps = {"news": 1, "code": 2, "poem": 3, None: 1}
    for r in drawn.collect():
        assert 1 <= r["uses"] <= caps[r["source"]] and r["doc_id"] not in (9001, 9002, 9003, None)
    assert drawn.count() == drawn.select("doc_id").distinct().count()
    for s, share in (("news", 0.4), ("code", 0.3), ("poem", 0.3)):
        assert abs(got[s]["expected_share"] - share) < 1e-4
        assert abs(got[s]["reached_share"] + share * got[None]["reached_share"] - share) < 0.02
    again = sorted(map(tuple, mix(docs.repartition(7), goals)[0].collect()), key=str)
    assert again == sorted(map(tuple, drawn.collect()), key=str)


def test_short_sources_stop_at_their_repeats(spark):
    docs = spark.createDataFrame([(i, "one two three four " * 5, "big") for i in range(100)] + [(1000, "one two three four " * 5, "small")], "doc_id long, text string, source string")
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 4)], "source string, target_share double, max_repeats int")
    size = 2000
    drawn, shares = mix(docs, goals, total_tokens=size)
    got = {r["source"]: r for r in shares.collect()}
    assert got["small"]["uses"] == 4 and got["small"]["reached_share"] < 0.5 and got["big"]["tokens"] > 900
    assert mix(docs.limit(0), goals)[0].count() == 0 and mix(docs, goals.limit(0))[0].count() == 0


def test_source_names(spark):
    df = spark.createDataFrame([(" News ",), ("",), (None,), ("a b",)], "s string").select(clean_source(F.col("s")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["news", None, None, "a b"]
