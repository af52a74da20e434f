"""Operators against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftstone.operators.components import NotConverged, connected_components
from siftstone.operators.edges import star_edges
from siftstone.operators.ranking import grouped_position, sequential_ids
from siftstone.operators.skew import heavy_keys, lookup, salted_key_stats


def roots_of(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


GRAPHS = {
    "empty": [],
    "path": [(i, i + 1) for i in range(40)],
    "backward": [(i + 1, i) for i in range(40)],
    "star": [(99, i) for i in range(30)],
    "two": [(1, 2), (3, 4), (4, 5)],
    "loops": [(7, 7), (1, 2), (2, 2)],
    "repeats": [(1, 2), (2, 1), (1, 2)],
    "nulls": [(None, 1), (2, None), (3, 4)],
    "zigzag": [(i, 100 - i) for i in range(50)] + [(i + 1, 100 - i) for i in range(49)],
}


@pytest.mark.parametrize("in_task", [0, 10, 1000])
@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name, in_task):
    df = spark.createDataFrame(GRAPHS[name], "src long, dst long")
    got = connected_components(df, task_edges=in_task).collect()
    assert {r["node"]: r["root"] for r in got} == roots_of(GRAPHS[name]) and len(got) == len(roots_of(GRAPHS[name]))


def test_components_of_random_graphs(spark):
    draw = random.Random(3)
    links = [(draw.randrange(2000), draw.randrange(2000)) for _ in range(1500)]
    df = spark.createDataFrame(links, "src long, dst long").repartition(5)
    for in_task in (0, 1_000_000):
        assert {r["node"]: r["root"] for r in connected_components(df, task_edges=in_task).collect()} == roots_of(links)
    words = df.selectExpr("string(src) AS src", "string(dst) AS dst")
    want = roots_of([(str(a), str(b)) for a, b in links])
    for in_task in (0, 1_000_000):
        assert {r["node"]: r["root"] for r in connected_components(words, task_edges=in_task).collect()} == want


def test_component_rounds_are_limited(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    with pytest.raises(NotConverged):
        connected_components(df, max_iterations=1, task_edges=0)
    assert connected_components(df, max_iterations=1, strict=False, task_edges=0).count() == 61


def test_star_edges(spark):
    rows = [(0, "k", 5), (0, "k", 3), (0, "k", 9), (0, "k", 9), (1, "k", 3), (1, "z", 3), (1, "z", 9), (None, "k", 1), (0, None, 1), (0, "k", None)]
    got = star_edges(spark.createDataFrame(rows, "band_id int, band_hash string, doc_id long")).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [(3, 5), (3, 9)]


def test_salted_stats(spark):
    draw = random.Random(1)
    rows = [("hot" if draw.random() < 0.4 else f"k{draw.randrange(300)}", draw.choice([None, *range(60)])) for _ in range(4000)] + [(None, 1), (None, None), ("lonely", None)]
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    df = spark.createDataFrame(rows, "k string, v long").repartition(6)
    for share in (0.001, 0.1, 0.9):
        got = salted_key_stats(df, ["k"], "v", heavy_share=share, salt_rows_share=0.01).collect()
        assert {r["k"]: (r["n_rows"], r["min_value"], r["n_distinct"]) for r in got} == {
            k: (len(v), min((x for x in v if x is not None), default=None), len({x for x in v if x is not None})) for k, v in want.items()
        }
        assert len(got) == len(want)
    assert salted_key_stats(df.limit(0), ["k"], "v").count() == 0


def test_salted_stats_ignore_other_columns(spark):
    rows = [("a", 1, 0, 0, "x"), ("a", 1, 1, 1, "y"), ("a", 2, 2, 2, "z"), ("b", None, 3, 3, "w")]
    df = spark.createDataFrame(rows, "k string, v long, n_rows int, __salt int, __value string")
    got = {r["k"]: tuple(r)[1:] for r in salted_key_stats(df, ["k"], "v", heavy_share=0.1).collect()}
    assert got == {"a": (3, 1, 2), "b": (1, None, 0)}


def test_hot_rows_spread(spark):
    """A key with most rows takes part in as many groups as it has salts."""
    df = spark.range(20000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    hot = heavy_keys(df.select("k"), ["k"]).collect()
    assert [r["k"] for r in hot] == ["hot"] and hot[0]["key_rows"] == 13333
    stats = salted_key_stats(df, ["k"], "id")
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan
    assert stats.where("k = 'hot'").first()["n_distinct"] == 13333


def test_lookup(spark):
    rows = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 1), ("c", 2), (None, 3)], "k string, v long")
    names = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, name string")
    inner = lookup(rows, names, "k")
    assert inner.groupBy("name").count().orderBy("name").collect() == [("A", 500), ("B", 1)]
    left = lookup(rows, names, "k", how="left")
    assert left.count() == 503 and left.where("name is null").count() == 2


def test_positions(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, w long").repartition(5)
    got = grouped_position(df, ["g"], F.xxhash64("id"), F.col("w"), 16).collect()
    for g in "ab":
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(mine))) and len(mine) == sum(x[0] == g for x in rows)
        total = 0
        for r in mine:
            assert r["before"] == total
            total += r["w"]


def test_sequential_ids(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 9, 1, 3]], "v long")
    got = sorted((r["uid"], r["v"]) for r in sequential_ids(df, "v", "uid").collect())
    assert got == [(0, 1), (1, 3), (2, 3), (3, 5), (4, 9)]


def test_heavy_keys_are_exact(spark):
    """The sketch only names candidates; counts and the limit are exact, null keys included."""
    rows = [(k % 7, None) for k in range(700)] + [(100 + k, k) for k in range(20_000)] + [(None, None)] * 90 + [(8, 8)] * 21 + [(9, 9)] * 20
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = {(r["a"], r["b"]): (r["key_rows"], r["all_rows"]) for r in heavy_keys(df, ["a", "b"], 0.001).collect()}
    assert got == {(k, None): (100, 20831) for k in range(7)} | {(None, None): (90, 20831), (8, 8): (21, 20831)}
    assert heavy_keys(df.limit(0), ["a", "b"]).count() == 0
