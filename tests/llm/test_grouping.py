import random

import numpy as np
import pytest

from siftstone.functions.unionfind import union_find
from siftstone.llm.grouping import components, record_number


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


def random_links(n, nodes, seed):
    draw = random.Random(seed)
    return [(draw.randrange(nodes), draw.randrange(nodes)) for _ in range(n)] + [(0, draw.randrange(nodes)) for _ in range(n // 3)]


def test_union_find():
    for seed in range(30):
        links = random_links(60, 90, seed)
        node, root = union_find(*(np.array(c) for c in zip(*links)))
        want = roots_of(links)
        assert dict(zip(node.tolist(), root.tolist())) == {k: v for k, v in want.items() if k != v}


GRAPHS = {
    "empty": [],
    "nulls only": [(None, 1), (2, None)],
    "alone": [(7, 7), (8, 8), (8, 9)],
    "path": [(i, i + 1) for i in range(300)],
    "shuffled path": [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(900)],
    "star": [(500, i) for i in range(400)],
    "random": random_links(900, 1500, 1),
    "dense": random_links(3000, 500, 2),
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("bound", [1_000_000, 50])
def test_components(spark, name, bound):
    """A bound of 50 links a partition forces several levels."""
    df = spark.createDataFrame([(*x, "extra") for x in GRAPHS[name]], "a long, b long, node string").repartition(9)
    levels = []
    got = components(df, partition_links=bound, levels=levels).collect()
    want = roots_of(GRAPHS[name])
    assert len(got) == len(want) and {r["node"]: r["component"] for r in got} == want
    assert len(levels) <= 12 and levels == sorted(levels, reverse=True)


def test_ids_of_any_size(spark):
    links = [(-5, 7), (7, -(2**63)), (2**63 - 1, 0), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {-5: -(2**63), 7: -(2**63), -(2**63): -(2**63), 2**63 - 1: 0, 0: 0, 3: 3}


def test_record_numbers(spark):
    names = [" 007 ", "12", " 5\t", "x1", "", None, "0", "99999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(record_number("n").alias("k"))
    assert [r["k"] for r in df.collect()] == [7, 12, 5, None, None, None, 0, None]
