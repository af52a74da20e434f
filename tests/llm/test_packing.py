import itertools
import random

import numpy as np
import pytest

from siftstone.llm.packing import audit, batch_plan, fills, length_buckets, pack
from siftstone.llm.tokens import encoding, token_counts, vocabulary


def test_buckets_are_optimal():
    draw = random.Random(2)
    for _ in range(150):
        n, k = draw.randrange(1, 9), draw.randrange(1, 5)
        sizes = np.array(sorted(draw.sample(range(1, 40), n)))
        counts = np.array([draw.randrange(1, 9) for _ in range(n)])

        def padding(ends):
            return sum(int(c) * (int(ends[np.searchsorted(ends, s)]) - int(s)) for s, c in zip(sizes, counts))

        best = min(padding(np.array(sorted({*x, sizes[-1]}))) for r in range(k) for x in itertools.combinations(sizes[:-1], min(r, n - 1)))
        ends = length_buckets(sizes, counts, k)
        assert padding(ends) == best and len(ends) <= max(k, 1)


def test_plan_places_every_rank_once_within_capacity():
    draw = random.Random(3)
    for _ in range(200):
        cap = draw.randrange(20, 60)
        ends = np.array(sorted(draw.sample(range(1, cap + 1), draw.randrange(1, 9))))
        counts = np.array([draw.randrange(1, 30) for _ in ends])
        plan, used = batch_plan(ends, counts, cap)
        load, seen = np.zeros(used, int), set()
        for b, first, n, start, per in plan.tolist():
            for r in range(first, first + n):
                load[start + (r - first) // per] += ends[b]
                seen.add((b, r))
        assert len(seen) == counts.sum() and load.max() <= cap and load.min() > 0


def check(packed, counts, sizes):
    for name, capacity in sizes:
        mine = [r for r in packed if r["pack_name"] == name]
        fill, parts = {}, {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
            parts.setdefault(r["doc_id"], []).append((r["start_token"], r["n_tokens"]))
        assert max(fill.values(), default=0) <= capacity
        assert set(parts) == {i for i, n in counts.items() if n}
        for i, p in parts.items():
            at = 0
            for start, n in sorted(p):
                assert start == at
                at += n
            assert at == counts[i] and (len(p) == 1 or counts[i] > capacity)
        return_fill = sum(fill.values()) / (len(fill) * capacity) if fill else 1
        yield name, return_fill


def test_fixture(spark):
    rows = [(1, None), (2, ""), (3, "hello there"), (4, "word " * 1000), (5, "x"), (6, "word " * 20), (7, "word " * 40)]
    sizes = [("a", 20), ("b", 50)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, container int")
    packs = spark.createDataFrame(sizes, "pack_name string, capacity_tokens int")
    bpe = encoding(vocabulary())
    counts = {i: len(bpe.encode_ordinary(t)) for i, t in rows if t is not None}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect()} == {1: None, **counts}
    packed = pack(docs, packs).collect()
    assert len(dict(check(packed, counts, sizes))) == 2
    assert pack(docs.limit(0), packs).count() == 0 and pack(docs, packs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(docs, spark.createDataFrame([("z", 0)], "pack_name string, capacity_tokens int"))


def test_repeated_rows_are_packed_one_by_one(spark):
    docs = spark.createDataFrame([(1, "one two three four five")] * 10, "doc_id long, text string")
    packs = spark.createDataFrame([("p", 12)], "pack_name string, capacity_tokens int")
    packed = pack(docs, packs)
    assert packed.count() == 10 and fills(packed, packs).agg({"used_tokens": "max"}).first()[0] <= 12


def test_real_table_is_packed_tightly(spark):
    d = "/root/testdata/sf0.01"
    docs, packs = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/pack_sizes.parquet")
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs).collect() if r["n_tokens"]}
    sizes = [(r["pack_name"], r["capacity_tokens"]) for r in packs.collect()]
    for _, fill in check(pack(docs, packs).collect(), counts, sizes):
        assert fill > 0.95


def test_audit_sees_faults(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six seven"), (3, None)], "doc_id long, text string")
    packs = spark.createDataFrame([("p", 4)], "pack_name string, capacity_tokens int")
    packed, counts = pack(docs, packs), token_counts(docs)
    assert [tuple(r) for r in audit(packed, packs, counts).collect()] == [("p", 2, 0, 0)]
    rows = [tuple(r) for r in packed.collect()]
    twice = spark.createDataFrame(rows + [r for r in rows if r[5] == 4], packed.schema)  # a full container's piece again
    assert [tuple(r)[2:] for r in audit(twice, packs, counts).collect()] == [(1, 1)]
