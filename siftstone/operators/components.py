"""Connected components by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.unionfind import union_find
from siftstone.operators.scratch import release, written

#: Edges that one task may finish by itself; more are contracted in distributed rounds until no more are left.
TASK_EDGES = 1_000_000


class NotConverged(RuntimeError):
    pass


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("node").alias("u"), F.col("parent").alias("v")), F.struct(F.col("parent").alias("u"), F.col("node").alias("v")))).alias("e")).select("e.u", "e.v")


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of the node and its neighbours."""
    linked = _both_ways(edges).distinct()
    least = linked.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return linked.where("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("parent")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not above a node, and the node, are linked to the least of them; the least one's row to itself stays."""
    down = edges.select(F.greatest("node", "parent").alias("u"), F.least("node", "parent").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("parent"))
    return moved.union(least.select(F.col("u").alias("node"), F.col("m").alias("parent"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "parent").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns) for batch in batches]
        if held:
            kind = None if held[0][0].dtype != object else pa.string()
            node, root = union_find(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(root, kind)], ["node", "parent"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_iterations: int = 100, strict: bool = True, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, root): one row for each node of an edge, root being the least node of its component.

    Edges with a null end are ignored; self-loops only make their node
    appear. Rounds repeat until the edge set stands still (row count and
    checksum), or until at most ``task_edges`` edges are left, which one task
    finishes by union-find; at ``max_iterations`` the call raises, or returns
    what it has with strict=False. Each round reads the last one's written
    table, so a lost executor costs at most one round. Ids are integers or
    strings.
    """
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("parent")).dropna()
    base = written(pairs.distinct(), "edges")
    nodes = _both_ways(base).select(F.col("u").alias("node")).distinct()
    now = base.where("node <> parent")
    mark = _fingerprint(now)
    for _ in range(max_iterations):
        if not mark[0]:
            break
        if mark[0] <= task_edges:
            now = _in_one_task(now)
            break
        after = written(small_star(large_star(now)).where("node <> parent"), "star")
        release(now)
        now, last, mark = after, mark, _fingerprint(after)
        if mark == last:
            break
    else:
        if strict:
            raise NotConverged(f"no fixpoint after {max_iterations} rounds")
    roots = now.groupBy("node").agg(F.min("parent").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
