"""One group identifier for all records linked directly or in chains.

Union-find runs inside each partition of the links and leaves a spanning
forest; forests merge level by level through partitions of bounded size. Between
levels a shuffle brings the rows of a record together: a record that several
forests put under different roots links those roots, and a record that is no
root anywhere is put aside with a pointer to its least root. So a level holds
only roots, and no level needs a task that holds a whole component. Pointers
are resolved from the top level down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.unionfind import union_find
from siftstone.functions.windows import mixed, unmixed
from siftstone.operators.components import NotConverged
from siftstone.operators.scratch import release, written
from siftstone.operators.skew import counted_heavy, lookup

#: Links that one task of a merging level may hold: some 200 MB of arrays while it works.
PARTITION_LINKS = 2_000_000
#: Each level takes away a constant share of the records on average, so this is never reached; if it is, the call raises.
MAX_LEVELS = 100


def _forests(most: int, mix: bool = False):
    """Each partition's links, read in batches, become spanning forests of at most about ``most`` links; with ``mix`` ids are mixed first.

    What is held is reduced whenever it passes the bound; a forest that is still
    larger is given out and a new one begun. So memory is bounded whatever the
    partition's size, and records that end up in two forests are treated like
    those of two partitions.
    """

    def reduced(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return union_find(*(np.concatenate(c) for c in zip(*held)))

    def out(forest: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(forest[0], pa.int64()), pa.array(forest[1], pa.int64())], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            ends = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append(tuple(mixed(x.view(np.uint64)).view(np.int64) for x in ends) if mix else ends)
            size += batch.num_rows
            if size > most:
                held = [reduced(held)]
                size = len(held[0][0])
                if size > most // 2:
                    yield out(held[0])
                    held, size = [], 0
        if held:
            yield out(reduced(held))

    return run


def components(links: DataFrame, a: str = "a", b: str = "b", partition_links: int = PARTITION_LINKS, levels: list[int] | None = None) -> DataFrame:
    """(component, node): one row for each record that occurs in a link with both ends present.

    ``component`` is the least record of the group; that record has a row too.
    Ids are bigints. Links with a null end are left out, a link of a record with
    itself makes the record appear, repeated and reversed links change nothing,
    an empty table gives none. Other columns are ignored. ``levels``, a list, is
    given the number of links of each level.

    Inside, ids are mixed by a one-to-one function, so roots are least in a random
    order: whatever the graph and the numbering, each level takes away a constant
    share of its records on average (a third of a long path). The last level fits one
    partition and leaves nothing. The least id of each group is found at the end
    by partial minima.
    """
    ends = links.select(F.col(a).cast("bigint").alias("node"), F.col(b).cast("bigint").alias("root")).dropna()
    alone = ends.where("node = root").select("node").distinct()
    now, parts = ends.where("node <> root"), 0
    pointers: list[DataFrame] = []
    for _ in range(MAX_LEVELS):
        source = now.coalesce(parts) if parts else now
        forest = written(source.mapInArrow(_forests(partition_links, mix=not parts), "node bigint, root bigint"), "forest")
        if parts == 1:  # one forest: every record has one root, and no root is under another
            pointers.append(forest)
            break
        by_node = Window.partitionBy("node")
        ranked = written(forest.select("node", "root", F.min("root").over(by_node).alias("least"), F.row_number().over(by_node.orderBy("root")).alias("k")), "ranked")
        roots = forest.select(F.col("root").alias("node")).distinct().withColumn("higher", F.lit(True))
        marked = written(ranked.where("k = 1").select("node", F.col("least").alias("root")).join(roots, "node", "left"), "marked")
        pointers.append(marked.where("higher IS NULL").select("node", "root"))
        between = ranked.where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        after = written(between.unionByName(marked.where("higher").select("node", "root")).distinct(), "shared")
        release(ranked), release(forest)
        if parts:
            release(now)
        now, left = after, after.count()
        if levels is not None:
            levels.append(left)
        if not left:
            break
        parts = -(-left // partition_links)
    else:
        raise NotConverged(f"links are left after {MAX_LEVELS} levels")
    labels: list[DataFrame] = []  # a table a level, from the top down; lower levels look up in all above
    for below in reversed(pointers):
        if labels:
            known = labels[0]
            for more in labels[1:]:
                known = known.unionByName(more)
            below = lookup(below, known.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", how="left").select("node", F.coalesce("higher", "root").alias("root"))
            below = written(below, "labels")
        labels.append(below)
    placed = labels[0]
    for more in labels[1:]:
        placed = placed.unionByName(more)

    @F.pandas_udf("bigint")
    def real(x: pd.Series) -> pd.Series:
        return pd.Series(unmixed(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    tops = placed.select("root").distinct().select(F.col("root").alias("node"), "root")
    every = written(placed.unionByName(tops).select(real("node").alias("node"), "root"), "members")
    least = written(every.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("__n")), "least")
    found = lookup(every, least.drop("__n"), "root", hot=counted_heavy(least, ["root"], "__n")).select("component", "node")
    lone = alone.join(every, "node", "left_anti").select(F.col("node").alias("component"), "node")
    return found.unionByName(lone)


def record_number(name: str) -> Column:
    """A record id written as a decimal number, with blanks around it and zeros in front; anything else is null."""
    return F.expr(f"try_cast(regexp_replace({name}, '^[\\\\s\\\\p{{Z}}]+|[\\\\s\\\\p{{Z}}]+$', '') AS bigint)")
