"""Whole texts into containers of fixed capacity.

Dynamic programming over the histogram of all sizes chooses length buckets
that waste the least; token-budget batches form inside each bucket, each as
large as the room it goes into allows. Buckets come longest first: a batch
goes into the tightest room that longer buckets left over, and only what finds
none opens new containers. The plan knows counts only, so its size depends on
the number of buckets, not on the data; every text finds its container from
its rank inside its bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.tokens import token_counts
from siftstone.operators.ranking import grouped_position, slices_for
from siftstone.operators.scratch import written

BUCKETS = 160


def length_buckets(sizes: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper ends of at most ``most`` buckets with the least total padding, sum of count*(upper end - size).

    ``sizes`` ascends and is distinct. The cost of a bucket from i to j is linear
    in the size at j, so each layer of the dynamic programme takes the lower
    envelope of lines, queried at rising sizes: layers x sizes steps.
    """
    n = len(sizes)
    if n <= most:
        return np.asarray(sizes, dtype=np.int64)
    size = [int(s) for s in sizes]
    before = np.concatenate([[0], np.cumsum(counts)]).tolist()
    mass = np.concatenate([[0], np.cumsum(counts * sizes)]).tolist()
    best = [0.0] + [float("inf")] * n
    choices = np.zeros((most, n + 1), dtype=np.int32)
    for layer in range(most):
        now = [float("inf")] * (n + 1)
        slopes: list[int] = []
        rests: list[float] = []
        origins: list[int] = []
        head = 0
        row = choices[layer]
        for j in range(1, n + 1):
            i = j - 1
            if best[i] < float("inf"):
                slope, rest = -before[i], best[i] + mass[i]
                while len(slopes) - head >= 2 and (rest - rests[-2]) * (slopes[-2] - slopes[-1]) <= (rests[-1] - rests[-2]) * (slopes[-2] - slope):
                    slopes.pop(), rests.pop(), origins.pop()
                slopes.append(slope), rests.append(rest), origins.append(i)
            x = size[j - 1]
            while len(slopes) - head >= 2 and slopes[head + 1] * x + rests[head + 1] <= slopes[head] * x + rests[head]:
                head += 1
            if len(slopes) > head:
                now[j] = slopes[head] * x + rests[head] + x * before[j] - mass[j]
                row[j] = origins[head]
        best = now
    ends, j = [], n
    for layer in range(most - 1, -1, -1):
        ends.append(size[j - 1])
        j = int(choices[layer][j])
        if j == 0:
            break
    return np.array(ends[::-1], dtype=np.int64)


def batch_plan(ends: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(rows of bucket, first rank, ranks, first container, batch size; number of containers).

    Ranks first..first+ranks-1 of the bucket go to containers from first
    container on, batch size by batch size. A room is a run of containers with
    the same space left.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # space left -> (first container, containers)
    rows: list[tuple[int, int, int, int, int]] = []
    used = 0

    def put(space: int, start: int, n: int) -> None:
        if n and space:
            rooms.setdefault(space, []).append((start, n))

    for bucket in range(len(ends) - 1, -1, -1):
        size, left, rank = int(ends[bucket]), int(counts[bucket]), 0
        for space in sorted(s for s in rooms if s >= size):
            if not left:
                break
            per = space // size
            for start, n in rooms.pop(space):
                full = min(n, left // per)
                if full:
                    rows.append((bucket, rank, full * per, start, per))
                    put(space - per * size, start, full)
                    rank, left, start, n = rank + full * per, left - full * per, start + full, n - full
                if n and left:  # fewer than a batch: the last few share one room
                    rows.append((bucket, rank, left, start, per))
                    put(space - left * size, start, 1)
                    rank, left, start, n = rank + left, 0, start + 1, n - 1
                put(space, start, n)
        if left:
            per = capacity // size
            full = left // per
            if full:
                rows.append((bucket, rank, full * per, used, per))
                put(capacity - per * size, used, full)
                rank, left, used = rank + full * per, left - full * per, used + full
            if left:
                rows.append((bucket, rank, left, used, per))
                put(capacity - left * size, used, 1)
                used += 1
    return np.array(rows, dtype=np.int64).reshape(-1, 5), used


def pack(docs: DataFrame, sizes: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(pack_name, container, doc_id, piece, start_token, n_tokens): where each text, or each piece of a text above the capacity, lies.

    A text of more tokens than the capacity is cut into full pieces, each a
    container of its own, and a rest that is packed like a text. Null texts and
    texts without tokens lie nowhere. Repeated rows are packed one by one. A
    container is named by pack_name and number. Capacities must be positive and
    pack names unique; ``sizes`` is a small table of settings, read on the driver,
    and so is the histogram, which has at most the largest capacity's number of
    rows for each pack.
    """
    packs = [(r["pack_name"], r["capacity_tokens"]) for r in sizes.dropna().orderBy("pack_name").limit(1001).collect()]
    if len(packs) > 1000 or any(c < 1 for _, c in packs):
        raise ValueError("at most 1000 packs, each of a positive capacity")
    spark = docs.sparkSession
    out_schema = "pack_name string, container bigint, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint"
    if not packs:
        return spark.createDataFrame([], out_schema)
    counted = written(token_counts(docs, id_col, text_col, path).where("n_tokens > 0"), "token-counts")
    names = F.array(*(F.struct(F.lit(k).alias("pack"), F.lit(c).cast("bigint").alias("capacity")) for k, (_, c) in enumerate(packs)))
    pieces = (
        counted.withColumn("p", F.explode(names)).select("doc_id", "n_tokens", "p.pack", "p.capacity")
        .withColumn("whole", F.when(F.col("n_tokens") > F.col("capacity"), F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    )
    ends: list[np.ndarray] = []
    plans: list[np.ndarray] = []
    opened: list[int] = []
    largest = 0
    histogram = pieces.where("rest > 0").groupBy("pack", "rest").agg(F.count(F.lit(1)).alias("n")).toPandas()
    for k, (_, capacity) in enumerate(packs):
        mine = histogram[histogram["pack"] == k].sort_values("rest")
        values, counts = mine["rest"].to_numpy(np.int64), mine["n"].to_numpy(np.int64)
        upper = length_buckets(values, counts, buckets)
        per_bucket = np.bincount(np.searchsorted(upper, values), weights=counts, minlength=len(upper)).astype(np.int64)
        plan, used = batch_plan(upper, per_bucket, capacity)
        largest = max(largest, int(per_bucket.max(initial=0)))
        ends.append(upper), plans.append(plan), opened.append(used)

    @F.pandas_udf("int")
    def bucket_of(pack: pd.Series, rest: pd.Series) -> pd.Series:
        out = np.zeros(len(pack), dtype=np.int32)
        for k, upper in enumerate(ends):
            at = (pack == k).to_numpy()
            out[at] = np.searchsorted(upper, rest.to_numpy()[at])
        return pd.Series(out)

    @F.pandas_udf("bigint")
    def container_of(pack: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(pack), dtype=np.int64)
        for k, plan in enumerate(plans):
            at = np.flatnonzero((pack == k).to_numpy())
            if not len(at):
                continue
            base = int(plan[:, 1].max() + plan[:, 2].max() + 1)
            key = bucket.to_numpy()[at].astype(np.int64) * base + rank.to_numpy()[at]
            starts = plan[:, 0] * base + plan[:, 1]
            order = np.argsort(starts)
            row = plan[order[np.searchsorted(starts[order], key, side="right") - 1]]
            out[at] = row[:, 3] + (rank.to_numpy()[at] - row[:, 1]) // row[:, 4]
        return pd.Series(out)

    name = F.element_at(F.array(*(F.lit(n) for n, _ in packs)), F.col("pack") + 1).alias("pack_name")
    first_whole = F.element_at(F.array(*(F.lit(u).cast("bigint") for u in opened)), F.col("pack") + 1)
    order = F.xxhash64("doc_id", "n_tokens")
    rests = pieces.where("rest > 0").withColumn("bucket", bucket_of("pack", "rest"))
    ranked = grouped_position(rests, ["pack", "bucket"], order, F.lit(1), slices_for(largest))
    packed = ranked.select(name, container_of("pack", "bucket", "position").alias("container"), "doc_id", F.col("whole").alias("piece"), (F.col("whole") * F.col("capacity")).alias("start_token"), F.col("rest").alias("n_tokens"))
    long = pieces.where("whole > 0")
    most = long.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    cut = grouped_position(long, ["pack"], order, F.col("whole"), slices_for(most))
    full = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)))
    fulls = full.select(name, (first_whole + F.col("before") + F.col("piece")).alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    return packed.unionByName(fulls)


def fills(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pack_name, container, n_pieces, used_tokens, capacity_tokens, fill) of each container."""
    used = packed.groupBy("pack_name", "container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"))
    return used.join(sizes.dropna(), "pack_name").select("pack_name", "container", "n_pieces", "used_tokens", "capacity_tokens", (F.col("used_tokens") / F.col("capacity_tokens")).alias("fill"))


def audit(packed: DataFrame, sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """(pack_name, n_docs, n_over, n_wrong) of each pack: documents placed, containers above their capacity, and documents
    placed wrongly against ``counts`` (doc_id, n_tokens): not whole, not once, or cut without need. Ids must be unique."""
    sizes = sizes.dropna()
    full = packed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used")).join(sizes, "pack_name")
    over = full.groupBy("pack_name").agg(F.sum((F.col("used") > F.col("capacity_tokens")).cast("bigint")).alias("n_over"))
    ends = F.max(F.col("start_token") + F.col("n_tokens"))
    parts = packed.groupBy("pack_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.countDistinct("start_token").alias("starts"), F.sum("n_tokens").alias("placed"), ends.alias("end"))
    both = counts.where("n_tokens > 0").join(parts.hint("merge"), "doc_id", "left").join(sizes, "pack_name", "left")
    right = (F.col("placed") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")) & (F.col("pieces") == F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
    each = both.groupBy("pack_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((~F.coalesce(right, F.lit(False))).cast("bigint")).alias("n_wrong"))
    return each.join(over, "pack_name").select("pack_name", "n_docs", "n_over", "n_wrong")
