"""Near-duplicates by MinHash banding, verified on whole n-gram sets.

Exact copies collapse first, so only distinct texts are signed and searched.
With r rows a band and b bands a pair of similarity s is found with chance
1-(1-s^r)^b; see ``plan_bands``. Minima come from few rounds over a text's
n-grams however many minima are wanted; see ``minima``. Candidates pass a sketch
of 64 bytes a text before any text is moved, and each that remains is decided by
the exact similarity of the two full n-gram sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftstone.functions.windows import code_points, mixed, window_hashes
from siftstone.llm.grouping import components
from siftstone.operators.layout import spread
from siftstone.operators.scratch import release, written
from siftstone.operators.skew import counted_heavy, heavy_keys, lookup

LEAST_CHARS, GRAM, THRESHOLD = 40, 5, 0.7
#: Wanted chance to find a pair just at the threshold, and rows a band in collections of up to ROWS_TEXTS texts.
RECALL, ROWS, ROWS_TEXTS = 0.995, 7, 500_000
#: Minima kept as single bytes in the sketch, and how far below the threshold (in standard errors) its estimate may lie.
SKETCH, SKETCH_ERRORS = 64, 4.0
#: Rows of one band key, or copies of one text, that meet in one go; larger groups are cut into blocks of half this size.
BLOCK = 4096
#: A band key above this share of all band rows is cut into blocks before any shuffle.
HOT_SHARE = 0.0005
#: Rounds in which n-grams fall into random places, and n-grams that share work arrays.
ROUNDS, GROUP = 32, 150_000


def plan_bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Least number of bands with which a pair at the threshold is found with chance ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def plan_rows(texts: int) -> int:
    """Rows a band for a collection of this size.

    Chance candidates grow with the square of the collection; one more row for
    each tenfold size divides them by three or more at the same recall, as the
    number of bands follows the rows.
    """
    return ROWS + max(0, int(np.ceil(np.log10(max(texts, 1) / ROWS_TEXTS))))


def gram_hashes(text: str, n: int = GRAM) -> np.ndarray:
    """Distinct 64-bit hashes of the code-point n-grams of the lower-cased text, ascending."""
    hashes = np.sort(window_hashes(code_points(text.lower()), n))
    first = np.ones(len(hashes), dtype=bool)
    np.not_equal(hashes[1:], hashes[:-1], out=first[1:])
    return hashes[first]


@lru_cache(maxsize=4)
def round_factors(count: int, seed: int) -> np.ndarray:
    """One odd factor a round or place."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def _thrown(hashes: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The hashes, mixed anew for a round: the upper half says where an n-gram falls, the lower half is its value."""
    h = hashes * factor
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def minima(parts: list[np.ndarray], places: int, seed: int = 1) -> np.ndarray:
    """One row of ``places`` uint32 minima for each set of hashes; two sets agree in a place with chance equal to their similarity.

    In each round every n-gram of a text falls into one place. A place takes the
    least value of the first round that reaches it; what no round has reached
    after ROUNDS takes the least value of all n-grams under a factor of its own.
    So a place's value is the least of all n-grams in one fixed order, as in
    plain MinHash, but a text of n n-grams costs about n + places*ln(places)
    steps instead of n*places. Sets must not be empty. Texts share the arrays of
    a round; those whose places are all taken leave it.
    """
    factors = round_factors(ROUNDS + places, seed)
    low = np.full(len(parts) * places, 0xFFFFFFFF, dtype=np.uint32)
    taken = np.zeros(len(low), dtype=bool)
    live = np.arange(len(parts))
    sizes = np.array([len(x) for x in parts])
    hashes, owner = np.concatenate(parts), np.repeat(live, sizes)
    for k in range(ROUNDS):
        reached = taken.copy() if len(hashes) > GROUP else taken
        for at in range(0, len(hashes), GROUP):
            h = _thrown(hashes[at : at + GROUP], factors[k])
            place = owner[at : at + GROUP] * places + (((h >> np.uint64(32)) * np.uint64(places)) >> np.uint64(32)).astype(np.int64)
            if k:
                free = ~taken[place]
                h, place = h[free], place[free]
            np.minimum.at(low, place, h.astype(np.uint32))
            reached[place] = True
        taken = reached
        full = taken.reshape(len(parts), places).all(axis=1)
        if full[live].any():
            live = live[~full[live]]
            if not len(live):
                break
            keep = ~full[owner]
            hashes, owner = hashes[keep], owner[keep]
    for t in live:  # few n-grams, or few places left: their product is small
        left = np.flatnonzero(~taken[t * places : (t + 1) * places])
        low[t * places + left] = _thrown(parts[t][None, :], factors[ROUNDS + left][:, None]).astype(np.uint32).min(axis=1)
    return low.reshape(len(parts), places)


def signatures(docs: DataFrame, bands: int, rows: int = ROWS, n: int = GRAM, seed: int = 1) -> DataFrame:
    """(doc_id, grams, bands array<bigint>, sketch) from (doc_id, text); one Arrow pass, no shuffle. Texts have n code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        number = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        schema = pa.schema([("doc_id", pa.int64()), ("grams", pa.int32()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

        def signed(ids: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
            low = minima(parts, max(bands * rows, SKETCH), seed)
            used = low[:, : bands * rows].reshape(len(ids), bands, rows).astype(np.uint64)
            keys = mixed(((used * place).sum(axis=2) ^ number).ravel()).view(np.int64)
            sketches = (low[:, :SKETCH] & np.uint32(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, bands, dtype=np.int32)), pa.array(keys))
            columns = [pa.array(ids, pa.int64()), pa.array([len(x) for x in parts], pa.int32()), lists, pa.array([x.tobytes() for x in sketches], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            ids, parts, size = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), parts.append(gram_hashes(text, n))
                size += len(parts[-1])
                if size > GROUP:
                    yield signed(ids, parts)
                    ids, parts, size = [], [], 0
            if ids:
                yield signed(ids, parts)

    return docs.mapInArrow(run, "doc_id bigint, grams int, bands array<bigint>, sketch binary")


#: Pairs that are given out in one go; rows of groups that are compared together with other small groups.
FLUSH, FEW = 200_000, 48


def _within(ids: np.ndarray, sizes: np.ndarray, threshold: float, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one group whose sizes allow the threshold, a bounded number at a time: each row meets only the following rows
    in size order that are not too large, and with ``side`` only those of the other side."""
    order = np.lexsort((ids, sizes))
    ids, sizes = ids[order], sizes[order]
    side = None if side is None else side[order]
    counts = np.searchsorted(sizes, sizes / threshold, side="right") - np.arange(len(ids)) - 1
    upto = np.cumsum(counts)
    at = 0
    while at < len(ids):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + FLUSH, side="right")))
        some = counts[at:end]
        if total := int(some.sum()):
            left = np.repeat(np.arange(at, end), some)
            right = left + 1 + np.arange(total) - np.repeat(np.cumsum(some) - some, some)
            if side is not None:
                across = side[left] != side[right]
                left, right = left[across], right[across]
            yield ids[left], ids[right]
        at = end


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs, the smaller id first."""
    if found:
        x, y = (np.concatenate(c) for c in zip(*found))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _group_pairs(threshold: float):
    """Rows (key, doc_id, grams, part, side) sorted by key and part become pairs. side 0 and 1 are two different blocks of a large group, side -1 a group of its own."""

    def groups(key: np.ndarray, ids: np.ndarray, grams: np.ndarray, part: np.ndarray, side: np.ndarray):
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(key)]])
        few = (ends - starts <= FEW) & (side[starts] < 0)
        for s, e in zip(starts[~few], ends[~few]):
            yield from _within(ids[s:e], grams[s:e], threshold, None if side[s] < 0 else side[s:e])
        # small groups, all at once: each row meets the one after it, then the second after it, while the group lasts
        end_of = np.repeat(np.where(few, ends, 0), ends - starts)
        at, step = np.arange(len(key)), 1
        while len(at := at[at + step < end_of[at]]):
            x, y = grams[at], grams[at + step]
            fits = at[np.minimum(x, y) >= threshold * np.maximum(x, y)]
            for k in range(0, len(fits), FLUSH):
                yield ids[fits[k : k + FLUSH]], ids[fits[k : k + FLUSH] + step]
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def ready():
            """Whole groups, the last one when all batches are read."""
            nonlocal tail
            for batch in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if tail is not None:
                    cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
                if not len(cols[0]):
                    continue
                other = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[3] != cols[3][-1]))
                last = int(other[-1]) + 1 if len(other) else 0
                tail = [c[last:] for c in cols]
                if last:
                    yield [c[:last] for c in cols]
            if tail is not None:
                yield tail

        for cols in ready():
            for pair in groups(*cols):
                found.append(pair)
                size += len(pair[0])
                if size > FLUSH:
                    yield from _pair_batch(found)
                    found, size = [], 0
        yield from _pair_batch(found)

    return run


def _blocks(rows: DataFrame, n: str, block: int) -> DataFrame:
    """Rows (key, doc_id, grams, n) of large keys as (key, doc_id, grams, part, side): each row gets one of 2n/block block numbers
    by hash and goes once to every pair of blocks that its own belongs to."""
    cut = rows.withColumn("__k", F.ceil(F.col(n) * 2 / F.lit(block)).cast("bigint")).withColumn("__b", F.pmod(F.xxhash64("doc_id"), F.col("__k")))
    met = cut.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1)))
    part = F.least("__b", "__o") * F.col("__k") + F.greatest("__b", "__o")
    side = F.when(F.col("__b") == F.col("__o"), -1).when(F.col("__b") < F.col("__o"), 0).otherwise(1)
    return met.select("key", "doc_id", "grams", part.alias("part"), side.alias("side"))


def candidates(signed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, hot_share: float = HOT_SHARE) -> DataFrame:
    """(a, b): distinct pairs that share a band and whose set sizes allow the threshold.

    Keys above ``hot_share`` of all rows (at most 1/hot_share, found by sketches
    and counted exactly, no shuffle) are cut into blocks at once, so no hot key
    is ever shuffled to one task. All other rows take one shuffle by key, where a
    window counts each key's rows; keys with one row end there, keys of up to
    ``block`` rows are compared, larger ones are cut into blocks too. Each pair
    of blocks, about ``block`` rows, is compared by itself: no pair is lost, and
    a key of n rows is sent 2n/block times, a small part of the n*n/2 pairs it
    stands for.
    """
    rows = signed.select(F.explode("bands").alias("key"), "doc_id", "grams")
    names = ["key", "doc_id", "grams", "part", "side"]
    hot = written(heavy_keys(rows.select("key"), ["key"], hot_share).where(F.col("key_rows") > block).select("key", F.col("key_rows").alias("__n")), "hot-bands")
    counted = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("__n > 1")
    counted = written(counted, "shared-bands")
    alone = counted.where(F.col("__n") <= block).select("key", "doc_id", "grams", F.lit(0).cast("bigint").alias("part"), F.lit(-1).alias("side"))
    large = counted.where(F.col("__n") > block).unionByName(rows.join(F.broadcast(hot), "key"))
    both = alone.unionByName(_blocks(large, "__n", block)).repartition("key", "part").sortWithinPartitions("key", "part")
    return both.select(*names).mapInArrow(_group_pairs(threshold), "a bigint, b bigint").distinct()


def _sketched(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose sketches agree often enough."""
    least = SKETCH * max(0.0, threshold - SKETCH_ERRORS * float(np.sqrt(threshold * (1 - threshold) / SKETCH)))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        p = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), SKETCH)
        q = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), SKETCH)
        return pd.Series((p == q).sum(axis=1) >= least)

    one = signed.select(F.col("doc_id").alias("a"), F.col("sketch").alias("__x"))
    two = signed.select(F.col("doc_id").alias("b"), F.col("sketch").alias("__y"))
    return pairs.join(one, "a").join(two, "b").where(alike("__x", "__y")).select("a", "b")


def _similar(pairs: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """(a, b, similarity) of pairs whose n-gram sets reach the threshold; only texts of candidates move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, grams = None, None
        for batch in batches:
            a, b, sims = [], [], []
            for i, x, j, y in zip(*(c.to_pylist() for c in batch.columns)):
                if i != last:
                    last, grams = i, gram_hashes(x, n)
                other = gram_hashes(y, n)
                common = len(np.intersect1d(grams, other, assume_unique=True))
                union = len(grams) + len(other) - common
                if union and common / union >= threshold:
                    a.append(i), b.append(j), sims.append(common / union)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    mine = written(texts.join(wanted, "doc_id", "left_semi"), "candidate-texts")
    one = mine.select(F.col("doc_id").alias("a"), F.col("text").alias("__x"))
    two = mine.select(F.col("doc_id").alias("b"), F.col("text").alias("__y"))
    both = pairs.join(two, "b").join(one, "a").select("a", "__x", "b", "__y")
    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least_chars: int = LEAST_CHARS, n: int = GRAM, recall: float = RECALL, rows: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of distinct texts (a, b, similarity), each text named by its
    least doc_id; members (rep, doc_id) tells which documents have that very text.

    Null texts and those under ``least_chars`` code points take no part, nor do
    rows with a null id. Ids are bigints. A repeated row counts once; of several
    texts under one id the least counts. Other columns are not read. Both frames
    are read from written tables.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= least_chars))
    ids = written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("raw")), "ids")
    if ids.select("doc_id").distinct().count() < ids.count():
        texts = written(texts.groupBy("doc_id").agg(F.min("text").alias("text")), "one-text-an-id")
        ids = written(texts.select("doc_id", F.unhex(F.sha2("text", 256)).alias("raw")), "ids")
    first = ids.groupBy("raw").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = written(lookup(ids, first, "raw", hot=counted_heavy(first, ["raw"], "copies")).select("rep", "doc_id", "copies"), "members")
    copies = written(members.where("rep <> doc_id").select("doc_id"), "copies")  # a table of known size: few ids are broadcast and the texts stay where they are
    distinct = texts.join(copies, "doc_id", "left_anti")
    rows = rows or plan_rows(members.where("rep = doc_id").count())
    signed = written(signatures(spread(distinct), plan_bands(threshold, recall, rows), rows, n), "signatures")
    likely = written(_sketched(candidates(signed, threshold, block), signed.select("doc_id", "sketch"), threshold), "likely")
    pairs = written(_similar(likely, texts, threshold, n), "pairs")
    release(signed)
    return pairs, members


def _copy_pairs(members: DataFrame, block: int) -> DataFrame:
    """(x, y): all pairs of copies of one text. A text of many copies is cut into blocks, each pair of blocks joined by itself."""
    several = members.where("copies > 1").withColumn("__k", F.ceil(F.col("copies") * 2 / F.lit(block)).cast("bigint")).withColumn("__b", F.pmod(F.xxhash64("doc_id"), F.col("__k")))
    first = several.select("rep", F.col("doc_id").alias("x"), F.col("__b").alias("i"), F.explode(F.sequence("__b", F.col("__k") - 1)).alias("j"))
    second = several.select("rep", F.col("doc_id").alias("y"), F.col("__b").alias("j"), F.explode(F.sequence(F.lit(0).cast("bigint"), "__b")).alias("i"))
    return first.join(second, ["rep", "i", "j"]).where("i < j OR x < y").select("x", "y")


def _expanded(pairs: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(x, y): documents with the texts of each pair. A pair whose texts have many copies meets their blocks one by one."""
    blocked = members.withColumn("__k", F.ceil(F.col("copies") * 2 / F.lit(block)).cast("bigint")).withColumn("__b", F.pmod(F.xxhash64("doc_id"), F.col("__k")))
    counts = blocked.where("rep = doc_id").select("rep", "__k")
    numbers = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(k) - 1))
    wide = pairs.join(counts.select(F.col("rep").alias("a"), F.col("__k").alias("__ka")), "a").join(counts.select(F.col("rep").alias("b"), F.col("__k").alias("__kb")), "b")
    wide = wide.withColumn("__i", numbers("__ka")).withColumn("__j", numbers("__kb"))
    of_a = blocked.select(F.col("rep").alias("a"), F.col("__b").alias("__i"), F.col("doc_id").alias("x"))
    of_b = blocked.select(F.col("rep").alias("b"), F.col("__b").alias("__j"), F.col("doc_id").alias("y"))
    return wide.select("a", "b", "__i", "__j").join(of_a, ["a", "__i"]).join(of_b, ["b", "__j"]).select("x", "y")


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of documents that is similar enough, exact copies included."""
    pairs, members = similar_texts(docs, id_col, text_col, **how)
    block = how.get("block", BLOCK)
    both = _expanded(pairs, members, block).unionByName(_copy_pairs(members, block))
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, group_id, n_links) of every document that takes part.

    group_id is the least doc_id reachable over links, n_links the number of
    other documents similar enough. Copies are counted, never expanded to pairs.
    """
    pairs, members = similar_texts(docs, id_col, text_col, **how)
    sizes = members.where("rep = doc_id").select("rep", "copies")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("__l"))
    group = components(pairs.select("a", "b")).select(F.col("node").alias("rep"), F.col("component").alias("__g"))
    rep = sizes.join(links.withColumnRenamed("a", "rep"), "rep", "left").join(group, "rep", "left")
    per_text = rep.select("rep", F.coalesce("__g", "rep").alias("group_id"), (F.coalesce("__l", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return lookup(members.select("rep", "doc_id"), per_text, "rep", hot=counted_heavy(sizes, ["rep"], "copies")).select("doc_id", "group_id", "n_links")
