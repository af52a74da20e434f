"""Aggregations and look-ups that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than this share of all rows; so at most 1/share keys are heavy, whatever the input's size.
HEAVY_SHARE = 0.001


#: Keys that the sketch of frequent keys tracks; its counts are off by at most 1/(0.75*SKETCH_KEYS) of the rows, and it names all keys above twice that.
SKETCH_KEYS = 8192


def heavy_keys(rows: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows, with ``key_rows`` and ``all_rows``.

    Two passes over the key columns, no shuffle of keys. The first adds up
    mergeable sketches of frequent key hashes, one a task, and the row count;
    every key above the share is among the hashes they track, for the share
    exceeds what the sketch may miss. The second counts the rows of those
    hashes' keys exactly, map-side, so the result is exact. It has fewer than
    1/share rows, which is what allows it to be broadcast.
    """
    if share * 0.75 * SKETCH_KEYS <= 2:
        raise ValueError(f"share must exceed {2 / (0.75 * SKETCH_KEYS):.2g}")
    name = F.xxhash64(*keys)
    seen = rows.select(name.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {SKETCH_KEYS}, {SKETCH_KEYS})").alias("top"))
    found = seen.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.lit(share) * F.col("n") / 2)
    few = found.select(F.col("t.item").alias("__h"), F.col("n").alias("all_rows"))
    counts = rows.select(*keys, name.alias("__h")).join(F.broadcast(few), "__h").groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"), F.max("all_rows").alias("all_rows"))
    return counts.where(F.col("key_rows") > F.lit(share) * F.col("all_rows"))


def counted_heavy(counts: DataFrame, keys: list[str], n: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Of keys with their row counts ``n``, those above ``share`` of the sum of all counts: fewer than 1/share."""
    total = counts.agg(F.sum(n).alias("n")).scalar()
    return counts.where(F.col(n) > F.lit(share) * total).select(*keys)


def salted_key_stats(rows: DataFrame, keys: list[str], value: str, heavy_share: float = HEAVY_SHARE, salt_rows_share: float = 0.0005, max_salts: int = 4096) -> DataFrame:
    """Per key: ``n_rows``, ``min_value``, ``n_distinct`` of ``value`` (null values count as rows only).

    Two stages. Rows of heavy keys get a salt, so that a key's rows spread over
    as many groups as it has shares of ``salt_rows_share``; each group gives its
    partial result, and the partials, a few a key, merge by the original key.
    The salt is a hash of the value: repeated values meet in one group, so the
    groups' distinct counts add up, and a repeated task gives the same rows.
    Light keys have the one salt 0. Rows with a null key form the key null.

    The distinct values of each (key, salt) are made before they are counted, so
    repeats vanish map-side and no task holds a set.
    """
    lone = "__salt"
    hot = heavy_keys(rows.select(*keys), keys, heavy_share).select(
        *(F.col(k).alias(f"__hot_{k}") for k in keys),
        F.least(F.ceil(F.col("key_rows") / (F.lit(salt_rows_share) * F.col("all_rows"))), F.lit(max_salts)).cast("int").alias("__salts"),
    )
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__hot_{k}"))
    salted = (
        rows.select(*keys, F.col(value).alias("__value"))
        .join(F.broadcast(hot), on, "left")
        .withColumn(lone, F.coalesce(F.pmod(F.xxhash64("__value"), F.col("__salts")), F.lit(0)).cast("int"))
    )
    once = salted.groupBy(*keys, lone, "__value").agg(F.count(F.lit(1)).alias("__n"))
    partial = once.groupBy(*keys, lone).agg(F.sum("__n").alias("__n"), F.min("__value").alias("__m"), F.count("__value").alias("__d"))
    return partial.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), F.min("__m").alias("min_value"), F.sum("__d").alias("n_distinct"))


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], heavy_share: float = HEAVY_SHARE, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``table`` (unique in ``keys``) though a key may hold any share of the rows.

    Rows of heavy keys meet a broadcast of just those keys' table rows (fewer
    than 1/heavy_share); all others take an ordinary shuffled join. No row is
    dropped, and no hot key is ever shuffled. A null key finds nothing. A caller
    that has the keys' counts already passes the heavy ones as ``hot``, made by
    ``counted_heavy``, and saves the count.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if hot is None:
        hot = heavy_keys(rows.select(*keys).dropna(), keys, heavy_share).select(*keys)
    hot_table = table.join(F.broadcast(hot), keys, "left_semi")
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    return (
        marked.where(F.col("__hot")).drop("__hot").join(F.broadcast(hot_table), keys, how)
        .unionByName(marked.where(F.col("__hot").isNull()).drop("__hot").join(table, keys, how))
    )
