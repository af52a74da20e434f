"""Links between rows that share a band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.operators.scratch import written
from siftstone.operators.skew import counted_heavy, lookup


def keyed_minimum(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key the least value and the row count; keys with one row are left out. Partial aggregation keeps hot keys cheap."""
    return rows.groupBy(*keys).agg(F.min(value).alias("rep"), F.count(F.lit(1)).alias("members")).where("members > 1")


def star_edges(bands: DataFrame, keys: tuple[str, ...] = ("band_id", "band_hash"), value: str = "doc_id") -> DataFrame:
    """(src, dst): each member of a key linked to the key's least member, repeated links once.

    n-1 links a key instead of all pairs. Only keys with two rows or more are
    looked up; they are written once, with their minimum and count, and serve
    the total, the list of hot keys and both look-ups. Rows of hot keys meet
    their minimum without a shuffle. Null keys or ids link nothing.
    """
    clean = bands.dropna(subset=[*keys, value]).select(*keys, value)
    reps = written(keyed_minimum(clean, list(keys), value), "keys")
    hot = counted_heavy(reps, list(keys), "members")
    return lookup(clean, reps.drop("members"), list(keys), hot=hot).where(F.col(value) > F.col("rep")).select(F.col("rep").alias("src"), F.col(value).alias("dst")).distinct()


def distinct_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    return df.select(first, second).distinct()
