"""Reports on a de-duplication run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: n_input, n_removed, n_kept, removed_percent (0 for an empty input)."""
    counts = docs.agg(F.count(F.lit(1)).alias("n_input")).withColumn("n_removed", removed.agg(F.count(F.lit(1)).alias("n")).scalar())
    share = F.when(F.col("n_input") > 0, F.round(100.0 * F.col("n_removed") / F.col("n_input"), 4)).otherwise(F.lit(0.0))
    return counts.select("n_input", "n_removed", (F.col("n_input") - F.col("n_removed")).alias("n_kept"), share.alias("removed_percent"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """(cluster_size, n_clusters) over linked documents."""
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("cluster_size"))
    return sizes.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("n_clusters"))


def cluster_samples(clusters: DataFrame, id_col: str = "doc_id", n_clusters: int = 10, n_members: int = 5) -> DataFrame:
    """(root, doc_id): the n_members least members of each of the n_clusters least roots; a report, so it is limited."""
    roots = clusters.select("root").distinct().orderBy("root").limit(n_clusters)
    rank = F.row_number().over(Window.partitionBy("root").orderBy(id_col))
    return clusters.join(roots, "root", "left_semi").withColumn("__r", rank).where(F.col("__r") <= n_members).select("root", id_col)
