"""Near-duplicate removal for a stream of documents against a stored band index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftstone.operators.components import connected_components
from siftstone.operators.edges import star_edges
from siftstone.operators.scratch import written
from siftstone.params import PLAIN, DedupParams
from siftstone.plans.dedup import document_bands, drop_ids, removed_ids
from siftstone.sources.tables import path_exists


def accept_batch(batch: DataFrame, index_path: str, batch_id: int, id_col: str = "doc_id", text_col: str = "text", params: DedupParams = PLAIN) -> DataFrame:
    """Rows of the batch that are near no indexed document and no smaller document of the batch.

    The bands of the accepted rows are stored under ``batch=<id>`` of the index,
    over what an earlier try of the same batch left there; so a replayed batch
    gives the same rows. Bands of rows already indexed join by key only.
    """
    spark = batch.sparkSession
    bands = written(document_bands(batch, id_col, text_col, params), "batch-bands")
    known = spark.read.parquet(index_path).where(F.col("batch") < batch_id) if path_exists(spark, index_path) else None
    fresh = bands
    if known is not None:
        hit = bands.join(known.select("band_id", "band_hash"), ["band_id", "band_hash"], "left_semi").select("doc_id").distinct()
        fresh = bands.join(hit, "doc_id", "left_anti")
    inner = removed_ids(connected_components(star_edges(fresh)))
    accepted_bands = written(fresh.join(inner, "doc_id", "left_anti"), "accepted")
    accepted_bands.write.mode("overwrite").parquet(f"{index_path}/batch={batch_id}")
    rejected = bands.select("doc_id").distinct().join(accepted_bands.select("doc_id").distinct(), "doc_id", "left_anti")
    return drop_ids(batch, id_col, rejected)


def deduplicate_stream(stream: DataFrame, index_path: str, output_path: str, checkpoint_path: str, id_col: str = "doc_id", text_col: str = "text", params: DedupParams = PLAIN) -> StreamingQuery:
    """Starts a query that handles all data present and then ends; run it again for more."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        accept_batch(batch, index_path, batch_id, id_col, text_col, params).write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
