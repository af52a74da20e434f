"""Near-duplicate removal: texts to signatures to bands to links to components to an anti join."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.bands import explode_bands
from siftstone.functions.minhash import signature
from siftstone.functions.text import normalized
from siftstone.operators.components import connected_components
from siftstone.operators.edges import star_edges
from siftstone.operators.layout import spread
from siftstone.operators.ranking import sequential_ids
from siftstone.operators.scratch import written
from siftstone.params import PLAIN, STRIPPED, DedupParams
from siftstone.sources.tables import input_stamp, is_unique, stored_or_computed


@dataclass(frozen=True)
class DedupResult:
    kept: DataFrame
    removed: DataFrame  # (doc_id)
    clusters: DataFrame  # (doc_id, root), linked documents only
    links: DataFrame  # (src, dst)


def with_signatures(docs: DataFrame, text_col: str, params: DedupParams) -> DataFrame:
    """All columns and ``minhash``."""
    text = normalized(F.col(text_col), params.lowercase, params.strip_punctuation, params.ignore_pattern)
    return docs.withColumn("minhash", signature(text, params))


def document_bands(docs: DataFrame, id_col: str, text_col: str, params: DedupParams, raw: bool = False) -> DataFrame:
    """(doc_id, band_id, band_hash); the scan reads the two columns only."""
    ident = F.col(id_col).cast("string") if params.id_order == "string" else F.col(id_col)
    signed = with_signatures(spread(docs.select(ident.alias("doc_id"), F.col(text_col).alias("text"))), "text", params)
    return explode_bands(signed.select("doc_id", "minhash"), "doc_id", "minhash", params.bands, params.rows, raw)


def duplicate_links(bands: DataFrame) -> DataFrame:
    key = "band_key" if "band_key" in bands.columns else "band_hash"
    return star_edges(bands, ("band_id", key))


def removed_ids(clusters: DataFrame) -> DataFrame:
    return clusters.where("node <> root").select(F.col("node").alias("doc_id"))


def drop_ids(docs: DataFrame, id_col: str, ids: DataFrame, id_order: str = "native") -> DataFrame:
    """Left anti join; all columns stay, rows with a null id stay. AQE broadcasts the ids only below its size limit."""
    gone = ids.select(F.col("doc_id").alias("__gone"))
    mine = F.col(id_col).cast("string") if id_order == "string" else F.col(id_col)
    return docs.join(gone, mine == F.col("__gone"), "left_anti")


def _bands(docs: DataFrame, id_col: str, text_col: str, params: DedupParams, bands_path: str | None, raw: bool) -> DataFrame:
    """Bands from or into a checkpoint, else a scratch table."""
    made = partial(document_bands, docs, id_col, text_col, params, raw)
    if not bands_path:
        return written(made(), "bands")
    stamp = {"columns": [id_col, text_col], "raw": raw, "params": {k: v for k, v in asdict(params).items() if k not in ("threshold", "max_iterations", "task_edges")}}
    return stored_or_computed(docs.sparkSession, bands_path, made, stamp | input_stamp(docs, id_col))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: DedupParams = PLAIN, bands_path: str | None = None, raw: bool = False) -> DedupResult:
    """One document of each group of near-duplicates, the least by id, with all its columns.

    Documents whose text is null are kept and never linked; with short_docs
    "merge" all texts below ``ngram`` tokens count as one group. An empty table
    gives an empty result. Columns may have any name: work columns are made from
    projections of id and text. ``bands_path`` keeps the bands for later runs on
    the same input with the same parameters; anything else found there is an error.
    """
    links = written(duplicate_links(_bands(docs, id_col, text_col, params, bands_path, raw)), "links")
    clusters = written(connected_components(links, max_iterations=params.max_iterations, task_edges=params.task_edges), "clusters")
    gone = removed_ids(clusters)
    return DedupResult(drop_ids(docs, id_col, gone, params.id_order), gone, clusters.withColumnRenamed("node", "doc_id"), links)


def deduplicate_stripped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: DedupParams = STRIPPED, bands_path: str | None = None) -> DedupResult:
    """The same over raw band keys; ``kept`` has (id, text). Groups keep the document that comes first in id order, and ids need not be unique.

    Unique ids are their own order, so nothing is numbered and no text moves but
    in the scans. Where ids repeat or are null, rows are numbered in id order
    (nulls first) and the numbers are dropped at the end; ``removed`` then names
    each removed row's id once a row, ``links`` and ``clusters`` the rows' ids.
    """
    mine = docs.select(id_col, text_col)
    if is_unique(mine, id_col):
        return deduplicate(mine, id_col, text_col, params, bands_path, raw=True)
    if bands_path:
        raise ValueError("bands can only be kept for unique ids")
    numbered = sequential_ids(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__uid")
    found = deduplicate(numbered, "__uid", "__text", params.with_(id_order="native"), raw=True)
    names = numbered.select("__uid", "__id")

    def named(frame: DataFrame, **columns: str) -> DataFrame:
        for k, (old, new) in enumerate(columns.items()):
            frame = frame.join(names.select(F.col("__uid").alias(old), F.col("__id").alias(f"__n{k}")), old, "left")
        return frame.select(*(F.col(f"__n{k}").alias(new) for k, new in enumerate(columns.values())))

    return DedupResult(
        found.kept.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col)), named(found.removed, doc_id="doc_id"),
        named(found.clusters, doc_id="doc_id", root="root"), named(found.links, src="src", dst="dst"),
    )
