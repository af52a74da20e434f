"""Token counts of a public byte-pair tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.layout import spread

#: A ranks file in tiktoken's format, where neither a path is given nor SETTING names one. The driver reads it; its bytes (under
#: 1 MB) travel with the tasks, so executors need no such file.
SETTING = "spark.siftstone.vocabulary"
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def vocabulary(path: str | None = None, spark: SparkSession | None = None) -> bytes:
    """Bytes of the ranks file at ``path``, else at the one that the session's settings name, else at the default place."""
    named = spark.conf.get(SETTING, None) if spark is not None else None
    with open(path or named or VOCABULARY, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row, null for a null text; one Arrow pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path, docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(shared.value)
        for batch in batches:
            counts = [None if t is None else len(bpe.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def token_features(bpe: tiktoken.Encoding, text: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(token count, feature numbers, how often): token ids folded into ``width`` bins."""
    tokens = np.asarray(bpe.encode_ordinary(text), dtype=np.int64)
    bins, counts = np.unique(tokens % width, return_counts=True)
    return len(tokens), bins.astype(np.int32), counts.astype(np.int32)
