"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # rank file of a byte-level BPE; a parameter everywhere
#: How such a tokenizer divides a text before merging bytes: fixed values.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SENT: dict[str, set[str]] = {}  # rank files given to the executors of each application


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The tokenizer of a rank file (base64 token, rank); one for each Python worker."""
    import base64

    import tiktoken

    # The rank file travels with the job; a worker without it reads the path itself.
    sent = SparkFiles.get(os.path.basename(vocabulary))
    with open(sent if os.path.exists(sent) else vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, key: str, text: str, keep: list[str] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id long, *keep, n_tokens long): every row with its whole text's tokens; null and empty texts have none."""
    ship(docs.sparkSession)
    if vocabulary not in _SENT.setdefault(docs.sparkSession.sparkContext.applicationId, set()):
        docs.sparkSession.sparkContext.addFile(vocabulary)
        _SENT[docs.sparkSession.sparkContext.applicationId].add(vocabulary)
    src = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(n, pa.int64())], names=[*(c for c in b.schema.names if c != "text"), "n_tokens"])

    kept = "".join(f", {c} {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"doc_id long{kept}, n_tokens long")
