"""Vectors of texts and their fusion with tag vectors, keyed by what they were made from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import signature
from weftline.functions.vectors import fused, mean_vectors, same_size
from weftline.runtime import ship

Encoder = Callable[[list[str]], np.ndarray]
BATCH = 64


def hash_encoder(texts: list[str], dim: int = 8) -> np.ndarray:
    """A stand-in without a model: the sum of the code points modulo 1000, plus the position."""
    return np.array([[sum(map(ord, x)) % 1000 + i for i in range(dim)] for x in texts], np.float32).reshape(len(texts), dim)


def encoded(rows: DataFrame, key: str, text: str, model: str, load: Callable[[], Encoder] = lambda: hash_encoder, batch: int = BATCH) -> DataFrame:
    """(key, text_sha, model, vec) of every row with a text; ``load`` runs once in each task, the encoder on batches."""
    ship(rows.sparkSession)
    src = rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), signature(F.col(text)).alias("text_sha"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for b in batches:
            vecs = [v for i in range(0, len(b), batch) for v in encode(b["text"].iloc[i : i + batch].tolist()).astype(np.float32)]
            yield pd.DataFrame({"key": b["key"], "text_sha": b["text_sha"], "model": model, "vec": vecs})

    return src.mapInPandas(run, "key string, text_sha string, model string, vec array<float>")


def queue(rows: DataFrame, vectors: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """Rows that need a vector: they have a text, and none made from that text by that model is stored.

    ``vectors`` is (key, text_sha, model, ...). A change of text or model needs no clearing: its key no longer matches.
    """
    want = rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).withColumn("__sha", signature(F.col(text)))
    have = vectors.filter(F.col("model") == model).select(F.col("key").alias("__k"), F.col("text_sha").alias("__s"))
    return want.join(have, (F.col(key).cast("string") == F.col("__k")) & (F.col("__sha") == F.col("__s")), "left_anti").drop("__sha")


def fuse(text_vecs: DataFrame, card_tags: DataFrame, tag_vecs: DataFrame, alpha: float) -> DataFrame:
    """(card_id, vec): text vectors (card_id, vec) fused with the mean of the vectors (slug, vec) of their tags.

    Tags without a vector do not count; a card without any such tag keeps its unit text vector. Vectors of different
    sizes are an error that names the card.
    """
    tag = mean_vectors(card_tags.join(tag_vecs, "slug"), ["card_id"], "vec", "tag_mean")
    both = text_vecs.join(tag, "card_id", "left")
    checked = same_size(F.col("vec").cast("array<double>"), F.col("tag_mean"), F.col("card_id"))
    return both.select("card_id", fused(checked, F.col("tag_mean"), alpha).alias("vec"))
