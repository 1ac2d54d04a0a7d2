"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.runtime import newest

# What tells two states of a card with one time of delivery apart, whatever columns are asked for.
CARD_TIE = ["oracle_id", "name", "oracle_text_sha", "added_at", "removed_at"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the file's own schema, columns pruned and filters pushed by the optimizer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_cards(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(_id, *columns, updated_at): of each card the row that counts."""
    every = dict.fromkeys(["_id", *columns, "updated_at", *CARD_TIE])
    return newest(table(spark, sf_dir, "cards").select(*every), ["_id"], "updated_at", CARD_TIE).select("_id", *columns, "updated_at")
