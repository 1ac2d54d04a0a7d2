"""Snapshots and signals as streams: merged by key in micro-batches, or kept once within a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.cards import DERIVED, OWNED, merge_status, merged
from weftline.runtime import newest
from weftline.sources.store import Store


def merge_stream(cards: DataFrame, store: Store, checkpoint: str, name: str = "cards", order: str = "updated_at", owned: list[str] = OWNED, derived: list[str] = DERIVED) -> StreamingQuery:
    """Each micro-batch of projected cards is merged into the stored table by difference, as a bulk file would be.

    Of a key's rows in a batch the latest counts. A batch that is run again after a failure finds its rows unchanged.
    """

    def one(batch: DataFrame, _: int) -> None:
        rows = newest(batch, ["_id"], order).drop(order)
        if not store.exists(name):
            store.replace(name, rows)
            return
        stored, absent = store.read(name), [c for c in owned if c in rows.columns and c not in store.read(name).columns]
        for c in absent:  # a stored table of an older shape: its rows are patched
            stored = stored.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        status = merge_status(rows, stored, "_id", "oracle_text_sha", F.lit(bool(absent)))
        store.replace(name, merged(stored, status, "_id", owned, derived))

    return cards.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def fresh(signals: DataFrame, keys: list[str], at: str, ttl: str = "7 days") -> DataFrame:
    """A stream of signals with each key at most once within ``ttl``; rows later than that are dropped."""
    return signals.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)
