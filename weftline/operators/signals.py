"""Outer signals of cards for a commander: flattening, deduplication, freshness."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.vectors import rate

TTL_DAYS = 7


def flattened(payloads: DataFrame, key: str = "slug") -> DataFrame:
    """(commander, card_id, name, lift, synergy, num_decks, potential_decks, trend_zscore, inclusion): a row for each card.

    ``payloads`` is (slug, payload) as read by ``sources.files.payloads``. Entries without an id, name, lift or number of
    decks are left out; missing synergy and potential decks are 0. Of a card's entries the highest lift counts, the
    first in order of sections of equal ones.
    """
    lists = payloads.select(F.col(key).alias("commander"), F.posexplode("payload.container.json_dict.cardlists").alias("i", "l"))
    views = lists.select("commander", "i", F.posexplode("l.cardviews").alias("j", "v")).select("commander", F.array("i", "j").alias("place"), "v.*")
    return best_views(views)


def best_views(views: DataFrame) -> DataFrame:
    """The signals of entries (commander, place, id, name, lift, synergy, num_decks, potential_decks, trend_zscore).

    ``place`` orders the entries of a commander; see ``flattened``. One pass of partial sums, no sort of a commander's rows.
    """
    held = views.filter("id <> '' and name <> '' and lift is not null and num_decks is not null")
    best = held.groupBy("commander", "id").agg(F.max("lift").alias("lift"), F.min_by(F.struct("name", "synergy", "num_decks", "potential_decks", "trend_zscore"), F.struct((-F.col("lift")).alias("x"), "place")).alias("m")).select("commander", "id", "lift", "m.*")
    p = F.coalesce("potential_decks", F.lit(0))
    return best.select("commander", F.col("id").alias("card_id"), "name", "lift", F.coalesce("synergy", F.lit(0.0)).alias("synergy"), "num_decks", p.alias("potential_decks"), "trend_zscore", rate(F.col("num_decks"), p).alias("inclusion"))


def fresh(fetched_at: Column, now: Column, days: int) -> Column:
    """``is_fresh`` over a column of times; a null time is stale."""
    return F.coalesce(fetched_at > now - F.expr(f"interval {max(0, days)} days"), F.lit(False))


def ttl_days(value: str | None, default: int = TTL_DAYS) -> int:
    """Days a cached payload is good for: negative ones count as 0, anything but a whole number is an error."""
    return default if value is None or value == "" else max(0, int(value))


def is_fresh(fetched_at: str | None, now: datetime, days: int) -> bool:
    """Whether less than ``days`` have passed; times without an offset are UTC, unreadable ones are stale."""
    try:
        t = datetime.fromisoformat(fetched_at or "")
    except ValueError:
        return False
    t = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return now - t < timedelta(days=days)
