"""The engine's runs from files to tables, and its small reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftline.functions import text as tx
from weftline.operators import cards as cx
from weftline.operators import embedding, signals
from weftline.operators import tags as tg
from weftline.runtime import cut, newest
from weftline.sources import files
from weftline.sources.store import Store

Reader = Callable[[str], DataFrame]


def import_cards(store: Store, catalogue: DataFrame, read: Reader) -> dict[str, int] | None:
    """Merge the bulk file the catalogue names; counts by status, or None if its stamp is the stored one.

    The stamp is compared as it stands and recorded last, so that a run that breaks off is made again. A key that a
    bulk holds several times counts once.
    """
    entry = files.bulk_entry(catalogue, "oracle_cards").first()
    if store.exists("cards") and not store.read("cards").isEmpty() and store.get("cards_snapshot") == entry.updated_at:
        return None
    rows = cut(newest(cx.project(read(entry.download_uri)).withColumn("__at", F.lit(0)), ["_id"], "__at").drop("__at"))
    if not store.exists("cards"):
        later = {"tags": "array<string>", "card_vector": "array<double>"}
        store.replace("cards", rows.select("*", *[F.lit(None).cast(k).alias(c) for c, k in later.items()]))
        counts = {"new": rows.count()}
    else:
        stored = store.read("cards")
        absent = [c for c in cx.OWNED if c not in stored.columns]
        for c in absent:
            stored = stored.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        status = cut(cx.merge_status(rows, stored, "_id", "oracle_text_sha", F.lit(bool(absent))))
        counts = {r.status: r["count"] for r in status.groupBy("status").count().collect()}
        store.replace("cards", cx.merged(stored, status, "_id", cx.OWNED))
    store.set("cards_snapshot", entry.updated_at)
    return {s: counts.get(s, 0) for s in ("new", "changed", "patched", "unchanged")}


def import_tags(store: Store, catalogue: DataFrame, read: Reader) -> tuple[Row | None, int]:
    """Replace the tag catalogue and attach tags to cards; counts and an exit code, 1 if there are cards but none matched.

    Nothing is done (None, 0) if the stamp is the stored one and every card has had tags attached.
    """
    entry = files.bulk_entry(catalogue, "oracle_tags").first()
    cards = store.read("cards")
    if store.get("tags_snapshot") == entry.updated_at and cards.filter("tags is null").isEmpty():
        return None, 0
    bulk = cut(read(entry.download_uri))
    store.replace("tags", tg.catalogue(bulk))
    given = bulk.select("slug", F.explode("taggings").alias("t")).select("slug", F.col("t.oracle_id").alias("oracle_id"))
    status = cut(tg.attach_status(tg.inverted(given, "oracle_id", "slug"), cards))
    counts = tg.attach_counts(status).first()
    store.replace("cards", tg.attached(cards, status))
    store.set("tags_snapshot", entry.updated_at)
    return counts, int(counts.n_matched == 0 and not cards.isEmpty())


def embed(store: Store, name: str, key: str, text, model: str, load: Callable[[], embedding.Encoder] = lambda: embedding.hash_encoder, refresh: bool = False, limit: int | None = None) -> int:
    """Vectors (key, text_sha, model, vec) in ``{name}_vec`` for the rows of a table that lack one; how many were made.

    A vector counts as there if it was made from the present text by the same model, so a new text or model needs no
    clearing; vectors of unknown origin never count. ``refresh`` makes all of them anew, ``limit`` only so many.
    """
    at = f"{name}_vec"
    rows = store.read(name).select(F.col(key), text.alias("__text"))
    have = store.read(at) if store.exists(at) else store.spark.createDataFrame([], "key string, text_sha string, model string, vec array<float>")
    todo = rows if refresh else embedding.queue(rows, have, key, "__text", model)
    made = cut(embedding.encoded(todo.limit(limit) if limit is not None else todo, key, "__text", model, load))
    n = made.count()
    if n:
        store.replace(at, have.join(made.select("key"), "key", "left_anti").unionByName(made))
    return n


def embed_cards(store: Store, model: str, **kw) -> int:
    return embed(store, "cards", "_id", F.col("oracle_text"), model, **kw)


def embed_tags(store: Store, model: str, **kw) -> int:
    return embed(store, "tags", "_id", tx.described(F.col("label"), F.col("_id"), F.col("description")), model, **kw)


def fuse(store: Store, model: str, alpha: float, refresh: bool = False) -> int:
    """Fused vectors (card_id, input_sig, vec) in ``card_vec`` for cards whose inputs changed; how many were made.

    The signature covers the text, its model, the card's tags and their texts, and alpha. Alpha is checked first.
    """
    if not 0 <= alpha <= 1:
        raise ValueError(f"alpha must lie between 0 and 1, not {alpha}")
    text = store.read("cards_vec").filter(F.col("model") == model).select(F.col("key").alias("card_id"), "text_sha", "vec")
    tags = store.read("tags_vec").filter(F.col("model") == model).select(F.col("key").alias("slug"), F.col("text_sha").alias("tag_sha"), "vec")
    card_tags = store.read("cards").select(F.col("_id").alias("card_id"), F.explode("tags").alias("slug")).join(tags.select("slug", "tag_sha"), "slug")
    used = card_tags.groupBy("card_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "slug", "tag_sha"))), ",").alias("u"))
    signed = text.join(used, "card_id", "left").withColumn("input_sig", F.sha2(F.concat_ws("|", "text_sha", F.lit(model), F.coalesce("u", F.lit("")), F.lit(repr(float(alpha)))), 256))
    have = store.read("card_vec") if store.exists("card_vec") else store.spark.createDataFrame([], "card_id string, input_sig string, vec array<double>")
    todo = cut(signed if refresh else signed.join(have.select("card_id", "input_sig"), ["card_id", "input_sig"], "left_anti"))
    made = embedding.fuse(todo.select("card_id", "vec"), card_tags.select("card_id", "slug"), tags.select("slug", "vec"), alpha)
    made = cut(made.join(todo.select("card_id", "input_sig"), "card_id").select("card_id", "input_sig", "vec"))
    n = made.count()
    if n:
        store.replace("card_vec", have.join(made.select("card_id"), "card_id", "left_anti").unionByName(made))
    return n


def commander_signals(store: Store, slug: str, fetch: Callable[[str], str], now: datetime, days: int = signals.TTL_DAYS, force: bool = False) -> DataFrame:
    """A commander's signals, from the cached payload while it is fresh, else fetched and cached."""
    row = store.read("payloads").filter(F.col("slug") == slug).first() if store.exists("payloads") else None
    if force or row is None or not signals.is_fresh(row.fetched_at, now, days):
        raw = fetch(slug)
        json.loads(raw)  # a broken payload is not cached
        store.upsert("payloads", store.spark.createDataFrame([(slug, now.isoformat(), raw)], "slug string, fetched_at string, payload string"), "slug")
    got = store.read("payloads").filter(F.col("slug") == slug)
    return signals.flattened(got.select("slug", F.from_json("payload", files.SIGNAL_PAYLOAD).alias("payload")))


def show_card(store: Store, name: str) -> tuple[str, int]:
    blocks = [r.block for r in cx.shown(cx.by_name(store.read("cards"), name)).orderBy("_id").collect()]
    return ("\n\n".join(blocks), 0) if blocks else (f"no card named {name!r}", 1)


def show_tag(store: Store, slug: str) -> tuple[str, int]:
    row = store.read("tags").filter(F.col("_id") == slug).first()
    if row is None:
        return f"no tag {slug!r}", 1
    n = cx.by_tag(store.read("cards"), slug).count()
    told = lambda values: ", ".join(values or []) or "(none)"
    # The wordings of the block.
    lines = [f"{slug}  ({row.label or slug})", f"    description : {row.description or '(no description)'}", f"    parents     : {told(row.parent_slugs)}", f"    children    : {told(row.child_slugs)}", f"    aliases     : {told(row.aliases)}", f"    cards tagged: {n}"]
    return "\n".join(lines), 0


def export_cards(store: Store, names: list[str], path: str) -> dict[str, object]:
    """Cards of the asked names as one JSON file; which names are no card, which several cards, and how many entries.

    Names are those a person asks for, so the result comes to the driver. An empty table of cards is an error.
    """
    cards = store.read("cards")
    if cards.isEmpty():
        raise ValueError(f"no cards in {store.root}: import a bulk file first")
    asked = list(dict.fromkeys(x for x in names if x))
    want = store.spark.createDataFrame([(x, x.lower()) for x in asked], "name string, low string")
    index = cx.name_index(cards).join(want, F.col("name_lower") == F.col("low")).select(F.col("name").alias("asked"), "card_id")
    hits = index.join(cards.withColumnRenamed("_id", "card_id"), "card_id").select("asked", F.col("card_id").alias("scryfall_id"), "oracle_id", "name", "type_line", "oracle_text")
    hits = cut(hits)
    many = {r.asked: r["count"] for r in hits.groupBy("asked").count().collect()}
    files.export_json(hits, "asked", path, cx.EXPORTED)
    return {"missing": [x for x in asked if x not in many], "ambiguous": {k: n for k, n in sorted(many.items()) if n > 1}, "entries": sum(many.values())}


def show_list(store: Store, tag: str | None = None, limit: int = 20) -> tuple[str, int]:
    """Names in order; a limit of 0 shows all."""
    rows = store.read("cards") if tag is None else cx.by_tag(store.read("cards"), tag)
    total = rows.count()
    if not total:
        return "no cards", 1
    shown = cx.page(rows.select("name", "_id"), ["name", "_id"], limit).collect()
    return "\n".join([*(f"{r.name}  [{r['_id']}]" for r in shown), f"showing {len(shown)} of {total}"]), 0


def show_stats(store: Store, top: int = 10) -> str:
    s = tg.stats(store.read("cards")).first()
    lines = [f"cards: {s.n_cards}", f"with oracle id: {s.n_with_oracle_id}", f"with tags: {s.n_with_tags} ({s.pct_tagged:.1f} %)", f"without tags: {s.n_without_tags}", f"tag snapshot: {store.get('tags_snapshot')}"]
    return "\n".join([*lines, *(f"  {r.slug}: {r.n_cards}" for r in tg.top(store.read("cards"), top).collect())])


def render_profile(clusters: Iterable[Row], names: dict[str, list[str]] | None = None, limit: int = 10) -> str:
    """The clusters of one deck (rows of ``themes.profile``) as lines; ``names`` gives card names by label."""
    out: list[str] = []
    loose = 0
    for c in clusters:
        loose = c.n_unassigned
        merged = [x for x in c.constituents.split(",") if x != c.label]
        tags = c.tags.split(",") if c.tags else []
        out.append(f"theme '{c.label}'  ({len(tags)} tags, {c.n_cards} cards)" + (f"  [merged: {', '.join(merged)}]" if merged else ""))
        for what, values in (("tags ", tags), ("cards", sorted((names or {}).get(c.label, [])))):
            if values:
                out.append(f"  {what}: " + ", ".join(values[:limit]) + (f", (+{len(values) - limit} more)" if len(values) > limit else ""))
    return "\n".join([*(out or ["(no themes)"]), f"{loose} card(s) unassigned"])
