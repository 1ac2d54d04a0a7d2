"""Cards: projection of bulk rows, merge by difference, lookup by name, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as t

OWNED = ["oracle_id", "name", "names", "mana_cost", "type_line", "oracle_text", "oracle_text_sha", "keywords", "colors", "color_identity", "cmc", "power", "toughness"]
DERIVED = ["text_embedding", "card_vector"]
EXPORTED = ["scryfall_id", "oracle_id", "name", "type_line", "oracle_text"]


def project(bulk: DataFrame) -> DataFrame:
    """Bulk rows (see ``sources.files.CARD_BULK``) as cards: `_id` and the owned columns. Rows without an id are left out."""
    faces = F.col("card_faces")
    text = t.face_text(F.col("oracle_text"), faces, "oracle_text")
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return bulk.filter("id <> ''").select(
        F.col("id").alias("_id"),
        "oracle_id",
        "name",
        t.aliases(F.col("name"), F.transform(faces, lambda f: f["name"])).alias("names"),
        t.face_value(F.col("mana_cost"), faces, "mana_cost").alias("mana_cost"),
        t.face_value(F.col("type_line"), faces, "type_line").alias("type_line"),
        text.alias("oracle_text"),
        t.signature(text).alias("oracle_text_sha"),
        none("keywords"),
        none("colors"),
        none("color_identity"),
        F.coalesce(F.col("cmc").cast("double"), F.lit(0.0)).alias("cmc"),
        "power",
        "toughness",
    )


def merge_status(incoming: DataFrame, stored: DataFrame, key: str, sha: str, lacks: Column) -> DataFrame:
    """``incoming`` with ``status``: new, changed (another signature), patched (same, but ``lacks``), unchanged.

    ``lacks`` tells over the stored columns whether the stored row is of an older shape. A stored row without a
    signature counts as changed. Both sides should hold a key once.
    """
    s = stored.select(F.col(key), F.col(sha).alias("__sha"), F.coalesce(lacks, F.lit(False)).alias("__lacks"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "new").when(~F.col(sha).eqNullSafe(F.col("__sha")), "changed").when(F.col("__lacks"), "patched").otherwise("unchanged")
    return incoming.join(s, key, "left").withColumn("status", status).drop("__sha", "__lacks", "__there")


def merged(stored: DataFrame, status: DataFrame, key: str, owned: list[str], derived: list[str] = DERIVED) -> DataFrame:
    """The table after a merge: owned columns from the incoming rows that are not unchanged, derived ones cleared where changed."""
    new = status.select(key, F.col("status").alias("__st"), *[F.col(c).alias(f"__n_{c}") for c in owned])
    write = F.col("__st").isin("new", "changed", "patched")
    cols = [F.col(key)]
    for c in stored.columns:
        if c == key:
            continue
        if c in owned:
            cols.append(F.when(write, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
        elif c in derived:
            cols.append(F.when(~F.col("__st").eqNullSafe(F.lit("changed")), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return stored.join(new, key, "full").select(*cols)


def name_index(cards: DataFrame, key: str = "_id") -> DataFrame:
    """(name_lower, card_id): every alias of every card, once; what an index on the array would serve."""
    return cards.select(F.col(key).alias("card_id"), F.explode("names").alias("name_lower")).filter("name_lower <> ''").distinct()


def lookup(asked: DataFrame, cards: DataFrame, name: str = "name") -> DataFrame:
    """(name, n_matches, first_id): each asked name, how many cards have it as an alias, and the smallest key."""
    a = asked.select(F.col(name).alias("name")).filter("name is not null").distinct()
    hits = a.join(name_index(cards).withColumnRenamed("name_lower", "__low"), F.lower("name") == F.col("__low"), "left")
    return hits.groupBy("name").agg(F.count("card_id").alias("n_matches"), F.min("card_id").alias("first_id"))


def by_name(cards: DataFrame, name: str) -> DataFrame:
    """All cards with an alias, whatever the letter case."""
    return cards.filter(F.array_contains("names", name.lower()))


def by_tag(cards: DataFrame, slug: str) -> DataFrame:
    return cards.filter(F.array_contains("tags", slug))


def page(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in an order, nulls first; 0 is no limit."""
    out = df.orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return out.limit(limit) if limit else out


def shown(cards: DataFrame) -> DataFrame:
    """(_id, block): each card as a block of lines."""
    head = F.concat(F.coalesce(t.filled(F.col("name")), F.lit("(unnamed)")), F.lit("  ["), F.coalesce("_id", F.lit("?")), F.lit("]"))
    bits = F.filter(F.array("mana_cost", "type_line"), lambda x: x != "")
    body = F.when(F.col("oracle_text") != "", F.concat(F.lit("\n    "), F.regexp_replace("oracle_text", "\n", "\n    "))).otherwise("")
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("(none)")
    return cards.select("_id", F.concat(head, F.when(F.size(bits) > 0, F.concat(F.lit("\n    "), F.array_join(bits, "  —  "))).otherwise(""), body, F.lit("\n    tags: "), tags).alias("block"))


def parsed_lists(lines: DataFrame, group: str, order: list[str]) -> DataFrame:
    """(group, pos, name): names on list lines, each once whatever the letter case, in the first spelling met."""
    named = lines.select(group, *order, t.deck_name(F.col("line")).alias("name")).filter("name is not null")
    w = Window.partitionBy(group, F.lower("name")).orderBy(*order)
    first = named.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1")
    return first.select(group, *order, "name")


def resolved(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """(deck_id, name, pos, card_id): each deck's cards once, at the first line that names them, missing names with null.

    Of several cards with one alias the smallest key is taken.
    """
    index = name_index(cards).groupBy("name_lower").agg(F.min("card_id").alias("card_id"))
    hit = decks.join(index, F.lower("name") == F.col("name_lower"), "left").select("deck_id", "pos", "name", "card_id")
    w = Window.partitionBy("deck_id", F.coalesce("card_id", F.concat(F.lit("?"), "name"))).orderBy("pos")
    return hit.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
