"""Tags: catalogue, inversion, attachment by difference, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.hierarchy import canonical_slug

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def catalogue(bulk: DataFrame) -> DataFrame:
    """Bulk tags (see ``sources.files.TAG_BULK``) as slugs: parent and child ids replaced in order, unknown ones dropped.

    Ids without a slug are unknown; of repeated ids the largest slug counts.
    """
    ids = bulk.filter("id <> '' and slug <> ''").groupBy("id").agg(F.max("slug").alias("to"))

    def slugs(column: str) -> DataFrame:
        each = bulk.select("slug", F.posexplode(column).alias("i", "id")).join(ids, "id")
        return each.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda x: x["to"]).alias(column.replace("_ids", "_slugs")))

    base = bulk.filter("slug <> ''").select(F.col("slug"), "label", "description", F.coalesce("aliases", none()).alias("aliases"))
    out = base.join(slugs("parent_ids"), "slug", "left").join(slugs("child_ids"), "slug", "left")
    return out.select(F.col("slug").alias("_id"), "label", "description", F.coalesce("parent_slugs", none()).alias("parent_slugs"), F.coalesce("child_slugs", none()).alias("child_slugs"), "aliases")


def merged(tags: DataFrame) -> DataFrame:
    """One row for each slug of a table in which a tag may lie in several rows: (slug, label, description, parents, children).

    Arrays are united, each slug cleaned, nulls and blanks dropped; ``parents`` and ``children`` are sorted.
    """
    t = tags.select(canonical_slug(F.col("_id")).alias("slug"), "label", "description", "parent_slugs", "child_slugs").filter("slug is not null")

    def side(column: str, to: str) -> DataFrame:
        each = t.select("slug", F.explode(column).alias("x")).select("slug", canonical_slug(F.col("x")).alias("x")).filter("x is not null")
        return each.groupBy("slug").agg(F.array_sort(F.collect_set("x")).alias(to))

    base = t.groupBy("slug").agg(F.max("label").alias("label"), F.max("description").alias("description"))
    out = base.join(side("parent_slugs", "parents"), "slug", "left").join(side("child_slugs", "children"), "slug", "left")
    return out.withColumns({c: F.coalesce(c, none()) for c in ("parents", "children")})


def exploded(cards: DataFrame, key: str = "_id", tags: str = "tags") -> DataFrame:
    """(card_id, slug): each card's distinct tags, cleaned."""
    return cards.select(F.col(key).alias("card_id"), F.explode(tags).alias("x")).select("card_id", canonical_slug(F.col("x")).alias("slug")).filter("slug is not null").distinct()


def inverted(taggings: DataFrame, key: str, slug: str) -> DataFrame:
    """(key, slugs): the sorted distinct slugs of each key."""
    return taggings.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.array_sort(F.collect_set(slug)).alias("slugs"))


def attach_status(desired: DataFrame, cards: DataFrame, key: str = "oracle_id") -> DataFrame:
    """(key, slugs, in_cards, changed): what each key's tags should be, whether a card has the key and they differ.

    ``desired`` is (key, slugs). Null and empty arrays are alike. The stored tags are those of the key's smallest card.
    """
    have = cards.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("tags", "_id").alias("__old")).withColumn("__in", F.lit(True))
    new, old = F.coalesce("slugs", none()), F.coalesce("__old", none())
    return desired.join(have, key, "full").select(key, new.alias("slugs"), F.coalesce("__in", F.lit(False)).alias("in_cards"), (~new.eqNullSafe(old)).alias("changed"))


def attach_counts(status: DataFrame) -> DataFrame:
    """One row: keys changed, of these in cards, with tags, without, and not in cards."""
    return status.agg(
        F.count_if("changed").alias("n_changed"),
        F.count_if(F.col("changed") & F.col("in_cards")).alias("n_changed_matched"),
        F.count_if(F.col("in_cards") & (F.size("slugs") > 0)).alias("n_matched"),
        F.count_if(F.col("in_cards") & (F.size("slugs") == 0)).alias("n_empty"),
        F.count_if(~F.col("in_cards")).alias("n_unmatched"),
    )


def attached(cards: DataFrame, status: DataFrame, key: str = "oracle_id") -> DataFrame:
    """Cards with their tags set; a card's fused vector is cleared where its own tags change."""
    s = status.select(key, F.col("slugs").alias("__new"))
    new = F.coalesce("__new", none())
    out = cards.join(s, key, "left").withColumn("card_vector", F.when(F.coalesce("tags", none()).eqNullSafe(new), F.col("card_vector")))
    return out.withColumn("tags", new).drop("__new").select(*cards.columns)


def top(cards: DataFrame, n: int, tags: str = "tags") -> DataFrame:
    """(slug, n_cards): the n tags that most records name, each mention counted; ties by slug."""
    return cards.select(F.explode(tags).alias("slug")).groupBy("slug").agg(F.count("*").alias("n_cards")).orderBy(F.desc("n_cards"), "slug").limit(n)


def stats(cards: DataFrame) -> DataFrame:
    """One row of counts over cards; the share with tags in percent."""
    has = F.size(F.coalesce("tags", none())) > 0
    total, tagged = F.count("*"), F.count_if(has)
    return cards.agg(
        total.alias("n_cards"),
        F.count("oracle_id").alias("n_with_oracle_id"),
        tagged.alias("n_with_tags"),
        (total - tagged).alias("n_without_tags"),
        F.countDistinct("oracle_id").alias("n_oracle_ids"),
        F.when(total > 0, F.round(100.0 * tagged / total, 1)).otherwise(0.0).alias("pct_tagged"),
    )
