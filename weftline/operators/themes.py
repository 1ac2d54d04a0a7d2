"""Themes of a tag hierarchy, and cards and decks classified by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import dot, mean_vectors, norm, unit
from weftline.operators.graph import components, descendants
from weftline.runtime import cut

# Parentless slugs that gather cards without being themes.
BLOCKED = ["triggered-ability", "activated-ability", "cycle", "card-names", "flavors-of-vanilla", "type-errata", "unique-type-line", "staple-with-set-s-mechanic", "repeatable-crime"]


@dataclass
class ThemeWindow:
    """Which parentless tags are themes; bounds are inclusive."""

    min_children: int = 2
    least: int = 100
    most: int = 5000
    blocked: tuple[str, ...] = tuple(BLOCKED)


def coverage(card_tags: DataFrame, members: DataFrame) -> DataFrame:
    """(name, coverage): how many cards have a tag of each theme, all themes in one pass."""
    return card_tags.join(members.select("name", F.col("member").alias("slug")), "slug").select("name", "card_id").distinct().groupBy("name").agg(F.count("*").alias("coverage"))


def candidates(catalogue: DataFrame, window: ThemeWindow) -> DataFrame:
    """(name): parentless slugs with enough children told (known or not), none of them blocked."""
    return catalogue.filter((F.size("parents") == 0) & (F.size("children") >= window.min_children) & ~F.col("slug").isin(*window.blocked)).select(F.col("slug").alias("name"))


def discover(catalogue: DataFrame, card_tags: DataFrame, tag_vecs: DataFrame, window: ThemeWindow) -> tuple[DataFrame, DataFrame]:
    """Themes (name, coverage, representative) and their members (name, member).

    A theme is a candidate whose subtree's cards are within the bounds and of which some tag has a vector; its
    representative is the unit mean of those vectors.
    """
    members = descendants(catalogue).withColumnRenamed("slug", "name").join(candidates(catalogue, window), "name", "left_semi")
    members = cut(members.select("name", "member"))
    wide = coverage(card_tags, members).filter(F.col("coverage").between(window.least, window.most))
    rep = mean_vectors(members.join(tag_vecs.withColumnRenamed("slug", "member"), "member"), ["name"], "vec")
    themes = cut(wide.join(rep, "name").select("name", "coverage", unit(F.col("mean")).alias("representative")))
    return themes, members.join(themes.select("name"), "name", "left_semi")


def ordered(themes: DataFrame) -> DataFrame:
    """(name, coverage, place long): themes, the widest first, then by name; as few rows as there are parentless tags."""
    return themes.select("name", "coverage", F.row_number().over(Window.orderBy(F.desc("coverage"), "name")).cast("long").alias("place"))


def tag_universe(decks: DataFrame, card_tags: DataFrame) -> DataFrame:
    """(deck_id, slug): every tag that a card of the deck has, once."""
    return decks.join(card_tags, "card_id").select("deck_id", "slug").distinct()


def centroids(merged: DataFrame, themes: DataFrame) -> DataFrame:
    """(deck_id, label, centroid): the unit mean of the representatives of the themes merged into each cluster."""
    held = merged.join(themes.select("name", "representative"), "name")
    return mean_vectors(held, ["deck_id", "keeper"], "representative").select("deck_id", F.col("keeper").alias("label"), unit(F.col("mean")).alias("centroid"))


def classified(card_tags: DataFrame, themes: DataFrame, members: DataFrame, text_vecs: DataFrame) -> DataFrame:
    """(card_id, name): each card's theme among those that share a tag with it; cards of none are left out.

    Of several the one whose representative is most similar to the card's text vector, or without one the widest; ties
    go to the wider theme, then the smaller name.
    """
    hits = card_tags.join(members.withColumnRenamed("member", "slug"), "slug").select("card_id", "name").distinct()
    scored = hits.join(themes, "name").join(text_vecs.select("card_id", "vec"), "card_id", "left")
    n = norm(F.col("vec"))
    sim = dot(F.col("vec"), F.col("representative"))
    score = F.when(F.col("vec").isNull(), F.lit(0.0)).otherwise(F.when(n > 0, sim / n).otherwise(sim))
    # Rounded, so that sums made in another order do not break ties.
    w = Window.partitionBy("card_id").orderBy(F.desc("score"), F.desc("coverage"), "name")
    return scored.select("card_id", "name", "coverage", F.round(score, 9).alias("score")).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("card_id", "name")


def profiles(assigned: DataFrame, vecs: DataFrame) -> DataFrame:
    """(deck_id, name, profile): the unit mean of the members' vectors; themes without any, or of none, left out."""
    means = mean_vectors(assigned.join(vecs, "card_id"), ["deck_id", "name"], "vec")
    return means.filter(norm(F.col("mean")) > 0).select("deck_id", "name", unit(F.col("mean")).alias("profile"))


def similar(profiled: DataFrame, threshold: float) -> DataFrame:
    """(deck_id, a, b, sim): pairs of a deck's themes at least so similar; a deck has a few dozen themes at most."""
    a = profiled.select("deck_id", F.col("name").alias("a"), F.col("profile").alias("pa"))
    b = profiled.select("deck_id", F.col("name").alias("b"), F.col("profile").alias("pb"))
    return a.join(b, "deck_id").filter("a < b").select("deck_id", "a", "b", dot(F.col("pa"), F.col("pb")).alias("sim")).filter(F.col("sim") >= threshold)


def merge_map(assigned: DataFrame, themes: DataFrame, vecs: DataFrame, threshold: float) -> DataFrame:
    """(deck_id, name, keeper): themes whose profiles are similar, over any chain, merge into the widest, then last by name.

    A threshold of 0 or less merges nothing.
    """
    held = assigned.select("deck_id", "name").distinct()
    if threshold <= 0:
        return held.withColumn("keeper", F.col("name"))
    held = cut(held)
    edges = cut(similar(profiles(assigned, vecs), threshold))
    weighed = held.join(themes.select("name", F.col("coverage").alias("weight")), "name", "left").withColumn("weight", F.coalesce("weight", F.lit(0).cast("long")))
    return components(weighed, edges, "deck_id")


def noise(deck_tags: DataFrame, covered: DataFrame) -> DataFrame:
    """(deck_id, slug): a deck's tags that none of its themes covers."""
    return deck_tags.join(covered, ["deck_id", "slug"], "left_anti")


def profile(decks: DataFrame, card_tags: DataFrame, themes: DataFrame, members: DataFrame, text_vecs: DataFrame, vecs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(deck_id, label, n_cards, tags, constituents, n_unassigned): a row for each cluster of each deck.

    ``decks`` is (deck_id, card_id), each once. ``tags`` are those of the cluster's cards that its themes hold,
    ``constituents`` the themes merged into it; both sorted and joined by a comma. Cards of no theme are counted in
    ``n_unassigned`` of every row of their deck; decks without any cluster have no row.
    """
    c = classify_decks(decks, card_tags, themes, members, text_vecs, vecs, threshold)
    n = c.placed.groupBy("deck_id", "keeper").agg(F.count("*").alias("n_cards"))
    parts = c.merged.groupBy("deck_id", "keeper").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("constituents"))
    tags = c.tags.groupBy("deck_id", "keeper").agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("tags"))
    loose = c.loose.groupBy("deck_id").agg(F.count("*").alias("n_unassigned"))
    out = n.join(parts, ["deck_id", "keeper"]).join(tags, ["deck_id", "keeper"], "left").join(loose, "deck_id", "left")
    return out.select("deck_id", F.col("keeper").alias("label"), "n_cards", F.coalesce("tags", F.lit("")).alias("tags"), "constituents", F.coalesce("n_unassigned", F.lit(0).cast("long")).alias("n_unassigned"))


@dataclass
class Classified:
    """The decks' clusters of themes, part by part; nothing is gathered into one row."""

    placed: DataFrame  # deck_id, name, card_id, keeper: each assigned card, its theme and that one's cluster
    merged: DataFrame  # deck_id, name, keeper
    tags: DataFrame  # deck_id, keeper, slug: tags of a cluster's cards that its themes hold
    loose: DataFrame  # deck_id, card_id: cards of no theme


def classify_decks(decks: DataFrame, card_tags: DataFrame, themes: DataFrame, members: DataFrame, text_vecs: DataFrame, vecs: DataFrame, threshold: float) -> Classified:
    by_card = cut(classified(card_tags, themes, members, text_vecs))
    assigned = cut(decks.join(by_card, "card_id"))
    merged = cut(merge_map(assigned, themes, vecs, threshold))
    placed = assigned.join(merged, ["deck_id", "name"])
    # A deck's cards meet the slugs of their own cluster only, through the themes merged into it.
    reach = merged.join(members, "name").select("deck_id", "keeper", F.col("member").alias("slug")).distinct()
    tags = placed.select("deck_id", "keeper", "card_id").join(card_tags, "card_id").select("deck_id", "keeper", "slug").distinct().join(reach, ["deck_id", "keeper", "slug"], "left_semi")
    return Classified(placed, merged, tags, decks.join(by_card, "card_id", "left_anti").select("deck_id", "card_id"))


def profile_rows(c: Classified, members: DataFrame, universe: DataFrame, missing: DataFrame) -> DataFrame:
    """(deck_id, label, kind, value): everything a deck's profile lists, a row for each item.

    ``member`` cards, ``tag`` slugs and ``constituent`` themes of each cluster; for the deck, with an empty label, its
    ``unassigned`` cards, ``universe`` of tags, ``noise`` tags that none of its themes covers, and the ``missing`` names
    (deck_id, name) of its list. A reader sorts by kind and value.
    """
    covered = c.merged.join(members, "name").select("deck_id", F.col("member").alias("slug")).distinct()

    def rows(df: DataFrame, kind: str, value: str, label: str | None = None) -> DataFrame:
        return df.select("deck_id", (F.col(label) if label else F.lit("")).alias("label"), F.lit(kind).alias("kind"), F.col(value).alias("value"))

    out = rows(c.placed, "member", "card_id", "keeper").unionByName(rows(c.tags, "tag", "slug", "keeper")).unionByName(rows(c.merged, "constituent", "name", "keeper"))
    for df, kind, value in ((c.loose, "unassigned", "card_id"), (universe, "universe", "slug"), (noise(universe, covered), "noise", "slug"), (missing, "missing", "name")):
        out = out.unionByName(rows(df, kind, value))
    return out


def label_votes(clusters: DataFrame, card_tags: DataFrame, tag_roots: DataFrame, blocked: list[str] = BLOCKED) -> DataFrame:
    """(cluster, label, n_votes): the root above most of a cluster's cards, each card voting once a root; ties by slug.

    ``clusters`` is (cluster, card_id). Clusters without a vote are left out (callers name those by number).
    """
    votes = clusters.join(card_tags, "card_id").join(tag_roots, "slug").filter(~F.col("root").isin(*blocked)).select("cluster", "card_id", "root").distinct()
    counts = votes.groupBy("cluster", "root").agg(F.count("*").alias("n_votes"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n_votes"), "root")
    return counts.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("cluster", F.col("root").alias("label"), "n_votes")


def eta_squared(scored: DataFrame, group: str, cluster: str, score: str) -> DataFrame:
    """(group, eta2): the share of a score's variance that lies between clusters; 0 with less than two scores or no variance.

    Rows without a score do not count. Variances are taken about the group's mean, in two passes.
    """
    held = scored.filter(F.col(score).isNotNull())
    means = held.groupBy(group).agg(F.avg(score).alias("__g"), F.count("*").alias("__n"))
    joined = held.join(means, group)
    parts = joined.groupBy(group, cluster).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.sum((F.col(score) - F.col("__g")) ** 2).alias("sst"), F.first("__g").alias("g"))
    sums = parts.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("ssb"), F.sum("sst").alias("sst"))
    ratio: Column = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ssb") / F.col("sst")))
    return sums.select(group, F.when((F.col("n") < 2) | (F.col("sst") <= 1e-18), 0.0).otherwise(ratio).alias("eta2"))
