"""Named queries over the engine's operators, each on whole tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import features as fx
from weftline.functions import text as tx
from weftline.functions.vectors import augmented, cosine, mean_vectors, rate, unit, usable
from weftline.operators import cards as cx
from weftline.operators import density, embedding, graph, themes
from weftline.operators import signals as signal_ops
from weftline.operators import tags as tg
from weftline.operators.references import canonical_key
from weftline.runtime import cut, newest, shared_dir
from weftline.sources import files, latest_cards, table

ALPHA, MERGE, AS_OF, TTL_DAYS = 0.6, 0.35, "2025-06-01 00:00:00", 180


# --- what several queries share -------------------------------------------------------------------------------------


def signals(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each signal once, with a commander and a known card as ``card_id``."""
    s = table(spark, d, "card_signals").select("signal_id", "commander", "scryfall_id", *columns).filter("commander is not null").distinct()
    ids = table(spark, d, "cards").select(F.col("_id").alias("card_id"), canonical_key(F.col("_id")).alias("k")).filter("k is not null").distinct()
    return s.withColumn("k", canonical_key(F.col("scryfall_id"))).join(ids, "k").drop("k", "scryfall_id")


def decks(spark: SparkSession, d: str) -> DataFrame:
    """(deck_id, card_id): a commander's cards, each once."""
    return signals(spark, d).select(F.col("commander").alias("deck_id"), "card_id").distinct()


def tag_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return cut(tg.merged(table(spark, d, "tags")))


def tag_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(slug, vec): the mean of a tag's usable vectors."""
    t = table(spark, d, "tags").select(tg.canonical_slug(F.col("_id")).alias("slug"), F.col("embedding").alias("v")).filter(F.col("slug").isNotNull() & usable(F.col("v"), 16))
    return mean_vectors(t, ["slug"], "v", "vec")


def text_vectors(cards: DataFrame) -> DataFrame:
    """(card_id, vec): usable text vectors of 64 numbers folded to the 16 of the tags' vectors.

    A fixed projection of all numbers: the i-th is the sum of those at i, i + 16, i + 32 and i + 48.
    """
    v = F.col("text_embedding")
    folded = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: sum((F.element_at(v, i + k).cast("double") for k in (16, 32, 48)), F.element_at(v, i).cast("double")))
    return cards.filter(usable(v, 64)).select(F.col("_id").alias("card_id"), folded.alias("vec")).filter(usable(F.col("vec"), 16))


def card_vectors(cards: DataFrame) -> DataFrame:
    return cards.filter(usable(F.col("card_vector"), 64)).select(F.col("_id").alias("card_id"), F.col("card_vector").alias("vec"))


def joined(c, places: int = 6):
    """An array of numbers as text, for comparison."""
    return F.array_join(F.transform(c, lambda x: F.round(x + 0.0, places).cast("string")), ",")


def found_themes(spark: SparkSession, d: str, cards: DataFrame, card_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = cards.count()
    window = themes.ThemeWindow(least=-(-2 * n // 100), most=60 * n // 100)
    return themes.discover(tag_catalogue(spark, d), card_tags, tag_vectors(spark, d), window)


# --- scalar functions -----------------------------------------------------------------------------------------------


def content_signature(spark: SparkSession, d: str) -> DataFrame:
    return latest_cards(spark, d, "oracle_text").select("_id", tx.signature(F.col("oracle_text")).alias("sig"))


def _faces(name: str = "name"):
    return F.transform(F.split(F.coalesce(name, F.lit("")), " // "), lambda x: F.struct(x.alias("name"), F.upper(x).alias("mana_cost"), F.when(x != "", F.concat(x, F.lit("."))).alias("oracle_text")))


def alias_array(spark: SparkSession, d: str) -> DataFrame:
    return latest_cards(spark, d, "name").select("_id", F.array_join(tx.aliases(F.col("name"), F.transform(_faces(), lambda f: f["name"])), "|").alias("aliases"))


def face_fallback(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "name", "mana_cost", "oracle_text")
    return c.select("_id", tx.face_value(F.col("mana_cost"), _faces(), "mana_cost").alias("mana_cost"), tx.face_text(F.col("oracle_text"), _faces(), "oracle_text").alias("oracle_text"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "card_signals").filter("commander is not null").select("signal_id", "commander", "name", "num_decks").distinct()
    k = F.pmod(F.coalesce("num_decks", F.lit(0)), F.lit(5))
    line = F.when(k == 0, F.concat(F.lit("SB: 1 "), "name", F.lit(" (ABC) 12"))).when(k == 1, F.concat(F.lit("  4x "), "name", F.lit("  "))).when(k == 2, F.concat(F.lit("# "), "name")).when(k == 3, F.upper("name")).otherwise(F.concat(F.lit("2 "), "name"))
    return s.select(F.col("commander").alias("deck_id"), F.col("signal_id").alias("pos"), F.coalesce(line, F.lit("")).alias("line"))


def decklist_parse(spark: SparkSession, d: str) -> DataFrame:
    return cx.parsed_lists(_lines(spark, d), "deck_id", ["pos"])


def slugify(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "cards").select("name").filter("name is not null").distinct()
    return n.select("name", tx.slug(F.col("name"), strict=False).alias("slug"))


def type_line_vector(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "type_line")
    return c.select("_id", joined(fx.type_vector(F.col("type_line")), 1).alias("vec"), F.array_join(fx.type_words(F.col("type_line"))[2], " ").alias("subtypes"))


def mana_vector(spark: SparkSession, d: str) -> DataFrame:
    return latest_cards(spark, d, "mana_cost").select("_id", joined(fx.mana_vector(F.col("mana_cost")), 1).alias("vec"))


def pt_vector(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "power", "toughness")
    return c.select("_id", joined(fx.stat_vector(F.col("power")), 1).alias("power"), joined(fx.stat_vector(F.col("toughness")), 1).alias("toughness"))


def multi_hot(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "colors", "color_identity", "keywords")
    return c.select("_id", joined(fx.colour_vector(F.col("colors")), 1).alias("colors"), joined(fx.colour_vector(F.col("color_identity")), 1).alias("identity"), joined(fx.keyword_vector(F.col("keywords"), ["Leech", "skyborne", "Bulwark"]), 1).alias("keywords"))


def tag_text(spark: SparkSession, d: str) -> DataFrame:
    return tag_catalogue(spark, d).select("slug", tx.described(F.col("label"), F.col("slug"), F.col("description")).alias("text"))


# --- lookups, merges, counts ----------------------------------------------------------------------------------------


def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "card_signals").select("name")
    return cx.lookup(asked, latest_cards(spark, d, "names"))


def resolve_deck(spark: SparkSession, d: str) -> DataFrame:
    return cx.resolved(cx.parsed_lists(_lines(spark, d), "deck_id", ["pos"]), latest_cards(spark, d, "names"))


def card_diff_merge(spark: SparkSession, d: str) -> DataFrame:
    """What a merge of each snapshot into the one before it would do, counted by status."""
    rows = cut(newest(table(spark, d, "card_snapshots").select("snapshot_no", "_id", "oracle_id", "name", "oracle_text_sha", "delivered_at"), ["snapshot_no", "_id"], "delivered_at"))
    # A row for each snapshot: as few as the deliveries.
    steps = rows.select("snapshot_no").distinct().withColumn("before", F.lag("snapshot_no").over(Window.orderBy("snapshot_no"))).filter("before is not null")
    key = F.struct("step", "_id").alias("key")
    new = rows.join(steps, "snapshot_no").withColumn("step", F.col("snapshot_no")).select(key, "step", "oracle_text_sha")
    old = rows.join(steps.select(F.col("snapshot_no").alias("step"), F.col("before").alias("snapshot_no")), "snapshot_no").select(key, "oracle_id", "name", "oracle_text_sha")
    status = cx.merge_status(new, old, "key", "oracle_text_sha", F.col("name").isNull() | F.col("oracle_id").isNull())
    return status.groupBy(F.col("step").alias("snapshot_no"), "status").agg(F.count("*").alias("n_cards"))


def tag_invert(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "oracle_id", "tags").select(canonical_key(F.col("oracle_id")).alias("oracle_key"), F.explode("tags").alias("x"))
    t = c.select("oracle_key", tg.canonical_slug(F.col("x")).alias("slug")).filter("slug is not null")
    return tg.inverted(t, "oracle_key", "slug").select("oracle_key", F.array_join("slugs", ",").alias("slugs"))


def tag_catalog(spark: SparkSession, d: str) -> DataFrame:
    t = tag_catalogue(spark, d)
    bulk = t.select(F.sha2("slug", 256).alias("id"), "slug", "label", "description", F.transform("parents", lambda x: F.sha2(x, 256)).alias("parent_ids"), F.transform("children", lambda x: F.sha2(x, 256)).alias("child_ids"), tg.none().alias("aliases"))
    return tg.catalogue(bulk).select("_id", F.array_join("parent_slugs", ",").alias("parents"), F.array_join("child_slugs", ",").alias("children"))


def _attach(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cards = latest_cards(spark, d, "oracle_id", "tags").withColumn("oracle_id", canonical_key(F.col("oracle_id")))
    register = table(spark, d, "oracle_register").select(canonical_key(F.col("oracle_id")).alias("oracle_id")).distinct()
    t = cards.select("oracle_id", F.explode("tags").alias("x")).select("oracle_id", tg.canonical_slug(F.col("x")).alias("slug")).filter("slug is not null")
    return register.join(tg.inverted(t, "oracle_id", "slug"), "oracle_id", "left"), cards


def tag_attach_diff(spark: SparkSession, d: str) -> DataFrame:
    return tg.attach_counts(tg.attach_status(*_attach(spark, d)))


def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "oracle_id", "name").filter("oracle_id is not null")
    return c.groupBy("oracle_id").agg(F.min_by("name", "_id").alias("name"))


def top_tags(spark: SparkSession, d: str) -> DataFrame:
    return tg.top(latest_cards(spark, d, "tags").select(F.filter("tags", lambda x: x.isNotNull()).alias("tags")), 10)


def tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return tg.stats(latest_cards(spark, d, "oracle_id", "tags"))


def list_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return cx.by_tag(latest_cards(spark, d, "name", "tags"), "value-engine").select("_id", "name")


def cap_and_page(spark: SparkSession, d: str) -> DataFrame:
    """A report of the first twenty by name: the limit is the feature."""
    return cx.page(latest_cards(spark, d, "name").select("_id", "name"), ["name", "_id"], 20)


def signal_extract(spark: SparkSession, d: str) -> DataFrame:
    views = table(spark, d, "card_signals").filter("commander is not null").select("commander", F.array("signal_id").alias("place"), F.col("scryfall_id").alias("id"), "name", "lift", "synergy", "num_decks", "potential_decks", "trend_zscore")
    return signal_ops.best_views(views).select("commander", F.col("card_id").alias("id"), "lift", "synergy", "num_decks", "potential_decks", F.round("inclusion", 6).alias("inclusion"))


def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    now = F.expr(f"timestamp_ntz'{AS_OF}'")
    s = table(spark, d, "card_signals").filter("commander is not null").groupBy("commander").agg(F.max(F.when(F.col("fetched_at") < now, F.col("fetched_at"))).alias("last"))
    return s.select("commander", signal_ops.fresh(F.col("last"), now, TTL_DAYS).alias("is_fresh"))


def _stored_vectors(cards: DataFrame) -> DataFrame:
    return cards.filter("text_embedding is not null").select(F.col("_id").alias("key"), F.col("oracle_text_sha").alias("text_sha"), F.lit("m1").alias("model"))


def embed_queue(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "oracle_text", "oracle_text_sha", "text_embedding")
    return embedding.queue(c.select("_id", "oracle_text"), _stored_vectors(c), "_id", "oracle_text", "m1").select("_id")


def invalidation(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "oracle_text", "oracle_text_sha", "text_embedding", "card_vector")
    fits = tx.signature(F.col("oracle_text")).eqNullSafe(F.col("oracle_text_sha"))
    has = F.col("text_embedding").isNotNull()
    return c.agg(
        F.count_if(has).alias("n_text_vectors"),
        F.count_if(has & ~fits).alias("n_stale_text"),
        F.count_if(F.col("card_vector").isNotNull() & (~has | ~fits)).alias("n_stale_fused"),
        F.count_if(F.col("card_vector").isNotNull()).alias("n_stale_on_new_alpha"),
    )


def display_names(spark: SparkSession, d: str) -> DataFrame:
    """What is shown for each card that a signal names: the card's name, else the id as it stands; and its first tags."""
    asked = table(spark, d, "card_signals").select(F.col("scryfall_id").alias("_id")).filter("_id is not null").distinct()
    c = latest_cards(spark, d, "name", "tags")
    return asked.join(c, "_id", "left").select("_id", F.coalesce("name", "_id").alias("shown"), tx.head_of(F.filter(F.coalesce("tags", tg.none()), lambda x: x.isNotNull()), 2).alias("tags_head"))


def health_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in ("cards", "tags", "card_signals", "card_snapshots", "oracle_register"):
        one = table(spark, d, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "name", "oracle_text", "cmc", "keywords").drop("updated_at")
    import uuid

    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    files.write_json_lines(c, path)
    back = files.json_lines(spark, path, "_id string, name string, oracle_text string, cmc double, keywords array<string>")
    return back.select("_id", "name", "oracle_text", "cmc", F.array_join("keywords", ",").alias("keywords"))


# --- hierarchy and themes -------------------------------------------------------------------------------------------


def descendants(spark: SparkSession, d: str) -> DataFrame:
    return graph.descendants(tag_catalogue(spark, d))


def tag_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(tag_catalogue(spark, d))


def _base(spark: SparkSession, d: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    cards = cut(latest_cards(spark, d, "tags", *columns))
    return cards, cut(tg.exploded(cards))


def theme_coverage(spark: SparkSession, d: str) -> DataFrame:
    cards, card_tags = _base(spark, d)
    return found_themes(spark, d, cards, card_tags)[0].select("name", "coverage")


def theme_order(spark: SparkSession, d: str) -> DataFrame:
    cards, card_tags = _base(spark, d)
    return themes.ordered(found_themes(spark, d, cards, card_tags)[0]).select("name", "coverage", "place")


def theme_representative(spark: SparkSession, d: str) -> DataFrame:
    cards, card_tags = _base(spark, d)
    t = found_themes(spark, d, cards, card_tags)[0]
    return t.select("name", F.posexplode("representative").alias("i", "x")).select("name", F.col("i").cast("long").alias("i"), F.round(F.col("x") + 0.0, 6).alias("x"))


def classify_card(spark: SparkSession, d: str) -> DataFrame:
    cards, card_tags = _base(spark, d, "text_embedding")
    return themes.classified(card_tags, *found_themes(spark, d, cards, card_tags), text_vectors(cards))


def _assigned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    cards, card_tags = _base(spark, d, "text_embedding", "card_vector")
    t, m = found_themes(spark, d, cards, card_tags)
    by_card = cut(themes.classified(card_tags, t, m, text_vectors(cards)))
    return cards, card_tags, t, m, cut(decks(spark, d).join(by_card, "card_id"))


def theme_pairs(spark: SparkSession, d: str) -> DataFrame:
    cards, _, _, _, assigned = _assigned(spark, d)
    pairs = themes.similar(themes.profiles(assigned, card_vectors(cards)), MERGE)
    return pairs.select("deck_id", "a", "b", F.round("sim", 5).alias("sim"))


def theme_merge(spark: SparkSession, d: str) -> DataFrame:
    cards, _, t, _, assigned = _assigned(spark, d)
    return themes.merge_map(assigned, t, card_vectors(cards), MERGE)


def noise_tags(spark: SparkSession, d: str) -> DataFrame:
    _, card_tags, _, m, assigned = _assigned(spark, d)
    deck_tags = decks(spark, d).join(card_tags, "card_id").select("deck_id", "slug").distinct()
    covered = assigned.select("deck_id", "name").distinct().join(m, "name").select("deck_id", F.col("member").alias("slug")).distinct()
    return themes.noise(deck_tags, covered)


def theme_profile(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every deck's clusters of themes, end to end."""
    cards, card_tags = _base(spark, d, "text_embedding", "card_vector")
    t, m = found_themes(spark, d, cards, card_tags)
    return themes.profile(decks(spark, d), card_tags, t, m, text_vectors(cards), card_vectors(cards), MERGE)


def _missing(spark: SparkSession, d: str) -> DataFrame:
    """(deck_id, name): what a commander's signals name that is no card."""
    ids = table(spark, d, "cards").select(canonical_key(F.col("_id")).alias("k")).filter("k is not null").distinct()
    s = table(spark, d, "card_signals").filter("commander is not null and name is not null").select(F.col("commander").alias("deck_id"), "name", canonical_key(F.col("scryfall_id")).alias("k"))
    return s.join(ids, "k", "left_anti").select("deck_id", "name").distinct()


def tag_universe(spark: SparkSession, d: str) -> DataFrame:
    """Every tag of each deck."""
    _, card_tags = _base(spark, d)
    return themes.tag_universe(decks(spark, d), card_tags)


def _classified_decks(spark: SparkSession, d: str) -> tuple[themes.Classified, DataFrame, DataFrame, DataFrame, DataFrame]:
    cards, card_tags = _base(spark, d, "text_embedding", "card_vector")
    t, m = found_themes(spark, d, cards, card_tags)
    in_deck = cut(decks(spark, d))
    return themes.classify_decks(in_deck, card_tags, t, m, text_vectors(cards), card_vectors(cards), MERGE), t, m, in_deck, card_tags


def theme_profile_full(spark: SparkSession, d: str) -> DataFrame:
    """Every item of every deck's profile: members, tags, constituents, unassigned, universe, noise, missing."""
    c, _, m, in_deck, card_tags = _classified_decks(spark, d)
    return themes.profile_rows(c, m, cut(themes.tag_universe(in_deck, card_tags)), _missing(spark, d))


def theme_centroid(spark: SparkSession, d: str) -> DataFrame:
    c, t, *_ = _classified_decks(spark, d)
    return themes.centroids(c.merged, t).select("deck_id", "label", F.posexplode("centroid").alias("i", "x")).select("deck_id", "label", F.col("i").cast("long").alias("i"), F.round(F.col("x") + 0.0, 5).alias("x"))


def _vocabularies(in_deck: DataFrame) -> DataFrame:
    """(deck_id, keywords, subtypes): the words of each deck's cards (deck_id, keywords, type_line), sorted."""

    def words(col) -> DataFrame:
        return in_deck.select("deck_id", F.explode(col).alias("w")).distinct().groupBy("deck_id").agg(F.array_sort(F.collect_list("w")).alias("v"))

    k = words(F.transform("keywords", F.lower)).withColumnRenamed("v", "keywords")
    s = words(fx.type_words(F.col("type_line"))[2]).withColumnRenamed("v", "subtypes")
    none = F.array().cast("array<string>")
    return in_deck.select("deck_id").distinct().join(k, "deck_id", "left").join(s, "deck_id", "left").select("deck_id", F.coalesce("keywords", none).alias("keywords"), F.coalesce("subtypes", none).alias("subtypes"))


def deck_vocab(spark: SparkSession, d: str) -> DataFrame:
    """Deck-local vocabularies: as many words as there are keywords and subtypes."""
    c = latest_cards(spark, d, "keywords", "type_line").withColumnRenamed("_id", "card_id")
    return _vocabularies(decks(spark, d).join(c, "card_id")).select("deck_id", F.array_join("keywords", ",").alias("keywords"), F.array_join("subtypes", ",").alias("subtypes"))


def label_vote(spark: SparkSession, d: str) -> DataFrame:
    _, card_tags = _base(spark, d)
    members = decks(spark, d).withColumnRenamed("deck_id", "cluster")
    return themes.label_votes(members, card_tags, graph.roots(tag_catalogue(spark, d)))


def eta_squared(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d, "lift").select(F.col("commander").alias("deck_id"), "card_id", "lift")
    types = latest_cards(spark, d, "type_line").select(F.col("_id").alias("card_id"), F.coalesce(F.get(fx.type_words(F.col("type_line"))[1], F.lit(0)), F.lit("")).alias("kind"))
    return themes.eta_squared(s.join(types, "card_id"), "deck_id", "kind", "lift").select("deck_id", F.round(F.col("eta2") + 0.0, 6).alias("eta2"))


# --- vectors --------------------------------------------------------------------------------------------------------


def fuse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Text and tag vectors combined (see ``text_vectors``)."""
    cards, card_tags = _base(spark, d, "text_embedding")
    return embedding.fuse(text_vectors(cards), card_tags, tag_vectors(spark, d), ALPHA).select("card_id", F.posexplode("vec").alias("i", "x")).select("card_id", F.col("i").cast("long").alias("i"), F.round(F.col("x") + 0.0, 5).alias("x"))


def augmented_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = latest_cards(spark, d, "card_vector", "colors", "power").filter(usable(F.col("card_vector"), 64))
    v = cut(c.select("_id", augmented(unit(F.col("card_vector")), {"colors": 0.8, "power": 0.5, "toughness": 0.0}).alias("v")))
    side = lambda x: v.select(F.col("_id").alias(x), F.col("v").alias("v" + x))
    p = table(spark, d, "cluster_probes").select("card_a", "card_b").distinct()
    return p.join(side("card_a"), "card_a").join(side("card_b"), "card_b").select("card_a", "card_b", F.round(cosine(F.col("vcard_a"), F.col("vcard_b")), 5).alias("sim"))


def _deck_cards(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """All cards of each commander, each once, with its best lift and its vector, null if that is not usable."""
    # Shuffled by card once, for both the groups and the join.
    s = signals(spark, d, "lift").repartition("card_id").groupBy(F.col("commander").alias("deck_id"), "card_id").agg(F.max("lift").alias("lift"))
    vec = F.when(usable(F.col("card_vector"), 64), F.col("card_vector")).alias("vec")
    return s.join(latest_cards(spark, d, "card_vector", *columns).select(F.col("_id").alias("card_id"), vec, *columns), "card_id")


def cluster_profile(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of whole decks; noise and cards without a usable vector are unassigned."""
    cards = cut(_deck_cards(spark, d))
    bare = cards.filter("vec is null").select("deck_id", "card_id", F.lit(-1).alias("cluster"))
    labelled = cut(density.clusters(cards).unionByName(bare))
    named = labelled.withColumn("cluster_id", F.concat_ws("#", "deck_id", F.col("cluster").cast("string")))
    members = named.filter("cluster >= 0").select(F.col("cluster_id").alias("cluster"), "card_id")
    _, card_tags = _base(spark, d)
    votes = themes.label_votes(members, card_tags, graph.roots(tag_catalogue(spark, d)))
    size = named.groupBy("deck_id", "cluster", "cluster_id").agg(F.count("*").alias("n_cards"))
    label = F.when(F.col("cluster") < 0, "unassigned").otherwise(F.coalesce("label", F.concat(F.lit("cluster-"), F.col("cluster").cast("string"))))
    return size.join(votes.withColumnRenamed("cluster", "cluster_id"), "cluster_id", "left").select("deck_id", "cluster", label.alias("label"), "n_cards")


def cluster_centroid(spark: SparkSession, d: str) -> DataFrame:
    """The centroid of each deck's density clusters, from the cards' own vectors."""
    cards = cut(_deck_cards(spark, d))
    vecs = cards.filter("vec is not null").select("card_id", "vec").dropDuplicates(["card_id"])
    c = density.centroids(density.clusters(cards), vecs)
    return c.select("deck_id", "cluster", F.posexplode("centroid").alias("i", "x")).select("deck_id", "cluster", F.col("i").cast("long").alias("i"), F.round(F.col("x") + 0.0, 5).alias("x"))


def _trainable(spark: SparkSession, d: str, n: int = 50) -> tuple[DataFrame, list, dict]:
    """Decks with their words, the trials and where the words are."""
    knobs = ["types", "mana_cost", "keywords", "colors", "color_identity", "power", "toughness"]
    drawn = density.trials(knobs, n, seed=7)
    cards = cut(_deck_cards(spark, d, "type_line", "mana_cost", "keywords", "colors", "color_identity", "power", "toughness"))
    words = _vocabularies(cards).select("deck_id", F.col("keywords").alias("vocab_keywords"), F.col("subtypes").alias("vocab_subtypes"))
    return cards.join(words, "deck_id"), drawn, {"keywords": F.col("vocab_keywords"), "subtypes": F.col("vocab_subtypes")}


def train_weights(spark: SparkSession, d: str) -> DataFrame:
    """Each deck's best of 50 trials, over whole decks with their own keywords and subtypes."""
    cards, drawn, vocab = _trainable(spark, d)
    return density.best_trials(density.trained(cards, drawn, vocab=vocab))


def train_best(spark: SparkSession, d: str) -> DataFrame:
    """The weights of each deck's best trial."""
    cards, drawn, vocab = _trainable(spark, d)
    return density.weights_of(density.best_trials(density.trained(cards, drawn, vocab=vocab)), drawn)


def train_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each deck's clusters by the weights it was trained to, with their sizes; noise is cluster -1."""
    cards, drawn, vocab = _trainable(spark, d)
    return density.best_clusters(cards, drawn, vocab=vocab).groupBy("deck_id", "cluster").agg(F.count("*").alias("n_cards"))


def text_encode(spark: SparkSession, d: str) -> DataFrame:
    return embedding.encoded(latest_cards(spark, d, "oracle_text"), "_id", "oracle_text", "hash-8").select("key", "text_sha", joined(F.col("vec"), 1).alias("vec"))


_ALL = (
    content_signature, alias_array, face_fallback, decklist_parse, slugify, type_line_vector, mana_vector, pt_vector, multi_hot, tag_text,
    name_lookup, resolve_deck, card_diff_merge, tag_invert, tag_catalog, tag_attach_diff, first_per_group, top_tags, tag_stats, list_by_tag,
    cap_and_page, signal_extract, ttl_cache, embed_queue, invalidation, display_names, health_counts, jsonl_roundtrip, descendants, tag_roots,
    theme_coverage, theme_order, theme_representative, classify_card, theme_pairs, theme_merge, noise_tags, tag_universe, theme_profile, theme_profile_full, theme_centroid, deck_vocab, label_vote, eta_squared,
    fuse_vectors, augmented_cosine, cluster_profile, cluster_centroid, train_weights, train_best, train_profile, text_encode,
)
QUERIES = {f.__name__: f for f in _ALL}
