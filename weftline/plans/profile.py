"""A deck's profile from a list of names: by themes, by density clusters, or by clusters trained on outer scores."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import features as fx
from weftline.functions.text import slug, split_option
from weftline.operators import cards as cx
from weftline.operators import density, graph, themes
from weftline.operators import tags as tg
from weftline.plans.flows import commander_signals
from weftline.runtime import cut, session
from weftline.sources import files
from weftline.sources.store import Store

DECK = "deck"
KNOBS = ["types", "mana_cost", "keywords", "colors", "color_identity", "power", "toughness"]


@dataclass
class Options:
    mode: str = "theme"
    model: str = "hash-8"
    window: themes.ThemeWindow = field(default_factory=themes.ThemeWindow)
    merge: float = 0.9
    least: int = 3
    epsilon: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    blocked: list[str] | None = None
    commander: str | None = None
    trials: int = 50
    seed: int = 0
    knobs: list[str] = field(default_factory=lambda: list(KNOBS))
    most_weight: float = 1.0


@dataclass
class Cluster:
    label: str
    card_ids: list[str]
    centroid: list[float]
    tags: list[str]
    constituents: list[str]


@dataclass
class Profile:
    card_ids: list[str]
    missing: list[str]
    universe: list[str]
    clusters: list[Cluster]
    unassigned: list[str]
    noise: list[str]
    names: dict[str, str]
    weights: dict[str, float] = field(default_factory=dict)
    score: float | None = None


def deck_of(store: Store, path: str | None, names: list[str] = ()) -> DataFrame:
    """(deck_id, pos, name, card_id) of a list file and further names, in order; names of no card have no card_id."""
    lines = files.list_lines(store.spark, path, names)
    lines = lines.select(F.lit(DECK).alias("deck_id"), (F.col("src") * F.lit(1 << 40) + F.col("pos")).alias("pos"), "line")
    return cut(cx.resolved(cx.parsed_lists(lines, "deck_id", ["pos"]), store.read("cards").select("_id", "names")))


def _vectors(store: Store, name: str, key: str, to: str, model: str | None) -> DataFrame:
    if not store.exists(name):
        return store.spark.createDataFrame([], f"{to} string, vec array<double>")
    df = store.read(name)
    df = df if model is None else df.filter(F.col("model") == model)
    return df.select(F.col(key).alias(to), F.col("vec").cast("array<double>").alias("vec"))


def _by_themes(store: Store, decks: DataFrame, card_tags: DataFrame, catalogue: DataFrame, o: Options, p: Profile) -> Profile:
    text, vecs = _vectors(store, "cards_vec", "key", "card_id", o.model), _vectors(store, "card_vec", "card_id", "card_id", None)
    window = o.window if o.blocked is None else replace(o.window, blocked=tuple(o.blocked))
    t, m = themes.discover(catalogue, card_tags, _vectors(store, "tags_vec", "key", "slug", o.model), window)
    c = themes.classify_decks(decks, card_tags, t, m, text, vecs, o.merge)
    none = decks.select("deck_id", F.lit("").alias("name")).limit(0)
    rows = themes.profile_rows(c, m, themes.tag_universe(decks, card_tags), none).collect()  # one deck's cards and tags
    centre = {r.label: list(r.centroid) for r in themes.centroids(c.merged, t).collect()}
    place = {r.name: r.place for r in themes.ordered(t).collect()}
    of = lambda kind, label="": sorted(r.value for r in rows if r.kind == kind and r.label == label)
    labels = sorted({r.label for r in rows if r.kind == "member"}, key=lambda x: place[x])
    found = [Cluster(x, of("member", x), centre[x], of("tag", x), of("constituent", x)) for x in labels]
    return replace(p, clusters=found, unassigned=of("unassigned"), noise=of("noise"))


def _by_clusters(store: Store, decks: DataFrame, card_tags: DataFrame, catalogue: DataFrame, o: Options, p: Profile, fetch: Callable[[str], str] | None) -> Profile:
    held = store.read("cards").select(F.col("_id").alias("card_id"), "type_line", "mana_cost", "keywords", "colors", "color_identity", "power", "toughness")
    cards = decks.join(held, "card_id").join(_vectors(store, "card_vec", "card_id", "card_id", None), "card_id", "left")
    # The deck's own words, as few as its cards have.
    words = cards.select(F.explode(F.transform("keywords", F.lower)).alias("w")).distinct().agg(F.array_sort(F.collect_list("w"))).first()[0]
    subs = cards.select(F.explode(fx.type_words(F.col("type_line"))[2]).alias("w")).distinct().agg(F.array_sort(F.collect_list("w"))).first()[0]
    text_array = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    vocab = {"keywords": text_array(words), "subtypes": text_array(subs)}
    weights, score = {k: w for k, w in o.weights.items() if w > 0}, None
    if o.mode == "train":
        if not o.commander:
            raise ValueError("training needs the name of a commander")
        name = store.spark.range(1).select(slug(F.lit(o.commander))).first()[0]
        got = commander_signals(store, name, fetch or _no_fetch, datetime.now(timezone.utc))
        cards = cut(cards.join(got.select("card_id", "lift"), "card_id", "left"))
        if cards.filter("lift is not null").isEmpty():
            raise ValueError(f"no card of the deck has a lift for {o.commander!r}: nothing to train on")
        if o.trials > 0:
            drawn = density.trials(o.knobs, o.trials, (0.0, o.most_weight), o.seed)
            best = density.best_trials(density.trained(cards, drawn, o.least, o.epsilon, vocab=vocab)).first()
            weights, score = ({k: w for k, w in drawn[best.trial].items() if w > 0}, best.eta2) if best else ({}, 0.0)
        else:
            weights, score = {}, 0.0
    labelled = cut(density.clusters(cards, o.least, o.epsilon, weights, vocab))
    roots = graph.roots(catalogue)
    named = labelled.filter("cluster >= 0").select(F.col("cluster").cast("string").alias("cluster"), "card_id")
    label = {int(r.cluster): r.label for r in themes.label_votes(named, card_tags, roots, o.blocked if o.blocked is not None else themes.BLOCKED).collect()}
    centre = {r.cluster: list(r.centroid) for r in density.centroids(labelled, cards.filter("vec is not null")).collect()}
    tags: dict[int, set[str]] = {}
    for r in named.join(card_tags, "card_id").select("cluster", "slug").distinct().collect():
        tags.setdefault(int(r.cluster), set()).add(r.slug)
    members: dict[int, list[str]] = {}
    for r in labelled.collect():  # one deck's cards
        members.setdefault(r.cluster, []).append(r.card_id)
    placed = {x for c, ids in members.items() if c >= 0 for x in ids}
    found = []
    for c in sorted(k for k in members if k >= 0):
        title = label.get(c, f"cluster-{c}")
        found.append(Cluster(title, sorted(members[c]), centre[c], sorted(tags.get(c, ())), [title]))
    return replace(p, clusters=found, unassigned=sorted(set(p.card_ids) - placed), weights=weights, score=score)


def _no_fetch(name: str) -> str:
    raise ValueError(f"no cached signals of {name!r} and nothing to fetch them with")


def profile(store: Store, path: str | None, names: list[str] = (), options: Options | None = None, fetch: Callable[[str], str] | None = None) -> Profile:
    """The profile of one deck, a list that a person gives, so what comes to the driver follows its cards.

    Tables ``cards`` and ``tags``, and vectors ``cards_vec``, ``tags_vec`` and ``card_vec`` as ``flows`` writes them.
    Cards of the list count once; of several cards of one name the smallest key. ``fetch`` gets a commander's payload.
    """
    o = options or Options()
    deck = deck_of(store, path, names)
    decks = deck.filter("card_id is not null").select("deck_id", "card_id")
    cards = store.read("cards")
    in_deck = cards.join(decks.withColumnRenamed("card_id", "_id"), "_id", "left_semi")
    card_tags, catalogue = cut(tg.exploded(cards if o.mode == "theme" else in_deck)), cut(tg.merged(store.read("tags")))
    shown = {r["_id"]: r.name or r["_id"] for r in in_deck.select("_id", "name").collect()}
    universe = sorted(r.slug for r in themes.tag_universe(decks, card_tags).collect())
    missing = [r.name for r in deck.filter("card_id is null").orderBy("pos").collect()]
    p = Profile(sorted(shown), missing, universe, [], [], [], shown)
    if o.mode == "theme":
        return _by_themes(store, decks, card_tags, catalogue, o, p)
    return _by_clusters(store, decks, card_tags, catalogue, o, p, fetch)


def head(values: list[str], limit: int) -> str:
    return ", ".join(values) if len(values) <= limit else ", ".join([*values[:limit], f"(+{len(values) - limit} more)"])


def render(p: Profile, limit: int = 10) -> str:
    """The profile as lines; lists longer than ``limit`` are cut with a mark. The wordings are fixed values."""
    name = lambda ids: sorted(p.names.get(x, x) for x in ids)
    out = [f"resolved {len(p.card_ids)} unique cards ({len(p.missing)} missing)", *(f"  missing: {x}" for x in p.missing)]
    out.append(f"tag universe: {len(p.universe)} unique tags")
    out.append(f"{len(p.clusters)} theme(s) matched, {len(p.unassigned)} card(s) unassigned, {len(p.noise)} tag(s) outside any theme")
    out.append("")
    if not p.clusters:
        out.append("(no themes matched — try loosening the filter with --max-coverage / --min-coverage / --min-children)")
    for c in p.clusters:
        merged = [x for x in c.constituents if x != c.label]
        out.append(f"theme '{c.label}'  ({len(c.tags)} tags from deck, {len(c.card_ids)} cards)" + (f"  [merged: {', '.join(merged)}]" if merged else ""))
        out += [f"  tags : {head(c.tags, limit)}", f"  cards: {head(name(c.card_ids), limit)}", ""]
    if p.unassigned:
        out.append(f"unassigned cards: {head(name(p.unassigned), limit)}")
    if p.noise:
        out.append(f"noise tags: {head(p.noise, limit)}")
    return "\n".join(out)


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="weftline-profile", description="Profile a list of cards by themes or by clusters.")
    a.add_argument("cards", nargs="*")
    a.add_argument("-f", "--file")
    a.add_argument("--mode", choices=("theme", "cluster"), default="theme")
    a.add_argument("--model", default="hash-8")
    for flag, kind, value in (
        ("min-children", int, 2), ("min-coverage", int, 100), ("max-coverage", int, 5000), ("merge-threshold", float, 0.9), ("cluster-min-size", int, 3),
        ("cluster-selection-epsilon", float, 0.0), ("train-trials", int, 50), ("train-seed", int, 0), ("train-max-weight", float, 1.0), ("limit", int, 10),
    ):
        a.add_argument(f"--{flag}", type=kind, default=value)
    for flag in ("type", "mana-cost", "keyword", "color", "color-identity", "power", "toughness"):
        a.add_argument(f"--{flag}-weight", type=float, default=0.0)
    a.add_argument("--train", action="store_true")
    a.add_argument("--commander")
    a.add_argument("--train-knobs")
    a.add_argument("--theme-blocklist")
    return a


def options_of(args: argparse.Namespace) -> Options:
    weights = dict(zip(KNOBS, (args.type_weight, args.mana_cost_weight, args.keyword_weight, args.color_weight, args.color_identity_weight, args.power_weight, args.toughness_weight)))
    window = themes.ThemeWindow(args.min_children, args.min_coverage, args.max_coverage)
    mode = "train" if args.mode == "cluster" and args.train else args.mode
    return Options(mode, args.model, window, args.merge_threshold, args.cluster_min_size, args.cluster_selection_epsilon, weights, split_option(args.theme_blocklist), args.commander, args.train_trials, args.train_seed, split_option(args.train_knobs, list(KNOBS)), args.train_max_weight)


def main(argv: list[str] | None = None, store: Store | None = None, fetch: Callable[[str], str] | None = None) -> int:
    """A run from names or a list file to printed lines; 2 for wrong arguments, 1 if no name is a card."""
    p = parser()
    args = p.parse_args(argv)
    if not args.cards and not args.file:
        p.error("no card names: give names or --file")
    if args.train and not args.commander:
        p.error("--train needs --commander NAME")
    store = store or Store.from_env(session("profile"))
    got = profile(store, args.file, args.cards, options_of(args), fetch)
    if got.score is not None:
        print("weights: " + (", ".join(f"{k}={w:.3f}" for k, w in sorted(got.weights.items())) or "(none)") + f"  score {got.score:.4f}")
    print(render(got, args.limit))
    return int(not got.card_ids)


if __name__ == "__main__":
    sys.exit(main())
