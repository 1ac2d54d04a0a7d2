import os
import time

import numpy as np
import pytest
from weftline.functions.vectors import augmented, cosine, fused, mean_vectors, same_size, unit
from weftline.operators import density, embedding, graph, themes
from weftline.operators import tags as tg

# Four roots with two children each; one root is blocked.
TREE = [("removal", None, ["spot-removal", "mass-removal"]), ("spot-removal", ["removal"], None), ("mass-removal", ["removal"], None), ("ramp", [], ["mana-rock", "mana-dork"]), ("mana-rock", ["ramp"], []), ("mana-dork", ["ramp"], []), ("card-advantage", [], ["draw", "tutor"]), ("draw", ["card-advantage"], []), ("tutor", ["card-advantage"], []), ("cycle", [], ["draw", "x"]), ("point", [], ["y"])]
VEC = {"removal": [1, 0, 0, 0], "spot-removal": [1, 0.1, 0, 0], "ramp": [0, 1, 0, 0], "mana-rock": [0, 1, 0, 0], "card-advantage": [0, 0, 1, 0], "cycle": [0, 0, 0, 1]}
CARDS = [("a", ["spot-removal"], [1, 0, 0, 0]), ("b", ["mana-rock", "mass-removal"], [0.1, 1, 0, 0]), ("c", ["draw"], None), ("d", ["mana-dork"], [0, 1, 0, 0]), ("e", ["mana-rock"], [0, 1, 0, 0]), ("f", ["nothing"], [0, 0, 0, 1]), ("g", [], [0, 0, 0, 1]), ("h", ["mana-rock", "spot-removal"], None)]


@pytest.fixture(scope="module")
def setup(spark):
    t = spark.createDataFrame([(s, s.title(), None, p, c) for s, p, c in TREE], "_id string, label string, description string, parent_slugs array<string>, child_slugs array<string>")
    cat = tg.merged(t).cache()
    tv = spark.createDataFrame([(k, list(map(float, v))) for k, v in VEC.items()], "slug string, vec array<double>")
    cards = spark.createDataFrame([(i, x) for i, x, _ in CARDS], "_id string, tags array<string>")
    vecs = spark.createDataFrame([(i, list(map(float, v))) for i, _, v in CARDS if v], "card_id string, vec array<double>")
    return cat, tv, tg.exploded(cards).cache(), vecs


def test_discovery_order_window_and_block(setup):
    cat, tv, card_tags, _ = setup
    t, m = themes.discover(cat, card_tags, tv, themes.ThemeWindow(least=1, most=10_000))
    got = [(r.name, r.coverage) for r in t.orderBy("coverage", ascending=False).collect()]
    assert got == [("ramp", 4), ("removal", 3), ("card-advantage", 1)]
    assert {r.member for r in m.filter("name = 'removal'").collect()} == {"removal", "spot-removal", "mass-removal"}
    rep = {r.name: r.representative for r in t.collect()}
    assert abs(np.linalg.norm(rep["removal"]) - 1) < 1e-9 and rep["ramp"] == pytest.approx([0, 1, 0, 0])
    assert [r.name for r in themes.discover(cat, card_tags, tv, themes.ThemeWindow(least=3, most=3))[0].collect()] == ["removal"]
    assert themes.discover(cat, card_tags, tv.filter("false"), themes.ThemeWindow(least=1))[0].count() == 0


def test_classification_by_text_or_width(setup):
    cat, tv, card_tags, vecs = setup
    t, m = themes.discover(cat, card_tags, tv, themes.ThemeWindow(least=1, most=10_000))
    got = {r.card_id: r.name for r in themes.classified(card_tags, t, m, vecs).collect()}
    assert got == {"a": "removal", "b": "ramp", "c": "card-advantage", "d": "ramp", "e": "ramp", "h": "ramp"}


def test_profile_of_a_deck(spark, setup):
    cat, tv, card_tags, vecs = setup
    t, m = themes.discover(cat, card_tags, tv, themes.ThemeWindow(least=1, most=10_000))
    decks = spark.createDataFrame([("D", c[0]) for c in CARDS] + [("E", "f")], "deck_id string, card_id string")
    got = {r.label: r for r in themes.profile(decks, card_tags, t, m, vecs, vecs, threshold=0.9).collect()}
    assert set(got) == {"removal", "ramp", "card-advantage"}
    assert (got["ramp"].n_cards, got["ramp"].tags, got["ramp"].n_unassigned) == (4, "mana-dork,mana-rock", 2)
    merged = {r.label: r for r in themes.profile(decks, card_tags, t, m, vecs, vecs, threshold=0.01).collect()}
    assert merged["ramp"].constituents == "ramp,removal" and merged["ramp"].n_cards == 5


def test_chain_merges_onto_the_widest_then_last_name(spark):
    nodes = spark.createDataFrame([("D", "a", 5), ("D", "b", 9), ("D", "c", 9), ("D", "z", 1), ("E", "a", 5)], "deck_id string, name string, weight long")
    edges = spark.createDataFrame([("D", "a", "b"), ("D", "b", "c")], "deck_id string, a string, b string")
    got = {(r.deck_id, r.name): r.keeper for r in graph.components(nodes, edges, "deck_id").collect()}
    assert got == {("D", "a"): "c", ("D", "b"): "c", ("D", "c"): "c", ("D", "z"): "z", ("E", "a"): "a"}
    t = spark.createDataFrame([("a", 1)], "name string, coverage long")
    asg = spark.createDataFrame([("D", "x", "a")], "deck_id string, card_id string, name string")
    assert [tuple(r) for r in themes.merge_map(asg, t, asg, 0).collect()] == [("D", "a", "a")]


def test_closures_with_circles_and_unknowns(spark):
    rows = [("a", ["b"], []), ("b", ["a", "gone"], ["a"]), ("c", [], ["b"]), ("d", [], [])]
    cat = spark.createDataFrame([(s, c, p) for s, c, p in rows], "slug string, children array<string>, parents array<string>")
    d = {}
    for r in graph.descendants(cat).collect():
        d.setdefault(r.slug, set()).add(r.member)
    assert d == {"a": {"a", "b"}, "b": {"a", "b"}, "c": {"c"}, "d": {"d"}}
    assert {(r.slug, r.root) for r in graph.roots(cat).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")}


def test_votes_count_cards_once(spark):
    ct = spark.createDataFrame([("x", f"r{i}") for i in range(10)] + [("y", "m1"), ("z", "m1"), ("w", "t")], "card_id string, slug string")
    roots = spark.createDataFrame([(f"r{i}", "removal") for i in range(10)] + [("m1", "ramp"), ("t", "cycle")], "slug string, root string")
    cl = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z"), (2, "w")], "cluster int, card_id string")
    assert [tuple(r) for r in themes.label_votes(cl, ct, roots).collect()] == [(1, "ramp", 2)]


def test_eta_squared(spark):
    rows = [("p", 1, 4.0), ("p", 1, 6.0), ("p", 2, 1.0), ("p", 2, 3.0), ("one", 1, 5.0), ("flat", 1, 2.0), ("flat", 2, 2.0), ("full", 1, 5.0), ("full", 1, 5.0), ("full", 2, 1.0), ("full", 2, None)]
    got = {r.deck: r.eta2 for r in themes.eta_squared(spark.createDataFrame(rows, "deck string, c int, lift double"), "deck", "c", "lift").collect()}
    assert got == {"p": pytest.approx(9 / 13), "one": 0.0, "flat": 0.0, "full": pytest.approx(1.0)}
    assert density.eta2(np.array([0, 0, 1, 1, -1]), np.array([4, 6, 1, 3, 99.0])) == pytest.approx(9 / 13)
    assert density.eta2(np.array([0, 1]), np.array([np.nan, 1.0])) == 0.0


def around(centre, n, r, noise=0.02):
    return np.asarray(centre) + noise * r.standard_normal((n, len(centre)))


def test_density_clusters():
    r = np.random.default_rng(1)
    x = np.concatenate([around(np.eye(4)[i], 3, r) for i in range(3)])
    assert density.density_labels(x, 3).tolist() == [0] * 3 + [1] * 3 + [2] * 3
    same = np.repeat(np.eye(4)[:2], 3, axis=0)
    assert density.density_labels(same, 3).tolist() == [0, 0, 0, 1, 1, 1]
    assert density.density_labels(x[:2], 3).tolist() == [-1, -1]
    outlier = np.concatenate([x[:6], [[-1, -1, -1, 0]]])  # farther from both than they are from each other
    assert density.density_labels(outlier, 3).tolist() == [0, 0, 0, 1, 1, 1, -1]
    sub = np.concatenate([around([1, 0, 0, 0], 4, r, 0.001), around([1, 0.1, 0, 0], 4, r, 0.001), around([0, 0, 1, 0], 4, r, 0.001)])
    assert len(set(density.density_labels(sub, 3))) == 3 and len(set(density.density_labels(sub, 3, epsilon=0.05))) == 2


def test_clusters_follow_weighted_features_and_training(spark):
    rows = [("D", f"c{i}", [1.0, 0.0, 0.0, 0.0], "Creature" if i < 3 else "Instant", 5.0 if i < 3 else 1.0) for i in range(6)] + [("D", "none", None, "Land", 1.0), ("S", "x", [1.0, 0.0, 0.0, 0.0], "Land", 1.0)]
    df = spark.createDataFrame(rows, "deck_id string, card_id string, vec array<double>, type_line string, lift double")
    got = {(r.deck_id, r.card_id): r.cluster for r in density.clusters(df, weights={"types": 1.0, "power": 0.0}).collect()}
    assert got[("D", "c0")] == got[("D", "c2")] != got[("D", "c3")] == got[("D", "c5")] and got[("S", "x")] == -1 and ("D", "none") not in got
    drawn = density.trials(["types"], 12, seed=3)
    assert drawn == density.trials(["types"], 12, seed=3) and len(drawn) == 12
    scored = {(r.deck_id, r.trial): r.eta2 for r in density.trained(df, drawn, chunk=5).collect()}
    assert scored[("D", 0)] == pytest.approx(1.0) and len(scored) == 24
    best = {r.deck_id: r.trial for r in density.best_trials(density.trained(df, drawn)).collect()}
    assert best["S"] == 0
    with pytest.raises(KeyError):
        density.trained(df, [{"typo": 1.0}])
    density.clusters(df, weights={"typo": 0.0})


def test_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", [3.0, 4.0], [0.0, 2.0]), ("b", [0.0, 0.0], None)], "id string, v array<double>, w array<double>")
    a, b = df.select(unit(F.col("v")).alias("u"), fused(F.col("v"), F.col("w"), 1.0).alias("t"), fused(F.col("v"), F.col("w"), 0.0).alias("g"), cosine(F.col("v"), F.col("w")).alias("c")).collect()
    assert a.u == [0.6, 0.8] and a.t == pytest.approx([0.6, 0.8]) and a.g == [0, 1] and a.c == pytest.approx(0.8) and b.u == [0, 0] and b.c is None
    with pytest.raises(ValueError):
        fused(F.col("v"), F.col("w"), 1.5)
    with pytest.raises(Exception, match="different sizes: a"):
        df.filter("id = 'a'").select(same_size(F.col("v"), F.array(F.lit(1.0)), F.col("id"))).collect()
    m = mean_vectors(spark.createDataFrame([("k", [1.0, 0.0, 0.0]), ("k", [0.0, 2.0, 0.0]), ("k", None)], "k string, v array<double>"), ["k"], "v")
    assert m.first()["mean"] == pytest.approx([0.5, 1, 0])
    w = spark.createDataFrame([([1.0, 0.0], ["R"], None)], "v array<double>, colors array<string>, power string")
    assert w.select(augmented(F.col("v"), {"colors": 0.5, "power": 2.0}).alias("x")).first().x == [1, 0, 0, 0, 0, 0.5, 0, 0, 0]


def test_encoding_queue_and_fusion(spark):
    rows = spark.createDataFrame([("a", "text"), ("b", ""), ("c", None), ("d", "more")], "_id string, t string")
    enc = embedding.encoded(rows, "_id", "t", "m")
    got = {r.key: r for r in enc.collect()}
    assert set(got) == {"a", "d"} and got["a"].vec == [float(sum(map(ord, "text")) % 1000 + i) for i in range(8)]
    assert embedding.queue(rows, enc, "_id", "t", "m").count() == 0 and embedding.queue(rows, enc, "_id", "t", "m2").count() == 2
    changed = spark.createDataFrame([("a", "new")], "_id string, t string")
    assert embedding.queue(changed, enc, "_id", "t", "m").count() == 1
    text = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("d", [0.0, 0.0, 5.0])], "card_id string, vec array<double>")
    tags = spark.createDataFrame([("a", "x"), ("a", "y"), ("d", "unknown")], "card_id string, slug string")
    tv = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 2.0, 0.0])], "slug string, vec array<double>")
    f = {r.card_id: r.vec for r in embedding.fuse(text, tags, tv, 0.0).collect()}
    assert f["a"] == pytest.approx(list(np.array([0.5, 1, 0]) / np.sqrt(1.25))) and f["d"] == [0, 0, 1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_training_searches_whole_decks_with_their_words(spark, monkeypatch):
    from weftline.plans import catalogue

    seen, real = {}, density.trained

    def caught(cards, drawn, **k):
        seen.update(drawn=drawn, decks={r.deck_id for r in cards.select("deck_id").distinct().collect()}, widths=cards.select("deck_id", density.FEATURES["keywords"](k.get("vocab") or {}).alias("f")).collect())
        return real(cards, drawn[:1], **k)

    monkeypatch.setattr(density, "trained", caught)
    got = catalogue.train_weights(spark, "/root/testdata/sf0.001").collect()
    words = {r.deck_id: len([w for w in r.keywords.split(",") if w]) for r in catalogue.deck_vocab(spark, "/root/testdata/sf0.001").collect()}
    assert len(seen["drawn"]) == 50 and seen["decks"] == words.keys() and got
    assert all(len(r.f) == words[r.deck_id] for r in seen["widths"])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_cluster_profile_counts_every_card_of_a_deck(spark):
    from weftline.plans import catalogue

    d = "/root/testdata/sf0.001"
    want = {r.deck_id: r["count"] for r in catalogue.decks(spark, d).groupBy("deck_id").count().collect()}
    got: dict[str, int] = {}
    for r in catalogue.cluster_profile(spark, d).collect():
        assert (r.cluster < 0) == (r.label == "unassigned")
        got[r.deck_id] = got.get(r.deck_id, 0) + r.n_cards
    assert got == want


def _tree_row_by_row(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    dist, todo, out, at = np.full(len(u), np.inf), np.ones(len(u), bool), [], 0
    todo[0] = False
    while todo.any():
        d = np.clip(1 - u @ u[at], 0, 2)
        dist = np.where(todo & (d < dist), d, dist)
        at = int(np.where(todo, dist, np.inf).argmin())
        out.append(dist[at])
        todo[at] = False
    return np.sort(out)


@pytest.mark.parametrize("sides", [2_048, 3])
def test_spanning_tree_of_a_large_deck_is_least_and_quick(monkeypatch, sides):
    """Groups, noise, copies and zeros: the same lengths as by plain growth, in less than half its time for 10,000 cards."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 32))
    x = np.concatenate([middle[rng.integers(0, 12, 2600)] + rng.normal(size=(2600, 32)), 3 * rng.normal(size=(300, 32))])
    x = np.concatenate([x, x[:200], x[:50] * 2, np.zeros((3, 32))])
    monkeypatch.setattr(density, "SIDES", sides, raising=False)
    e = density.spanning_tree(x)
    assert len(e) == len(x) - 1 and (np.diff(e[:, 2]) >= 0).all()
    assert np.allclose(e[:, 2], np.where(_tree_row_by_row(x) < 1e-12, 0, _tree_row_by_row(x)), atol=1e-12)
    part = np.arange(len(x))
    for a, b in e[:, :2].astype(int):
        assert part[a] != part[b]
        part[part == part[a]] = part[b]
    big = middle[rng.integers(0, 12, 10_000)] + rng.normal(size=(10_000, 32))
    marks = [time.perf_counter()]
    for tree in (_tree_row_by_row, density.spanning_tree):
        assert len(tree(big)) == 9_999
        marks.append(time.perf_counter())
    assert sides == 3 or marks[2] - marks[1] < 0.5 * (marks[1] - marks[0])


def test_training_leaves_out_what_no_card_holds_and_scores_alike():
    import pandas as pd

    rng = np.random.default_rng(2)
    base = rng.normal(size=(2_500, 16))
    f = (rng.random((2_500, 40)) < 0.2) * 1.0
    f[:, 5:35] = 0
    held = density._units(pd.DataFrame({"f_types": list(f)}), ["types"])["types"]
    assert held.shape == (2_500, 10) and np.allclose((held**2).sum(axis=1), f.any(axis=1))
    whole = np.divide(f, np.linalg.norm(f, axis=1, keepdims=True), out=np.zeros_like(f), where=f.any(axis=1, keepdims=True))
    labels = [density.density_labels(np.concatenate([base, 0.7 * x], axis=1), 3) for x in (held, whole)]
    assert (labels[0] == labels[1]).all() and labels[0].max() > 0


def test_a_deck_in_pieces_has_the_clusters_of_the_whole(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 8))
    rows = []
    for deck, n in (("hot", 700), ("small", 40), ("copies", 300)):
        x = centres[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, 8))
        if deck == "copies":
            x = x[rng.integers(0, 90, n)]
        rows += [(deck, f"{deck}-{i * 7919 % n:04}", [float(v) for v in x[i]]) for i in range(n)]
    df = spark.createDataFrame(rows + [("hot", "none", None)], "deck_id string, card_id string, vec array<float>")
    label = lambda **k: {(r.deck_id, r.card_id): r.cluster for r in density.clusters(df, **k).collect()}
    for more in ({}, {"epsilon": 0.2, "least": 5}):
        want = label(**more)
        assert len(want) == 1_040 and len(set(want.values())) > 5
        assert label(whole=200, piece=100, **more) == want


def test_least_edges_are_the_tree_of_all_pairs():
    x = np.random.default_rng(3).normal(size=(60, 4))
    i, j = np.triu_indices(60, 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    e = density.least_edges(i, j, 1 - np.einsum("ij,ij->i", u[i], u[j]), 60)
    assert len(e) == 59 and np.allclose(e[:, 2], density.spanning_tree(x)[:, 2])


def test_only_heavy_decks_are_trained_by_several_tasks(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    rows = [(deck, f"{deck}{i:04}", rng.normal(size=4).tolist(), float(rng.normal()), "Creature" if rng.random() < 0.5 else "Land") for deck, n in [("hot", 200), *((f"d{j}", 12) for j in range(60))] for i in range(n)]
    df = spark.createDataFrame(rows, "deck_id string, card_id string, vec array<double>, lift double, type_line string")
    drawn = density.trials(["types"], 20, seed=2)
    taken = {}
    real = type(df.groupBy("deck_id")).applyInArrow

    def caught(grouped, run, schema):
        def counted(t: pa.Table) -> pa.Table:
            return pa.table({"deck_id": t.column("deck_id")[:1], "trial": pa.array([t.num_rows], pa.int32()), "eta2": [1.0]})

        taken.update(groups=[(r.deck_id, r.trial) for r in real(grouped, counted, schema).collect()])
        return real(grouped, run, schema)

    monkeypatch.setattr(type(df.groupBy("deck_id")), "applyInArrow", caught)
    got = {(r.deck_id, r.trial): r.eta2 for r in density.trained(df, drawn, chunk=5).collect()}
    assert len(got) == 61 * 20
    assert sorted(taken["groups"]) == sorted([("hot", 200)] * 4 + [(f"d{j}", 12) for j in range(60)])
    f = {"Creature": 0, "Land": 1}
    for deck in ("hot", "d7"):
        held = sorted((r for r in rows if r[0] == deck), key=lambda r: r[1])
        x, one = np.array([r[2] for r in held]), np.eye(2)[[f[r[4]] for r in held]]
        for i in (0, 7, 19):
            want = density.eta2(density.density_labels(np.concatenate([x, one * drawn[i]["types"]], axis=1), 3), np.array([r[3] for r in held]))
            assert got[deck, i] == pytest.approx(want)


def test_train_profile_keeps_the_labels_of_the_best_trial(spark, monkeypatch):
    """One search in one shuffle of the cards, and the clusters that the best trial's weights make; heavy decks by several tasks."""
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(5, 4))
    rows = [(deck, f"{deck}{i:04}", (middle[rng.integers(0, 5)] + 0.3 * rng.normal(size=4)).tolist(), None if deck == "bare" else float(rng.normal()), ["Creature", "Land"][int(rng.random() < 0.5)]) for deck, n in (("hot", 700), ("d", 40), ("bare", 12), ("two", 2)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("d", "none", None, 1.0, "Land")], "deck_id string, card_id string, vec array<float>, lift double, type_line string")
    drawn = density.trials(["types"], 12, seed=5)
    best = density.best_trials(density.trained(df, drawn, chunk=3))
    want = {(r.deck_id, r.card_id): r.cluster for r in density.trained_clusters(df, best, drawn).collect()}
    calls, real = [], type(df.groupBy("deck_id")).applyInArrow
    monkeypatch.setattr(type(df.groupBy("deck_id")), "applyInArrow", lambda *a: calls.append(a) or real(*a))
    got = density.best_clusters(df, drawn, chunk=3).collect()
    assert len(calls) == 1 and len(got) == 754 and {(r.deck_id, r.card_id): r.cluster for r in got} == want
    assert len({v for (deck, _), v in want.items() if deck == "hot"}) > 3
    with pytest.raises(ValueError, match="nothing to train on"):
        density.best_clusters(df.filter("deck_id = 'bare'"), drawn)


def test_a_tree_compares_all_rows_once_and_keeps_few_pairs(monkeypatch):
    """Groups, near copies and noise: what is listed stays some rows' worth, and the tree is the least one."""
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(4, 16))
    x = np.concatenate([middle[rng.integers(0, 2, 1500)] * (1 + 1e-9 * rng.normal(size=(1500, 16))), middle[rng.integers(0, 4, 1200)] + rng.normal(size=(1200, 16)), rng.normal(size=(300, 16))])
    monkeypatch.setattr(density, "HELD", 2)
    held, real = [], density._exact
    monkeypatch.setattr(density, "_exact", lambda u, a, b: held.append(len(a)) or real(u, a, b))
    e = density.spanning_tree(x)
    lengths = _tree_row_by_row(x)
    assert len(e) == len(x) - 1 and np.allclose(e[:, 2], np.where(lengths < 1e-12, 0, lengths), atol=1e-12)
    assert 0 < max(held) < 2 * len(x) + (1 << 20) + density.ROWS * density.COLS


def test_a_large_deck_is_trained_in_pieces(spark, monkeypatch):
    """No task holds more than two pieces of a deck; scores and clusters are those of whole decks."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    middle = rng.normal(size=(6, 4))
    rows = [(deck, f"{deck}{i * 7919 % n:04}", (middle[rng.integers(0, 6)] + 0.3 * rng.normal(size=4)).tolist(), None if i % 9 == 0 else float(rng.normal()), ["Creature", "Land"][int(rng.random() < 0.5)]) for deck, n in (("hot", 700), ("warm", 330), ("d", 40)) for i in range(n)]
    rows += [("hot", f"hot-copy{i}", rows[i][2], 1.0, rows[i][4]) for i in range(20)]
    df = spark.createDataFrame([*rows, ("hot", "none", None, 1.0, "Land")], "deck_id string, card_id string, vec array<float>, lift double, type_line string")
    drawn = density.trials(["types"], 12, seed=5)
    score = lambda **k: {(r.deck_id, r.trial): r.eta2 for r in density.trained(df, drawn, **k).collect()}
    label = lambda **k: {(r.deck_id, r.card_id): r.cluster for r in density.best_clusters(df, drawn, **k).collect()}
    want, names = score(), label()
    assert len(want) == 36 and len(names) == 1_090 and len(set(names.values())) > 3
    held, real = [], type(df.groupBy("deck_id")).applyInArrow

    def caught(grouped, run, schema):
        def counted(t: pa.Table) -> pa.Table:
            return pa.table({"n": pa.array([t.num_rows if "vec" in t.column_names else 0])})

        held.extend(r.n for r in real(grouped, counted, "n long").collect())
        return real(grouped, run, schema)

    monkeypatch.setattr(type(df.groupBy("deck_id")), "applyInArrow", caught)
    assert score(whole=200, piece=100) == pytest.approx(want)
    assert max(held) == 180 and label(whole=200, piece=100) == names


def test_memory_of_a_tree_is_some_copies_of_its_rows():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(6_000, 100))
    x[:, :60] = np.round(x[:, :60] / 3)
    tracemalloc.start()
    try:
        e = density.spanning_tree(x, own=True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(e) == 5_999 and peak < 4 * x.nbytes
