import json

import pytest
from weftline.plans import profile as P
from weftline.sources.store import Store

TYPES = {"type_line": "Creature", "mana_cost": "{1}", "keywords": [], "colors": [], "color_identity": [], "power": None, "toughness": None}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    arrays, words = "array<string>", "string"
    schema = "_id string, name string, names array<string>, tags array<string>, " + ", ".join(f"{k} {arrays if isinstance(v, list) else words}" for k, v in TYPES.items())
    cards = [("bolt", "Bolt", ["bolt"], ["spot-removal"]), ("wrath", "Wrath", ["wrath"], ["mass-removal"]), ("elf", "Elf", ["elf"], ["mana-dork", "odd"]), ("both", "Both", ["both"], ["spot-removal", "mana-dork"]), ("lone", "Lone", ["lone"], ["odd"]), ("bolt2", "Bolt", ["bolt"], ["mana-dork"])]
    more = [{**TYPES, "type_line": "Creature — Elf" if i % 2 else "Instant"} for i in range(len(cards))]
    s.replace("cards", spark.createDataFrame([(*c, *m.values()) for c, m in zip(cards, more)], schema))
    tags = [("removal", [], ["spot-removal", "mass-removal"]), ("ramp", [], ["mana-dork", "rock"]), ("cycle", [], ["odd", "rock"]), ("spot-removal", ["removal"], []), ("mass-removal", ["removal"], []), ("mana-dork", ["ramp"], []), ("rock", ["ramp", "cycle"], []), ("odd", ["cycle"], [])]
    s.replace("tags", spark.createDataFrame([(a, None, None, b, c, []) for a, b, c in tags], "_id string, label string, description string, parent_slugs array<string>, child_slugs array<string>, aliases array<string>"))
    axis = {"removal": [1.0, 0.0, 0.0], "spot-removal": [1.0, 0.0, 0.0], "mass-removal": [1.0, 0.0, 0.0], "ramp": [0.0, 1.0, 0.0], "mana-dork": [0.0, 1.0, 0.0]}
    vec = "key string, text_sha string, model string, vec array<float>"
    s.replace("tags_vec", spark.createDataFrame([(k, "x", "hash-8", v) for k, v in axis.items()], vec))
    s.replace("cards_vec", spark.createDataFrame([("both", "x", "hash-8", [0.1, 0.9, 0.0]), ("both", "x", "other", [1.0, 0.0, 0.0])], vec))
    near = {"bolt": [1.0, 0.0, 0.0], "wrath": [1.0, 0.01, 0.0], "both": [1.0, 0.02, 0.0], "elf": [0.0, 1.0, 0.0], "bolt2": [0.0, 1.0, 0.01], "lone": [0.0, 1.0, 0.02]}
    s.replace("card_vec", spark.createDataFrame([(k, "x", v) for k, v in near.items()], "card_id string, input_sig string, vec array<double>"))
    return s


OPTIONS = ["--min-coverage", "1", "--max-coverage", "100"]


def test_theme_run_from_a_list_file(store, tmp_path, capsys):
    (tmp_path / "deck.txt").write_text("# mine\n4x Bolt\nWrath\n1 Elf\nSB: 1 Both (ABC) 4\nLone\nNo Such Card\nbolt\n")
    got = P.profile(store, str(tmp_path / "deck.txt"), [], P.options_of(P.parser().parse_args(["x", *OPTIONS])))
    assert got.card_ids == ["bolt", "both", "elf", "lone", "wrath"] and got.missing == ["No Such Card"]
    assert got.universe == ["mana-dork", "mass-removal", "odd", "spot-removal"] and got.unassigned == ["lone"] and got.noise == ["odd"]
    held = {c.label: c for c in got.clusters}
    assert held["removal"].card_ids == ["bolt", "wrath"] and held["ramp"].card_ids == ["both", "elf"] and held["ramp"].tags == ["mana-dork"]
    assert held["removal"].centroid == pytest.approx([1, 0, 0]) and held["ramp"].constituents == ["ramp"]
    assert [c.label for c in got.clusters] == ["ramp", "removal"]  # equally wide, so by name
    assert P.main([*OPTIONS, "-f", str(tmp_path / "deck.txt"), "--limit", "1"], store) == 0
    out = capsys.readouterr().out
    assert "resolved 5 unique cards (1 missing)\n  missing: No Such Card\ntag universe: 4 unique tags\n2 theme(s) matched, 1 card(s) unassigned, 1 tag(s) outside any theme" in out
    assert "  cards: Bolt, (+1 more)" in out and "  cards: Both, (+1 more)" in out and out.endswith("unassigned cards: Lone\nnoise tags: odd\n")


def test_cluster_run_and_blocklist(store):
    names = ["Bolt", "Wrath", "Both", "Elf", "Lone"]
    got = P.profile(store, None, names, P.Options("cluster", least=2))
    assert [c.card_ids for c in got.clusters] == [["bolt", "both", "wrath"], ["elf", "lone"]] and got.clusters[0].label == "removal" and got.clusters[1].label == "ramp"
    assert got.clusters[0].centroid == pytest.approx([1, 0.01, 0], abs=1e-3) and not got.unassigned
    got = P.profile(store, None, names, P.Options("cluster", least=2, blocked=["removal", "ramp", "cycle"]))
    assert [c.label for c in got.clusters] == ["cluster-0", "cluster-1"]


def test_training_run(store, capsys):
    lifts = {"bolt": 5.0, "both": 5.0, "wrath": 1.0, "elf": 5.0, "lone": 1.0}
    views = [{"id": k, "name": k, "lift": v, "num_decks": 3} for k, v in lifts.items()]
    body = json.dumps({"container": {"json_dict": {"cardlists": [{"cardviews": views}]}}})
    names = ["Bolt", "Wrath", "Both", "Elf", "Lone"]
    assert P.main([*names, "--mode", "cluster", "--train", "--commander", "The Boss", "--train-trials", "4", "--train-knobs", "types", "--cluster-min-size", "2"], store, lambda slug: body) == 0
    assert "weights: types=" in capsys.readouterr().out
    with pytest.raises(ValueError, match="nothing to train on"):
        P.profile(store, None, ["Wrath"], P.Options("train", commander="Nobody"), lambda slug: body.replace("wrath", "w"))
    with pytest.raises(SystemExit):
        P.main(["Bolt", "--train"], store)
    with pytest.raises(SystemExit):
        P.main([], store)
