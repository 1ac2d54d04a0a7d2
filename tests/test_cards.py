import json
from datetime import datetime as dt

import pytest
from weftline.functions import features as fx
from weftline.functions import text as tx
from weftline.operators import cards as cx
from weftline.operators import tags as tg
from weftline.sources import files
from weftline.sources.store import Store, health

BOLT = {"id": "b", "oracle_id": "o1", "name": "Bolt", "mana_cost": "{R}", "type_line": "Instant", "oracle_text": "3 damage", "keywords": [], "colors": ["R"], "color_identity": ["R"], "cmc": 1.0}
TWO = {"id": "d", "oracle_id": "o2", "name": "Front // Back", "mana_cost": "", "type_line": "A // B", "card_faces": [{"name": "Front", "mana_cost": "{2}{G}", "oracle_text": "one"}, {"name": "Back", "mana_cost": None, "oracle_text": "two"}]}
SAME = {"id": "s", "name": "Same // Same", "oracle_text": "", "card_faces": [{"name": "Same"}, {"name": "Same"}]}


@pytest.fixture(scope="module")
def cards(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("bulk") / "cards.jsonl"
    at.write_text("\n".join([json.dumps(BOLT), "", json.dumps(TWO), json.dumps(SAME), json.dumps({"name": "no id"})]))
    return cx.project(files.json_lines(spark, str(at), files.CARD_BULK))


def test_projection(cards):
    got = {r["_id"]: r for r in cards.collect()}
    assert set(got) == {"b", "d", "s"} and cards.columns == ["_id", *cx.OWNED]
    assert got["d"].names == ["front // back", "front", "back"] and got["s"].names == ["same // same", "same"]
    assert got["d"].mana_cost == "{2}{G} // " and got["d"].oracle_text == "one\n---\ntwo" and got["s"].oracle_text == ""
    assert got["d"].cmc == 0.0 and got["d"].keywords == [] and got["b"].mana_cost == "{R}"
    assert got["s"].oracle_text_sha == "e3b0c44298fc1c14" and len(got["b"].oracle_text_sha) == 16


def test_merge_classes_and_table(spark):
    s = "_id string, oracle_text_sha string, name string, card_vector array<float>, tags array<string>"
    stored = spark.createDataFrame([("same", "1", "n", [1.0], ["t"]), ("text", "1", "n", [1.0], ["t"]), ("old", "1", None, [1.0], ["t"]), ("nosha", None, "n", [1.0], ["t"]), ("gone", "1", "n", [1.0], ["t"])], s)
    new = spark.createDataFrame([("same", "1", "n2"), ("text", "2", "n2"), ("old", "1", "n2"), ("nosha", "1", "n2"), ("new", "1", "n2")], "_id string, oracle_text_sha string, name string")
    st = cx.merge_status(new, stored, "_id", "oracle_text_sha", stored["name"].isNull())
    assert {r["_id"]: r.status for r in st.collect()} == {"same": "unchanged", "text": "changed", "old": "patched", "nosha": "changed", "new": "new"}
    after = {r["_id"]: r for r in cx.merged(stored, st, "_id", ["oracle_text_sha", "name"]).collect()}
    assert after["same"].name == "n" and after["text"].name == "n2" and after["text"].card_vector is None and after["text"].tags == ["t"]
    assert after["old"].card_vector == [1.0] and after["old"].name == "n2" and after["gone"].name == "n" and after["new"].name == "n2"


@pytest.mark.parametrize(
    "line,name",
    [("4x Lightning Bolt", "Lightning Bolt"), ("  1  Sol Ring  ", "Sol Ring"), ("SB: 1 Force of Will (EMA) 49", "Force of Will"), ("1 Front // Back", "Front // Back"), ("# note", None), ("", None), ("   ", None), (" 2x\tSol Ring ", "Sol Ring"), ("3 (ABC) 1", None), (None, None)],
)
def test_list_lines(spark, line, name):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(tx.deck_name(F.col("line"))).first()[0] == name


def test_slugs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Atraxa, Praetors' Voice",), ("Urza’s  Saga",), (None,)], "n string")
    assert [r[0] for r in df.select(tx.slug(F.col("n"))).collect()] == ["atraxa-praetors-voice", "urzas-saga", None]
    with pytest.raises(Exception, match="no slug"):
        spark.createDataFrame([("!!!",)], "n string").select(tx.slug(F.col("n"))).collect()


def test_feature_vectors(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("{X}{3}{W/U}{W/P}{G}{S}{10}{?}", "Legendary Creature — Human Wizard // Land — Human", "1+*", "*"), (None, None, None, " -2 ")], "m string, t string, p string, q string")
    a, b = df.select(fx.mana_vector(F.col("m")).alias("m"), fx.type_vector(F.col("t"), ["Human", "Elf"]).alias("t"), fx.stat_vector(F.col("p")).alias("p"), fx.stat_vector(F.col("q")).alias("q")).collect()
    assert a.m == [13, 0, 0, 0, 0, 1, 1, 1, 1, 1] and b.m == [0.0] * 10
    hot = [i for i, x in enumerate(a.t) if x]
    assert hot == [fx.SUPERTYPES.index("Legendary"), 8 + fx.TYPES.index("Creature"), 8 + fx.TYPES.index("Land"), 24] and len(a.t) == 26 and not any(b.t)
    assert (a.p, a.q, b.p, b.q) == ([1, 1], [0, 1], [0, 0], [-2, 1])


def test_lists_resolve_once_and_first(spark, cards):
    lines = spark.createDataFrame([("d", 0, "1 bolt"), ("d", 1, "2x BOLT"), ("d", 2, "Back"), ("d", 3, "Front"), ("d", 4, "Nothing"), ("e", 0, "same")], "deck_id string, pos long, line string")
    named = cx.parsed_lists(lines, "deck_id", ["pos"])
    assert sorted(map(tuple, named.collect())) == [("d", 0, "bolt"), ("d", 2, "Back"), ("d", 3, "Front"), ("d", 4, "Nothing"), ("e", 0, "same")]
    got = sorted((r.deck_id, r.pos, r.card_id) for r in cx.resolved(named, cards).collect())
    assert got == [("d", 0, "b"), ("d", 2, "d"), ("d", 4, None), ("e", 0, "s")]
    assert {r.name: (r.n_matches, r.first_id) for r in cx.lookup(named, cards).collect()}["Nothing"] == (0, None)


def test_pages(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "name string")
    assert [r.name for r in cx.page(df, ["name"], 2).collect()] == [None, "a"] and cx.page(df, ["name"], 0).count() == 3


def test_tag_catalogue_inversion_and_attachment(spark):
    bulk = spark.createDataFrame([("1", "removal", "Removal", None, None, None, ["2", "9", "3"], None, None), ("2", "spot", "Spot", None, "d", ["1"], None, ["x"], [("o1", None, None), ("o1", None, None), ("o3", None, None)]), ("3", "mass", "Mass", None, None, ["1"], [], None, [("o1", None, None)])], files.TAG_BULK)
    cat = {r["_id"]: r for r in tg.catalogue(bulk).collect()}
    assert cat["removal"].child_slugs == ["spot", "mass"] and cat["spot"].parent_slugs == ["removal"] and cat["mass"].aliases == []
    from pyspark.sql import functions as F

    t = bulk.select("slug", F.explode("taggings").alias("t")).select("slug", F.col("t.oracle_id").alias("oracle_id"))
    want = tg.inverted(t, "oracle_id", "slug")
    assert {r.oracle_id: r.slugs for r in want.collect()} == {"o1": ["mass", "spot"], "o3": ["spot"]}
    cards = spark.createDataFrame([("a", "o1", ["mass", "spot"], [1.0]), ("b", "o2", ["old"], [1.0]), ("c", None, None, [1.0])], "_id string, oracle_id string, tags array<string>, card_vector array<float>")
    st = tg.attach_status(want, cards)
    assert tuple(tg.attach_counts(st).first()) == (2, 1, 1, 1, 1)
    after = {r["_id"]: (r.tags, r.card_vector) for r in tg.attached(cards, st).collect()}
    assert after == {"a": (["mass", "spot"], [1.0]), "b": ([], None), "c": ([], [1.0])}


def test_store_meta_health_and_export(spark, tmp_path, cards, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    assert health(store)[1] == 1 and health(store)[0][1][2] == "SKIP"
    store.set("snapshot", "2024-01-01")
    store.set("alpha", 0.6)
    store.set("snapshot", "2024-02-01")
    assert (store.get("snapshot"), store.get("alpha"), store.get("none")) == ("2024-02-01", "0.6", None)
    store.replace("cards", cards)
    store.replace("tags", spark.createDataFrame([("t", 1)], "_id string, a int"))
    store.upsert("tags", spark.createDataFrame([("t", 5), ("u", 6)], "_id string, b int"), "_id")
    assert sorted(map(tuple, store.read("tags").select("_id", "a", "b").collect())) == [("t", 1, 5), ("u", None, 6)]
    rows, code = health(store)
    assert code == 0 and [r[0] for r in rows[:4]] == ["Connectivity", "Database", "Lookups", "Table cards"]
    assert rows[1][1:] == (True, f"3 table(s) in {store.root}") and rows[2][1:] == (True, "names, oracle_id on cards") and rows[3] == ("Table cards", True, "3")
    store.replace("cards", cards.drop("names"))
    assert health(store)[1] == 1 and ("Lookups", False, "missing: names") in health(store)[0]
    monkeypatch.delenv("WEFTLINE_ROOT", raising=False)
    with pytest.raises(RuntimeError, match="WEFTLINE_ROOT"):
        Store.from_env(spark)
    hits = spark.createDataFrame([("Bolt", "b", "o1", "Bolt", "Instant", "3 damage"), ("Nope", None, None, None, None, None)], "asked string, scryfall_id string, oracle_id string, name string, type_line string, oracle_text string")
    missing = files.export_json(hits, "asked", str(tmp_path / "x/out.json"), cx.EXPORTED)
    out = json.loads((tmp_path / "x/out.json").read_text())
    assert missing == 1 and out["Nope"] == [] and out["Bolt"][0]["type_line"] == "Instant"


def test_sources(spark, tmp_path):
    with pytest.raises(RuntimeError, match="oracle_cards"):
        files.bulk_entry(spark.createDataFrame([("x", "u")], "type string, uri string"), "oracle_cards")
    (tmp_path / "l.txt").write_text("1 A\n\n2 B\n")
    got = [tuple(r) for r in files.list_lines(spark, str(tmp_path / "l.txt"), ["C"]).orderBy("src", "pos").collect()]
    assert got == [(0, 0, "1 A"), (0, 1, ""), (0, 2, "2 B"), (0, 3, ""), (1, 0, "C")]
    view = {"id": "a", "name": "A", "lift": 1.5, "num_decks": 3}
    (tmp_path / "some-commander.json").write_text(json.dumps({"container": {"json_dict": {"cardlists": [{"header": "h", "tag": "t", "cardviews": [view]}]}}}))
    row = files.payloads(spark, f"{tmp_path}/*.json").first()
    assert row.slug == "some-commander" and row.payload.container.json_dict.cardlists[0].cardviews[0].lift == 1.5
    assert tx.split_option(None, ["d"]) == ["d"] and tx.split_option("") == [] and tx.split_option(" a, ,b") == ["a", "b"]


def test_stream_merges_batches(spark, tmp_path):
    from weftline.streaming.ingest import merge_stream

    schema = "_id string, oracle_text_sha string, name string, updated_at timestamp_ntz"
    store = Store(spark, f"file://{tmp_path}/s")
    owned = ["oracle_text_sha", "name"]
    for n, rows in enumerate([[("a", "1", "x", dt(2024, 1, 1)), ("a", "0", "w", dt(2023, 1, 1))], [("a", "2", "y", dt(2024, 2, 1)), ("b", "1", "z", dt(2024, 2, 1))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = merge_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), store, f"{tmp_path}/ck", owned=owned)
        q.processAllAvailable()
        q.stop()
    assert sorted(map(tuple, store.read("cards").select("_id", "oracle_text_sha", "name").collect())) == [("a", "2", "y"), ("b", "1", "z")]
