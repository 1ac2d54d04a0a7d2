import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from weftline.operators import signals
from weftline.plans import flows
from weftline.sources import files
from weftline.sources.store import Store

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def write(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def test_from_files_to_vectors(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    cards = [{"id": "a", "oracle_id": "o1", "name": "Bolt", "oracle_text": "burn"}, {"id": "b", "oracle_id": "o2", "name": "Wrath", "oracle_text": "sweep"}, {"id": "a", "oracle_id": "o1", "name": "Bolt", "oracle_text": "burn"}]
    cat = lambda kind, stamp, path: spark.createDataFrame([("other", "x", "y"), (kind, path, stamp)], "type string, download_uri string, updated_at string")
    read = lambda p: files.json_lines(spark, p, files.CARD_BULK)
    one = write(tmp_path / "c1.jsonl", cards)
    assert flows.import_cards(store, cat("oracle_cards", "s1", one), read) == {"new": 2, "changed": 0, "patched": 0, "unchanged": 0}
    assert flows.import_cards(store, cat("oracle_cards", "s1", one), read) is None

    tags = [{"id": "1", "slug": "removal", "label": "Removal", "child_ids": ["2"], "taggings": []}, {"id": "2", "slug": "spot", "label": "Spot", "description": "one", "parent_ids": ["1"], "taggings": [{"oracle_id": "o1"}, {"oracle_id": "zz"}]}]
    tread = lambda p: files.json_lines(spark, p, files.TAG_BULK)
    tfile = write(tmp_path / "t.jsonl", tags)
    counts, code = flows.import_tags(store, cat("oracle_tags", "t1", tfile), tread)
    assert (counts.n_matched, counts.n_empty, counts.n_unmatched, code) == (1, 1, 1, 0)
    assert flows.import_tags(store, cat("oracle_tags", "t1", tfile), tread) == (None, 0)

    assert flows.embed_cards(store, "m") == 2 and flows.embed_cards(store, "m") == 0 and flows.embed_cards(store, "m", refresh=True) == 2
    assert flows.embed_tags(store, "m", limit=1) == 1 and flows.embed_tags(store, "m") == 1
    with pytest.raises(ValueError):
        flows.fuse(store, "m", 1.5)
    assert flows.fuse(store, "m", 0.5) == 2 and flows.fuse(store, "m", 0.5) == 0 and flows.fuse(store, "m", 0.6) == 2

    cards[1]["oracle_text"] = "sweep all"
    got = flows.import_cards(store, cat("oracle_cards", "s2", write(tmp_path / "c2.jsonl", cards)), read)
    assert got == {"new": 0, "changed": 1, "patched": 0, "unchanged": 1}
    assert flows.embed_cards(store, "m") == 1 and flows.fuse(store, "m", 0.6) == 1

    text, code = flows.show_card(store, "BOLT")
    assert code == 0 and text.startswith("Bolt  [a]") and "tags: spot" in text and flows.show_card(store, "none")[1] == 1
    assert flows.show_tag(store, "spot")[0] == "spot  (Spot)\n    description : one\n    parents     : removal\n    children    : (none)\n    aliases     : (none)\n    cards tagged: 1" and flows.show_tag(store, "none")[1] == 1
    assert flows.show_list(store, limit=1)[0].endswith("showing 1 of 2") and flows.show_list(store, limit=0)[0].endswith("showing 2 of 2") and flows.show_list(store, tag="none")[1] == 1
    assert "with tags: 1 (50.0 %)" in flows.show_stats(store)
    told = flows.export_cards(store, ["BOLT", "none", "Wrath", "BOLT"], str(tmp_path / "out" / "x.json"))
    assert told == {"missing": ["none"], "ambiguous": {}, "entries": 2}
    assert json.loads((tmp_path / "out" / "x.json").read_text())["BOLT"][0]["scryfall_id"] == "a"


def test_packed_lines_under_any_name(spark, tmp_path):
    import gzip

    (tmp_path / "odd.jsonl").write_bytes(gzip.compress(b'{"id": "a"}\n\n{"id": "b"}\n'))
    (tmp_path / "plain.jsonl").write_text('{"id": "c"}\n')
    got = lambda at: sorted(r.id for r in files.json_lines(spark, str(tmp_path / at), "id string").collect())
    assert got("odd.jsonl") == ["a", "b"] and got("plain.jsonl") == ["c"] and got("*.jsonl") == ["a", "b", "c"]
    (tmp_path / "bad.jsonl").write_bytes(gzip.compress(b"{"))
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


def test_replaced_table_keeps_its_last_version_and_settings_file(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    frame = lambda n: spark.createDataFrame([(n,)], "n int")
    store.replace("t", frame(1))
    held = store.read("t")
    store.replace("t", frame(2))
    assert held.first().n == 1 and store.read("t").first().n == 2
    store.replace("t", frame(3))
    assert store.read("t").first().n == 3 and len([x for x in (tmp_path / "s" / "t").iterdir() if x.is_dir()]) == 2
    (tmp_path / ".env").write_text(f"# where\nexport WEFTLINE_ROOT='{store.root}'\n")
    monkeypatch.delenv("WEFTLINE_ROOT", raising=False)
    monkeypatch.chdir(tmp_path)
    assert Store.from_env(spark).root == store.root
    (tmp_path / ".env").unlink()
    with pytest.raises(RuntimeError, match="WEFTLINE_ROOT"):
        Store.from_env(spark)


def test_signals_cache_and_ties(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    view = lambda i, lift, name="N", **kw: {"id": i, "name": name, "lift": lift, "num_decks": 3, **kw}
    body = json.dumps({"container": {"json_dict": {"cardlists": [{"cardviews": [view("a", 1.6), view("b", 2.0, "first", potential_decks=6), view("c", None)]}, {"cardviews": [view("a", 1.7), view("b", 2.0, "second"), view("", 9.0)]}]}}})
    asked = []
    fetch = lambda slug: asked.append(slug) or body
    got = {r.card_id: r for r in flows.commander_signals(store, "x", fetch, NOW).collect()}
    assert set(got) == {"a", "b"} and got["a"].lift == 1.7 and got["b"].name == "first" and got["b"].inclusion == 0.5 and got["a"].inclusion == 0.0 and got["a"].synergy == 0.0
    flows.commander_signals(store, "x", fetch, NOW + timedelta(days=6))
    assert len(asked) == 1
    flows.commander_signals(store, "x", fetch, NOW + timedelta(days=7))
    flows.commander_signals(store, "x", fetch, NOW + timedelta(days=8), force=True)
    assert len(asked) == 3


def test_freshness():
    assert signals.is_fresh("2024-05-30T00:00:00", NOW, 7) and not signals.is_fresh("2024-05-25T00:00:00+00:00", NOW, 7)
    assert not signals.is_fresh(None, NOW, 7) and not signals.is_fresh("soon", NOW, 7)
    assert (signals.ttl_days(None), signals.ttl_days("-3"), signals.ttl_days("2")) == (7, 0, 2)
    with pytest.raises(ValueError):
        signals.ttl_days("week")


def test_render():
    rows = [Row(label="ramp", n_cards=3, tags="a,b,c", constituents="ramp,removal", n_unassigned=2)]
    assert flows.render_profile(rows, {"ramp": ["Z", "A"]}, 2) == "theme 'ramp'  (3 tags, 3 cards)  [merged: removal]\n  tags : a, b, (+1 more)\n  cards: A, Z\n2 card(s) unassigned"
    assert flows.render_profile([]).startswith("(no themes)")
