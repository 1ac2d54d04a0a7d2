import os
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from weftline.llm import packing as P
from weftline.llm.canonical import ALIKE, Forms, alike_classes, alike_pairs, canonical, canonical_texts, look_alikes
from weftline.llm.mixing import Mix
from weftline.llm.tokens import VOCABULARY, encoder, sized

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files here")
DOCS = "doc_id long, text string, source string, size int, container string, canonical string, n_tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", 3) for i, t, s in rows], DOCS)


# --- canonical forms ---


def whole(text):
    """The same form without segments: every character shown, then composed."""
    return unicodedata.normalize("NFC", "".join(map(Forms().shown, text)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aeoо́̈​­ﬁАЕ- \n"))))
def test_segments_equal_whole_normalization_and_are_stable(text):
    once = canonical(text)
    assert once == whole(text)
    assert canonical(once) == once


def test_looks():
    same = [("café", "café"), ("ｄｅ Ｆ１", "de F1"), ("ﬁre", "fire"), ("a b　c", "a b c"), ("ho​st­s⁠", "hosts"), ("Рaсе", "Pace"), ("e‑toll", "e-toll"), ("ї", "ï"), ("a​́", "á"), ("x\r\ny", "x\ny"), ("﻿", "")]
    for a, b in same:
        assert canonical(a) == canonical(b), (a, b)
    for a, b in [("Cafe", "cafe"), ("cafe", "café"), ("x2", "x²"), ("a.", "a"), ("a  b", "a b"), ("l", "1"), ("O", "0"), ("й", "и"), ("–", "-"), ("&amp;", "&")]:
        assert canonical(a) != canonical(b), (a, b)
    assert all(len(v) == 1 for v in ALIKE.values())


def test_the_public_table_of_look_alikes(spark):
    table = look_alikes(spark)
    form = Forms(table).canonical
    pairs = {0x3B1: "a", 0x3C1: "p", 0x131: "i", 0x4CF: "i", 0x13AA: "A", 0xA4EE: "A", 0x2C9F: "o", 0x1D0F: "o", 0x3F9: "C", 0x50C: "G", 0x2212: "-", 0x406: "I", 0x430: "a"}
    assert {cp: form(chr(cp)) for cp in pairs} == pairs
    # Look-alikes keep their case, and digits are never taken for letters.
    assert all(v.isupper() == k.isupper() for k, v in table.items() if v.isalpha() and k.isalpha() and (k.isupper() or k.islower()))
    assert not any(v.isdigit() for v in table.values()) and not any(k.isascii() for k in table)
    assert all(form(form(k)) == form(k) for k in table)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aÀαо́̈​ﬁ한한 кот- \n"), max_size=40))
def test_segments_are_spliced_as_whole(text):
    forms = Forms()
    assert forms.canonical(text) == unicodedata.normalize("NFC", "".join(map(forms.shown, text)))


def test_pairs_with_copies_nulls_and_long_texts(spark):
    rows = [(1, "bump", None), (2, "bump", None), (3, "bu​mp", None), (4, None, None), (5, "", None), (6, "​", None), (7, "x" * 200_000, None), (8, "х" * 200_000, None), (9, "other", None), (None, "bump", None)]
    got = sorted(map(tuple, alike_pairs(docs(spark, rows), "doc_id", "text").collect()))
    assert got == [(1, 3), (2, 3), (5, 6), (7, 8)]
    assert alike_pairs(docs(spark, []), "doc_id", "text").collect() == []
    forms = {r.doc_id: r.canonical for r in canonical_texts(docs(spark, rows), "doc_id", "text").collect()}
    assert forms[3] == "bump" and 4 not in forms and forms[6] == ""
    classes = {r.doc_id: (r.class_id, r.n_docs, r.n_texts) for r in alike_classes(docs(spark, rows), "doc_id", "text").collect()}
    assert classes == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 5: (5, 2, 2), 6: (5, 2, 2), 7: (7, 2, 2), 8: (7, 2, 2)}
    assert alike_classes(docs(spark, []), "doc_id", "text").collect() == []


# --- packing ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_is_valid_and_bounded(sizes):
    s = np.array(sizes, np.int64)
    where = P.best_fit_decreasing(s, 20)
    fill = np.bincount(where, weights=s) if len(s) else np.zeros(0)
    assert (fill <= 20).all() and P.lower_bound(s, 20) <= len(fill)
    # best fit decreasing, done plainly
    rooms: list[int] = []
    for x in sorted(sizes, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(20 - x)
    assert len(rooms) == len(fill)


def test_bounds_beat_the_plain_one():
    assert P.lower_bound(np.array([11] * 7), 20) == 7
    assert P.lower_bound(np.array([7] * 9), 20) == 5  # three of them do not fit into one
    assert P.lower_bound(np.zeros(0, np.int64), 20) == 0


@needs_vocabulary
@pytest.mark.parametrize("containers", [512, 2])
def test_packing_keeps_everything_once(spark, containers):
    r = random.Random(4)
    rows = [(i, " ".join(["word"] * r.randint(1, 90)), "s") for i in range(400)] + [(1000, "word " * 1000, "s"), (1001, None, "s"), (1002, "", "s"), (None, "word", "s"), (1003, "word " * 64, "s")]
    d = docs(spark, rows)
    packing = P.packed(d, "doc_id", "text", capacity=64, containers=containers)
    placed = packing.places.collect()
    told = P.packing_report(packing, 64).first()
    assert told.n_containers == len({p.container for p in placed}) >= told.least_containers and told.certified == (told.n_containers == told.least_containers)
    parts = packing.partitions.collect()
    assert told.n_partitions == len(parts) > 0 and all(p.bins >= p.bound and p.certified == (p.bins == p.bound) for p in parts)
    n = {x.doc_id: x.n_tokens for x in sized(d, "doc_id", "text").collect() if x.doc_id is not None}
    got: dict[int, int] = {}
    fill: dict[str, int] = {}
    for p in placed:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.n_tokens
        fill[p.container] = fill.get(p.container, 0) + p.n_tokens
    assert got == {k: v for k, v in n.items() if v}
    assert max(fill.values()) <= 64
    assert {p.doc_id for p in placed if p.piece > 0} == {k for k, v in n.items() if v > 64}
    assert len({(p.doc_id, p.piece) for p in placed}) == len(placed)
    assert len(fill) <= -(-sum(n.values()) // 64) * 1.03 + 1
    empty = P.packed(docs(spark, []), "doc_id", "text")
    assert empty.places.collect() == [] and P.packing_report(empty).first().n_containers == 0


@needs_vocabulary
def test_tokens_round_trip():
    enc = encoder(VOCABULARY)
    for t in ["plain text, 12 words!", "Карти й колоди", "a" * 30_000, " \n\t "]:
        assert enc.decode(enc.encode_ordinary(t)) == t


# --- mixing ---

TARGETS = "source string, target_share double, max_repeats int, doc_id long"


def targets(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], TARGETS)


@needs_vocabulary
def test_shares_repeats_and_short_sources(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["word"] * r.randint(1, 60)), ["Big", " big ", "BIG", "mid", "small", "tiny", "unlisted", None][min(7, int(r.expovariate(0.45)))]) for i in range(3000)]
    rows += [(5000, None, "mid"), (5001, "", "mid"), (None, "word", "mid")]
    want = [("big", 0.3, 1), ("mid", 0.3, 4), ("small", 0.2, 4), ("tiny", 0.15, 1), ("absent", 0.05, 3), (None, 0.5, 1)]
    m = Mix(docs(spark, rows), targets(spark, want))
    rep = {x.source: x for x in m.report().collect()}
    assert {s for s, x in rep.items() if x.short} == {s for s, x in rep.items() if x.own_tokens * x.max_repeats < x.target_share * m.total}
    assert rep["absent"].short and rep["tiny"].short and {x.source for x in m.shorts().collect()} == {"absent", "tiny"} | {s for s, x in rep.items() if x.short}
    for s, x in rep.items():
        assert x.met != x.short
        if not x.short:
            assert abs(x.mix_tokens - x.target_share * m.total) <= 0.01 * x.target_share * m.total + 60
        else:
            assert x.mix_tokens == x.own_tokens * x.max_repeats
    assert abs(sum(x.actual_share for x in rep.values()) - 1) < 1e-9
    got = m.copies().collect()
    cap = {s: c for s, _, c in want}
    assert all(1 <= c.copies <= cap[c.source] for c in got) and len({c.doc_id for c in got}) == len(got)


@needs_vocabulary
def test_empty_tables_and_like_lengths(spark):
    assert Mix(docs(spark, []), targets(spark, [("a", 1.0, 1)])).copies().collect() == []
    assert Mix(docs(spark, [(1, "word", "a")]), targets(spark, [])).report().collect() == []
    m = Mix(docs(spark, [(i, "word word", "a" if i % 2 else "b") for i in range(40)]), targets(spark, [("a", 0.25, 1), ("b", 0.75, 2)]))
    assert {x.source: round(x.actual_share, 2) for x in m.report().collect()} == {"a": 0.25, "b": 0.75}


@needs_vocabulary
def test_rates_are_found_without_passes_that_change_nothing(spark, monkeypatch):
    """Documents are counted once and targets read once; the mix keeps each source's share and its mean length."""
    rows = [(i, " ".join(["word"] * (1 + i * 7 % 50)), "a" if i % 3 else "b") for i in range(3000)]
    table, want = docs(spark, rows), targets(spark, [("a", 0.4, 1), ("b", 0.6, 2)])
    seen, real = [], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda df: seen.append(df.columns) or real(df))
    m = Mix(table, want)
    monkeypatch.undo()
    assert len(seen) == 2
    got = m.copies().collect()
    for s, share in (("a", 0.4), ("b", 0.6)):
        mix, own = sum(c.n_tokens * c.copies for c in got if c.source == s), m.sources[s]
        assert abs(mix - share * m.total) < 100 and mix / sum(c.copies for c in got if c.source == s) == pytest.approx(own["own"] / own["n"], rel=1e-3)
