import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from weftline.llm import terms as T
from weftline.llm.cooccurrence import cooccurrences
from weftline.llm.terms import BurstTrie, marks, routes_of, term_counts

SCHEMA = "tags array<string>, term string, every string, n_occ int"


def frame(spark, lists):
    return spark.createDataFrame([(x, "a", "b", 1) for x in lists], SCHEMA)


def clean(x):
    return [t.strip().lower() for t in x or [] if t is not None and t.strip()]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=6), max_size=200), st.integers(1, 5))
def test_trie_counts_like_a_dictionary_in_order(words, burst):
    trie, want = BurstTrie(burst), Counter(words)
    for w in words:
        trie.add(w, 1, 2)
    got = list(trie.items())
    assert [g[0] for g in got] == sorted(want) and {g[0]: g[1] for g in got} == want and all(g[2] == 2 * g[1] for g in got)
    assert trie.size == len(want)


def test_routes_cover_every_term():
    routes = routes_of([f"{a}{b}{c}" for a in "xyz" for b in "abc" for c in range(30)], 10)
    assert "" in routes and any(len(r) > 1 for r in routes)


def test_counts_nulls_repeats_spelling_and_a_hot_term(spark):
    lists = [["A", "a ", None, " ", "b"], None, [], [None], ["b", "c"], ["long" * 3000]] + [["hot"]] * 300
    got = {r.term: (r.n_occ, r.n_rec) for r in term_counts(frame(spark, lists), "tags").collect()}
    assert got == {"a": (2, 1), "b": (2, 2), "c": (1, 1), "long" * 3000: (1, 1), "hot": (300, 300)}


def test_empty(spark):
    assert term_counts(frame(spark, []), "tags").collect() == []
    assert cooccurrences(frame(spark, []), "tags", 0).collect() == []


def test_worker_flush_changes_nothing(spark, monkeypatch):
    r = random.Random(1)
    lists = [[f"t{r.randint(0, 400)}" for _ in range(r.randint(0, 6))] for _ in range(600)]
    want_occ, want_rec = Counter(), Counter()
    for x in lists:
        want_occ.update(x)
        want_rec.update(set(x))
    got = term_counts(frame(spark, lists).repartition(3), "tags").collect()
    assert {g.term: (g.n_occ, g.n_rec) for g in got} == {t: (want_occ[t], want_rec[t]) for t in want_occ}
    import pyarrow as pa

    monkeypatch.setattr(T, "FLUSH", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(lists), pa.array([sorted(set(x)) for x in lists])], names=["every", "once"])
    pieces = list(T._count(routes_of(list(want_occ), 20))([batch, batch]))
    assert len(pieces) > 1
    total = Counter()
    for p in pieces:
        for route in range(p.num_rows):
            total.update({t: o for t, o in zip(T._merge(pa.Table.from_batches([p.slice(route, 1)])).column("term").to_pylist(), T._merge(pa.Table.from_batches([p.slice(route, 1)])).column("n_occ").to_pylist())})
    assert total == Counter({t: 2 * n for t, n in want_occ.items()})


def test_marks(spark):
    c = spark.createDataFrame([("a", 2), ("b", 3), ("c", 9), ("d", 8)], "term string, n_rec long")
    assert {r.term: r.mark for r in marks(c, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}


def test_pairs_against_brute_force_with_long_records(spark):
    r = random.Random(2)
    lists = [[f"T{r.randint(0, 25)} " for _ in range(r.randint(0, 8))] for _ in range(300)] + [None, [None, ""], [f"t{i}" for i in range(26)]]
    single, both = Counter(), Counter()
    for x in lists:
        s = sorted(set(clean(x)))
        single.update(s)
        both.update((a, b) for i, a in enumerate(s) for b in s[i + 1 :])
    got = cooccurrences(frame(spark, lists), "tags", len(lists)).collect()
    assert {(g.slug_a, g.slug_b): g.n_both for g in got} == both
    for g in got:
        assert (g.n_a, g.n_b) == (single[g.slug_a], single[g.slug_b])
        assert abs(g.lift - g.n_both * len(lists) / (g.n_a * g.n_b)) < 1e-9 and g.llr >= -1e-9
