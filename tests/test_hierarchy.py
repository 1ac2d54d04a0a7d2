import random

import pytest
from weftline.operators.hierarchy import hierarchy

SCHEMA = "_id string, parent_slugs array<string>, child_slugs array<string>, id string, depth string"


def build(spark, data, **kw):
    return hierarchy(spark.createDataFrame([(i, p, c, "x", "y") for i, p, c in data], SCHEMA), **kw)


def brute(data):
    clean = lambda s: s.strip().lower() if s and s.strip() else None
    nodes = {clean(i) for i, _, _ in data} - {None}
    e = {(clean(p), clean(i)) for i, ps, _ in data for p in ps or []} | {(clean(i), clean(c)) for i, _, cs in data for c in cs or []}
    e = {(a, b) for a, b in e if a in nodes and b in nodes}
    reach = {n: {} for n in nodes}
    for r in nodes:
        front, d = {r}, 0
        seen = {}
        while front:
            d += 1
            front = {b for a, b in e if a in front} - seen.keys()
            seen.update(dict.fromkeys(front, d))
        reach[r] = seen
    roots = nodes - {b for _, b in e}
    out = {(x, r, 0 if x == r else reach[r][x]) for r in roots for x in nodes if x == r or x in reach[r]}
    cyc = {(x, min(y for y in nodes if y in reach[x] and x in reach[y])) for x in nodes if x in reach[x]}
    return out, cyc, {(a, b) for a in nodes for b in reach[a]}


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_spelling_circles_several_parents_and_one_sided_links(spark, local):
    data = [
        ("root", None, ["A ", "b"]), ("a", [], ["c"]), ("B", ["root", "unknown", None, " "], None), ("c", ["b"], ["d"]), ("c", None, ["e"]), ("d", None, ["C"]), ("e", None, None),
        ("x", ["y"], None), ("y", ["x"], ["z"]), ("z", ["z"], []), ("lone", [], []), (None, ["root"], None), ("  ", None, ["a"]),
    ]
    h = build(spark, data, local=local)
    reach, cyc, desc = brute(data)
    assert {tuple(r) for r in h.reach().collect()} == reach
    assert {tuple(r) for r in h.cyclic().collect()} == cyc
    assert {tuple(r) for r in h.descendants().collect()} == desc


def test_random_graph_with_paths(spark):
    r = random.Random(11)
    names = [f"n{i:02}" for i in range(40)]
    data = [(n, r.sample(names[:i], min(i, r.choice([0, 1, 1, 2]))), [r.choice(names)] if r.random() < 0.12 else []) for i, n in enumerate(names)]
    h = build(spark, data)
    reach, cyc, desc = brute(data)
    got = h.reach(paths=True).collect()
    assert {(g.slug, g.root_slug, g.depth) for g in got} == reach
    assert {tuple(x) for x in h.cyclic().collect()} == cyc
    assert {tuple(x) for x in h.descendants().collect()} == desc
    edges = {(p, n) for n, ps, _ in data for p in ps} | {(n, c) for n, _, cs in data for c in cs}
    for g in got:
        way = g.path.split(" > ")
        assert way[0] == g.root_slug and way[-1] == g.slug and len(way) == g.depth + 1
        assert all(link in edges for link in zip(way, way[1:]))


def test_deep_chain_and_wide_parent(spark):
    data = [("top", None, [f"w{i}" for i in range(300)])] + [(f"w{i}", None, None) for i in range(300)] + [(f"d{i}", [f"d{i - 1}"] if i else [], None) for i in range(120)]
    got = {(r.slug, r.root_slug): r.depth for r in build(spark, data).reach().collect()}
    assert got[("d119", "d0")] == 119 and got[("w299", "top")] == 1 and len(got) == 421


def test_intervals_hold_the_forest_and_hot_blocks_are_salted(spark, monkeypatch):
    from weftline.operators import hierarchy as H

    monkeypatch.setattr(H, "SPREAD", 2)  # nearly every block is salted
    data = [("top", None, [f"w{i}" for i in range(60)])] + [(f"w{i}", None, [f"x{i}"]) for i in range(60)] + [(f"x{i}", ["w0"], None) for i in range(60)]
    h = build(spark, data)
    reach, _, desc = brute(data)
    assert {tuple(r) for r in h.reach().collect()} == reach and {tuple(r) for r in h.descendants().collect()} == desc
    got = {r.slug: r for r in h.intervals().collect()}
    assert [r.slug for r in got.values() if r.top] == ["top"] and got["top"].depth == 0
    for a in got.values():
        below = {x.slug for x in got.values() if a.entry < x.entry <= a.exit}
        assert below <= {x for s, x in desc if s == a.slug}
    assert got["x5"].extra_parents in ("w0", "w5")


def test_empty(spark):
    h = build(spark, [])
    assert h.reach().collect() == [] and h.cyclic().collect() == [] and h.descendants().collect() == []
