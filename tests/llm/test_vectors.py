import math

import numpy as np
from weftline.llm import vectors as V
from weftline.runtime import cut

SCHEMA = "_id string, v array<float>, w array<float>, field int, id string, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], None if w is None else [None if x is None else float(x) for x in w], 1, "x", "y") for k, v, w in rows], SCHEMA)


def brute(rows, at, k, least):
    dim = 8
    ok = {r[0]: np.array(r[at], float) for r in rows if r[0] is not None and r[at] is not None and len(r[at]) == dim and all(x is not None and math.isfinite(x) for x in r[at]) and any(r[at])}
    u = {i: (x / np.linalg.norm(x)) for i, x in ok.items()}
    out = set()
    for a in u:
        best = sorted((-round(float(u[a] @ u[b]), 6), b) for b in u if b != a)[:k]
        out |= {tuple(sorted((a, b))) for s, b in best if -s >= least}
    return out


def test_dirty_vectors_copies_and_two_fields(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((6, 8))
    rows = [(f"c{i:02}", base[i % 6] + 0.02 * r.standard_normal(8), base[(i * 5) % 6] * (i + 1)) for i in range(30)]
    rows += [(f"d{i}", base[0], None) for i in range(9)]  # more copies than k
    rows += [("n1", None, [1.0]), ("n2", [0.0] * 8, [1, 2, None, 3, 4, 5, 6, 7]), ("n3", [float("nan")] * 8, [float("inf")] * 8), (None, base[1], base[1]), ("huge", base[2] * 1e30, base[2])]
    got = {tuple(x) for x in V.similar_pairs(frame(spark, rows), "_id", ["v", "w"], k=5, least=0.92, dim=8).collect()}
    v = {g[1:] for g in got if g[0] == "v"}
    copies = {p for p in v if p[0][0] == "d" and p[1][0] == "d"}
    # of nine copies each has its first five others
    assert copies == {tuple(sorted((f"d{i}", f"d{j}"))) for i in range(9) for j in [x for x in range(9) if x != i][:5]}
    clean = [x for x in rows if not (x[0] or "").startswith("d")]
    got2 = {tuple(x)[1:] for x in V.similar_pairs(frame(spark, clean), "_id", ["v"], k=5, least=0.92, dim=8).collect()}
    assert got2 == brute(clean, 1, 5, 0.92)


def test_empty(spark):
    assert V.similar_pairs(frame(spark, []), "_id", ["v", "w"], dim=8).collect() == []


def classes(spark, x):
    rows = [(0, int(i), bytes(np.asarray(v, np.float32))) for i, v in enumerate(x)]
    return cut(spark.createDataFrame(rows, "field int, cid long, vec binary"))


def test_recall_of_plain_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((25, 32))
    x = centre[r.integers(25, size=2500)] + 0.9 * r.standard_normal((2500, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    got: dict[int, set] = {}
    for row in V.nearest(classes(spark, x), 10, probes=16).collect():
        got.setdefault(row.q, set()).add(row.d)
    recall = np.mean([len(got.get(i, set()) & set(w)) / 10 for i, w in enumerate(want.tolist())])
    assert recall >= 0.9, recall


def test_hot_lists_are_divided_and_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 40)
    monkeypatch.setattr(V, "HOT", 2)
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((200, 16)), r.standard_normal(16) + 0.05 * r.standard_normal((300, 16))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:3] if s[i, j] >= 0.9}
    got = {(g.q, g.d) for g in V.nearest(classes(spark, x), 3, least=0.9, probes=12).collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_estimates_lie_within_their_bounds():
    r = np.random.default_rng(5)
    x = r.standard_normal((500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = V.rotation(64)
    y = x @ turn.T
    signs = np.where(y > 0, 1, -1) / 8
    own = np.abs(y).sum(1) / 8
    q = x[:50]
    about = (q @ turn.T) @ signs.T / own
    err = 1.9 * np.sqrt(1 - own**2) / own / np.sqrt(63)
    miss = np.abs(about - q @ x.T) > err
    assert miss.mean() < 0.07


def test_eight_bits():
    x = np.random.default_rng(6).standard_normal((100, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.abs(V.unshort(V.short(x)) @ x.T - x @ x.T).max() < V.MARGIN


def test_recall_in_a_hot_dense_group(spark):
    r = np.random.default_rng(9)
    centre = r.standard_normal(64)
    centre /= np.linalg.norm(centre)
    x = np.concatenate([centre + 0.03 * r.standard_normal((3000, 64)), r.standard_normal((6000, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found: dict[int, set] = {}
    for g in V.nearest(classes(spark, x), 5, least=0.92).collect():
        found.setdefault(g.q, set()).add(g.d)
    want = {}
    for i in range(0, 3000, 5):
        s = x @ x[i]
        s[i] = -2
        want[i] = {int(j) for j in np.argsort(-s)[:5] if s[j] >= 0.92}
    recall = sum(len(found.get(i, set()) & w) for i, w in want.items()) / sum(map(len, want.values()))
    assert recall >= 0.95, recall
