from datetime import datetime as dt

import numpy as np
import pyarrow as pa
from weftline.operators.snapshots import _cells, _peel, changes

SCHEMA = "snapshot_no int, _id string, oracle_text string, delivered_at timestamp_ntz, id string, txt string, kh string"


def rows(*items):
    return [(n, i, t, dt(2024, 1, d), "x", "x", "x") for n, i, t, d in items]


def run(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return sorted(map(tuple, changes(df, "snapshot_no", "_id", "oracle_text", "delivered_at", **kw).collect()))


def test_kinds_latest_delivery_nulls_and_gaps(spark):
    data = rows((1, "a", "x", 1), (1, "b", None, 1), (1, "c", "old", 1), (1, "c", "new", 2), (3, "a", "x", 1), (3, "b", "", 1), (3, "c", "new", 1), (3, "c", "new", 1), (3, "d", "n", 1), (7, "a", "y", 1), (7, None, "y", 1), (None, "q", "y", 1))
    assert run(spark, data) == [(3, "d", "added"), (7, "a", "changed"), (7, "b", "removed"), (7, "c", "removed"), (7, "d", "removed")]


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, rows((1, "a", "x", 1))) == []


def test_small_tables_are_enlarged_until_all_is_recovered(spark):
    r = np.random.default_rng(5)
    old = {f"k{i}": str(r.integers(5)) for i in range(600)}
    new = {k: v for k, v in old.items() if r.random() < 0.7} | {f"n{i}": "z" * 5000 for i in range(150)}
    new = {k: ("other" if r.random() < 0.3 else v) for k, v in new.items()}
    want = sorted([(2, k, "added") for k in new.keys() - old.keys()] + [(2, k, "removed") for k in old.keys() - new.keys()] + [(2, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]])
    data = rows(*[(1, k, v, 1) for k, v in old.items()], *[(2, k, v, 1) for k, v in new.items()])
    assert run(spark, data, cells=4, bucket_records=100) == want
    # One bucket that never peels, even enlarged: its records are compared themselves.
    assert run(spark, data, cells=1, bucket_records=5000) == want


def test_peel_tells_a_table_that_is_too_small():
    k = np.arange(1, 60, dtype=np.int64)
    where, check = _cells(k, k * 7, 4)
    n, kx, vx, cx = (np.zeros(12, np.int64) for _ in range(4))
    for w in where:
        np.add.at(n, w, 1)
        for a, v in ((kx, k), (vx, k * 7), (cx, check)):
            np.bitwise_xor.at(a, w, v)
    out = _peel(4)(pa.table({"step": pa.array([2] * 12, pa.int32()), "bucket": pa.array([0] * 12, pa.int32()), "cell": np.arange(12, dtype=np.int32), "n": n, "kx": kx, "vx": vx, "cx": cx}))
    assert out.column("ok").to_pylist() == [False]
