from datetime import datetime as dt

from weftline.operators.references import counted, unheld

CHILD = "id long, ref string, at timestamp_ntz, k string, t string"
PARENT = "pk string, s timestamp_ntz, e timestamp_ntz, k string"


def run(spark, child, parent, **kw):
    c, p = spark.createDataFrame(child, CHILD), spark.createDataFrame(parent, PARENT)
    return sorted(map(tuple, unheld(c, p, "id", "ref", "at", "pk", "s", "e", **kw).select("row_key", "ref_month", "kind").collect()))


def day(n, month=1):
    return dt(2024, month, n)


def test_kinds_spelling_nulls_repeats_and_clashing_columns(spark):
    child = [
        (1, " A-b ", day(5), "x", "y"),
        (1, " A-b ", day(5), "x", "y"),
        (2, "ab", day(20), None, None),
        (3, "zz", day(5), "x", None),
        (4, "ab", day(1), "x", None),
        (5, None, day(5), "x", None),
        (6, "  ", day(5), "x", None),
        (7, "ab", None, "x", None),
        (None, "zz", day(5), "x", None),
        (8, "ab", day(3), "x", None),
        (9, "ab", day(2, 4), "x", None),
        (10, "ab", day(10), "x", None),
        (11, "nostart", day(10), "x", None),
    ]
    parent = [("AB", day(3), day(10), "x"), ("a-b", day(1, 4), None, "x"), ("AB", day(3), day(10), "x"), (None, day(1), None, "x"), ("nostart", None, None, "x")]
    assert run(spark, child, parent) == [("10", "2024-01", "deleted"), ("11", "2024-01", "late"), ("2", "2024-01", "deleted"), ("3", "2024-01", "missing"), ("4", "2024-01", "late")]


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", day(1), "", "")], []) == [("1", "2024-01", "missing")]
    assert run(spark, [], [("a", day(1), None, "")]) == []


def test_against_brute_force(spark):
    import random

    r = random.Random(3)
    child = [(i, r.choice("abcdefgh"), dt(2024, r.randint(1, 12), r.randint(1, 28)), "", "") for i in range(400)]
    parent = []
    for k in "abcdef":
        for _ in range(r.randint(1, 5)):
            a, b = sorted(dt(2024, r.randint(1, 12), r.randint(1, 28)) for _ in range(2))
            parent.append((k, a, b if r.random() < 0.7 else None, ""))
    want = []
    for i, k, t, *_ in child:
        mine = [(s, e) for p, s, e, _ in parent if p == k]
        if any(s <= t and (e is None or e > t) for s, e in mine):
            continue
        want.append((str(i), t.strftime("%Y-%m"), "missing" if not mine else "deleted" if any(s <= t for s, _ in mine) else "late"))
    assert run(spark, child, parent) == sorted(want)
    assert run(spark, child, parent, many_spans=2) == sorted(want)  # keys of more intervals are swept


def test_counted(spark):
    df = spark.createDataFrame([("cards", "2024-01", "a", "late"), ("cards", "2024-01", "b", "late")], "src_table string, ref_month string, row_key string, kind string")
    assert [tuple(r) for r in counted(df).collect()] == [("cards", "2024-01", "late", 2)]
