"""Items that appear together: stripes, merged by key, then the log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.terms import clean_terms
from weftline.runtime import cut, ship

PARTS = 16  # pieces into which an item's stripe is divided by its neighbours, so that no stripe is one task's alone
HELD = 1_000_000  # pairs that a worker adds up before it sends its stripes on
STRIPE = "spot int, item string, neighbours array<string>, counts array<long>"


def _pairs(offsets: np.ndarray, codes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Keys (a << 32 | b) of every pair a, b of one list, each item also with itself; lists in blocks of like length."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes[sizes > 0]):
        at = offsets[:-1][sizes == n]
        step = max(1, width // int(n * n))
        for i in range(0, len(at), step):
            block = codes[at[i : i + step, None] + np.arange(n)].astype(np.int64)
            for j in range(n) if n * n > width else (None,):  # one very long list, item by item
                if j is None:
                    x, y = np.triu_indices(n)
                    yield ((block[:, x] << 32) | block[:, y]).ravel()
                else:
                    yield ((block[:, j : j + 1] << 32) | block[:, j:]).ravel()


def _stripe_rows(items: np.ndarray, neighbours: np.ndarray, counts: np.ndarray, names: list[str], spots: int) -> pa.RecordBatch:
    """Rows of one item and some of its neighbours each, sorted by item and piece."""
    import xxhash

    h = np.array([xxhash.xxh32_intdigest(x) for x in names], np.int64) if names else np.zeros(0, np.int64)
    piece = h[neighbours] % PARTS
    order = np.lexsort((piece, items))
    items, neighbours, counts, piece = items[order], neighbours[order], counts[order], piece[order]
    cutsat = np.flatnonzero(np.diff(items * PARTS + piece, prepend=-1)) if len(items) else np.zeros(0, np.int64)
    offs = pa.array(np.append(cutsat, len(items)).astype(np.int32))
    pool = pa.array(names, pa.string())
    first = items[cutsat]
    spot = ((h[first] + piece[cutsat] * 7919) % spots).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(spot), pool.take(pa.array(first)), pa.ListArray.from_arrays(offs, pool.take(pa.array(neighbours))), pa.ListArray.from_arrays(offs, pa.array(counts))],
        names=["spot", "item", "neighbours", "counts"],
    )


def _sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _stripes(spots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            k, n = _sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            return _stripe_rows(k >> 32, k & 0xFFFFFFFF, n, list(number), spots)

        for b in batches:
            col = b.column(0)
            flat = pc.dictionary_encode(col.flatten())
            words = flat.dictionary.to_pylist()
            code = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
            if not len(code):
                continue
            codes = code[flat.indices.to_numpy()]
            offsets = col.offsets.to_numpy().astype(np.int64)
            for keys in _pairs(offsets - offsets[0], codes, HELD):
                k, n = np.unique(keys, return_counts=True)
                held.append((k, n))
                size += len(k)
                if size > HELD:
                    k, n = _sum(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                    held, size = [(k, n)], len(k)
                    if size > HELD // 2:
                        yield out()
                        held, size = [], 0
            if not held:
                number.clear()
        if held:
            yield out()

    return run


def _merge(t: pa.Table) -> pa.Table:
    """The stripes of one spot, added up neighbour by neighbour."""
    t = t.combine_chunks()
    near = t.column("neighbours").combine_chunks() if t.num_rows else None
    items = pc.dictionary_encode(t.column("item").combine_chunks())
    flat = pc.dictionary_encode(near.flatten())
    who = np.repeat(items.indices.to_numpy().astype(np.int64), np.diff(near.offsets.to_numpy()))
    keys, n = _sum((who << 32) | flat.indices.to_numpy(), t.column("counts").combine_chunks().flatten().to_numpy())
    return pa.table({"a": items.dictionary.take(pa.array(keys >> 32)), "b": flat.dictionary.take(pa.array(keys & 0xFFFFFFFF)), "n": n})


def llr(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio (G squared) of a 2x2 table from the joint count, both counts and the total."""

    def term(k: Column, row: Column, col: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)

    na, nb = n - a, n - b
    return 2.0 * (term(ab, a, b) + term(a - ab, a, nb) + term(b - ab, na, b) + term(n - a - b + ab, na, nb))


def cooccurrences(records: DataFrame, terms: str, n_records: int, at_least: int = 1, significant: float | None = None) -> DataFrame:
    """(slug_a, slug_b, n_both, n_a, n_b, lift, llr) for every two values that at least ``at_least`` records hold both.

    slug_a < slug_b by bytes. Values are cleaned as in ``term_counts`` and count once a record; each row is one record.
    ``lift`` is n_both * n_records / (n_a * n_b). Empty tables and records of less than two values give no rows. ``significant`` keeps pairs that occur
    together more often than by chance with at least that log-likelihood ratio (10.83 is the 0.1 % level).

    A worker adds up its rows into stripes (an item, its neighbours, their counts, itself included) and sends one piece
    of each; the pieces are merged by item and neighbour. What is shuffled follows the distinct pairs a worker saw.
    """
    spark = records.sparkSession
    ship(spark)
    spots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = records.select(F.array_sort(F.array_distinct(clean_terms(F.col(f"`{terms}`")))).alias("once")).filter("size(once) > 0")
    merged = cut(once.mapInArrow(_stripes(spots), STRIPE).groupBy("spot").applyInArrow(_merge, "a string, b string, n long"))
    alone = merged.filter("a = b").select("a", "n")
    out = (
        merged.filter((F.col("a") != F.col("b")) & (F.col("n") >= at_least))
        .withColumnRenamed("n", "n_both")
        .join(alone.select("a", F.col("n").alias("n_a")), "a")
        .join(alone.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
        .select(
            F.col("a").alias("slug_a"),
            F.col("b").alias("slug_b"),
            "n_both",
            "n_a",
            "n_b",
            (F.col("n_both") * F.lit(float(n_records)) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
            llr(F.col("n_both").cast("double"), F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.lit(float(n_records))).alias("llr"),
        )
    )
    return out if significant is None else out.filter((F.col("llr") >= significant) & (F.col("lift") > 1))
