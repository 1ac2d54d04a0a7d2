"""Items into containers of fixed capacity: best fit decreasing in partitions, certified by lower bounds.

Dual feasible functions bound from below how many containers a partition's items need. Where best fit decreasing
reaches the bound, the partition is certified and only its least filled container stays open; where a
gap is left, more of the least filled do, the larger the gap. Besides, containers under 95 % stay open everywhere, since
what is best for one partition need not be for all. The documents of all open containers are exchanged, that
is partitioned anew, and packed again, until they fit into one partition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import VOCABULARY, sized
from weftline.runtime import Cut, cut, ship

CAPACITY = 2048
FULL = 0.95  # containers filled less stay open too, as long as exchanging makes headway
CONTAINERS = 512  # about so many containers are packed in one partition
ROUNDS = 40  # at most; the open containers' tokens shrink at least by half a round or so, and it ends when they do not
PACKED = "doc_id long, piece int, size int, part int, bin int, open boolean, bound int, bins int"


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest bound on the containers needed, over two families of dual feasible functions.

    ``counts`` tells how many items of each size there are, if they are counted already.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, minlength=capacity + 1).astype(np.int64) if counts is None else counts
    count, mass = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    lam = np.arange(1, capacity // 2 + 1)
    # Items above capacity - l count whole, those below l not at all, the others by their size.
    over = count[capacity] - count[capacity - lam]
    between = mass[capacity - lam] - mass[lam - 1]
    best = max(-(-int(mass[-1]) // capacity), int((over + -(-between // capacity)).max()))
    x = np.flatnonzero(n)
    for k in range(1, 33):  # round (k + 1) x / capacity down to multiples of 1 / k, but keep exact multiples
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        num = np.where(whole, x * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((num * n[x]).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; an integer's bits tell which amounts of room are to be had."""
    where = np.empty(len(sizes), np.int32)
    rooms: dict[int, list[int]] = {}
    free, used = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            held = rooms[room]
            b = held.pop()
            if not held:
                free ^= 1 << room
        else:
            room, b = capacity, used
            used += 1
        where[i] = b
        left = room - s
        if left:
            rooms.setdefault(left, []).append(b)
            free |= 1 << left
    return where


def _pack(capacity: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = t.column("size").to_numpy()
        where, bound = best_fit_decreasing(sizes, capacity), lower_bound(sizes, capacity)
        fill = np.bincount(where, weights=sizes)
        gap = len(fill) - bound
        # The least filled containers stay open; a full one never does.
        order = np.argsort(fill, kind="stable")[: 1 + 4 * gap]
        is_open = np.zeros(len(fill), bool)
        is_open[order[fill[order] < capacity]] = True
        is_open |= fill < FULL * capacity
        m = len(sizes)
        return pa.table({"doc_id": t.column("doc_id"), "piece": t.column("piece"), "size": t.column("size"), "part": t.column("part"), "bin": where, "open": is_open[where], "bound": pa.array(np.full(m, bound, np.int32)), "bins": pa.array(np.full(m, len(fill), np.int32))})

    return run


@dataclass
class Packing:
    places: DataFrame  # doc_id, piece int, n_tokens, container string
    partitions: DataFrame  # round, part, n_items, bins, bound, certified: every partition that was packed
    sizes: np.ndarray  # how many pieces there are of each size, from 0 to the capacity


def packed(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, containers: int = CONTAINERS) -> Packing:
    """Every document's place, whole texts counted in tokens, and the certificates of the partitions.

    A document of at most ``capacity`` tokens is one piece; a longer one is split into full pieces, each a container of
    its own, and a rest that is packed like the others. Null and empty texts have no tokens and no place, rows with a
    null key neither. Keys should occur once. Tokens in a container never exceed the capacity. A partition is certified
    if it took as many containers as its lower bound.
    """
    spark = docs.sparkSession
    ship(spark)
    items = sized(docs.filter(F.col(f"`{key}`").isNotNull()), key, text, vocabulary=vocabulary).filter("n_tokens > 0")
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    pieces = items.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), full)).alias("piece")).select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))
    todo = Cut(pieces)
    counted = np.zeros(capacity + 1, np.int64)
    for r in todo.df.groupBy("size").count().collect():  # as many rows as there are sizes, at most the capacity
        counted[r["size"]] = r["count"]
    told = []
    whole = todo.df.filter(F.col("size") == capacity).select("doc_id", "piece", F.col("size").cast("long").alias("n_tokens"), F.xxhash64("doc_id", "piece").alias("h"))
    # Full containers are named by what they hold; the others by round, part and number (bit 62 keeps them apart).
    done = [whole.select("doc_id", "piece", "n_tokens", F.concat_ws("-", F.lit("f"), "doc_id", "piece").alias("container"))]
    rest = todo.df.filter(F.col("size") < capacity)
    before = None
    for r in range(ROUNDS):
        mass = rest.agg(F.sum("size")).first()[0]
        if not mass:
            break
        parts = max(1, -(-mass // (capacity * containers)))
        placed = cut(rest.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(r)), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_pack(capacity), PACKED))
        told.append(placed.groupBy("part").agg(F.count("*").alias("n_items"), F.max("bins").alias("bins"), F.max("bound").alias("bound")).select(F.lit(r).alias("round"), "*", (F.col("bins") == F.col("bound")).alias("certified")))
        last = parts == 1 or r == ROUNDS - 1 or (before is not None and mass >= before)
        before = mass
        closed = placed if last else placed.filter("not open")
        done.append(closed.select("doc_id", "piece", F.col("size").cast("long").alias("n_tokens"), F.concat_ws("-", F.lit(r), "part", "bin").alias("container")))
        if last:
            break
        rest = placed.filter("open").select("doc_id", "piece", "size")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    certs = spark.createDataFrame([], "round int, part int, n_items long, bins int, bound int, certified boolean")
    for t in told:
        certs = certs.unionByName(t)
    return Packing(out, certs, counted)


def packing_report(p: Packing, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, least_containers, certified, fill, n_partitions, n_certified, n_rounds).

    ``least_containers`` is the best of the lower bounds over all pieces, ``certified`` whether it was reached.
    """
    least = lower_bound(np.flatnonzero(p.sizes), capacity, p.sizes)
    t = p.places.agg(F.countDistinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    c = p.partitions.agg(F.count("*").alias("n_partitions"), F.count_if("certified").alias("n_certified"), F.countDistinct("round").alias("n_rounds"))
    fill = F.when(F.col("n_containers") > 0, F.col("n_tokens") / (F.col("n_containers") * capacity))
    return t.withColumn("one", F.lit(1)).join(c.withColumn("one", F.lit(1)), "one").select("n_containers", "n_tokens", F.lit(least).cast("long").alias("least_containers"), (F.col("n_containers") == least).alias("certified"), fill.alias("fill"), "n_partitions", "n_certified", "n_rounds")
