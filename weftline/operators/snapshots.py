"""What changed between full snapshots: invertible Bloom lookup tables, subtracted for each hash bucket.

Every record of a snapshot is an element (key hash, content hash). For each snapshot and bucket, each element is added
to one cell in each of three sub-tables: a count and the exclusive-or of the key, content and check hashes. Subtracting
the tables of two snapshots cancels what they share, so their size follows the number of differences, not of records.
Peeling cells that hold a single element recovers the differing elements; a bucket that cannot be peeled is built again
with four times the cells, ENLARGED times at most. One that even then does not peel, as when two records are alike in both
hashes, has all its records compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import Cut, cut, newest, ship

PARTS = 3
RECORDS_A_BUCKET = 1024
ENLARGED = 4
CELLS = 128  # in each part of a bucket's first table
PEELED = "step int, bucket int, kh long, vh long, side int, ok boolean"


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer (splitmix), to place elements in cells and to check them."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _cells(kh: np.ndarray, vh: np.ndarray, cells: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The cell of each element in each part, and its check hash."""
    e = _mix(kh.view(np.uint64), 0) ^ _mix(vh.view(np.uint64), 1)
    return [p * cells + (_mix(e, 2 + p) % np.uint64(cells)).astype(np.int64) for p in range(PARTS)], _mix(e, 9).view(np.int64)


def _sketch(cells: int):
    """mapInArrow: rows (snapshot, bucket, kh, vh) to cell rows, pre-added within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            snap, bucket, kh, vh = (np.asarray(b.column(i)) for i in range(4))
            where, check = _cells(kh, vh, cells)
            group, inverse = np.unique(snap.astype(np.int64) << 32 | bucket.astype(np.int64), return_inverse=True)
            spot = np.concatenate([inverse * (PARTS * cells) + w for w in where])
            used, at = np.unique(spot, return_inverse=True)
            out = [np.zeros(len(used), np.int64) for _ in range(4)]
            np.add.at(out[0], at, 1)
            for o, v in zip(out[1:], (kh, vh, check)):
                np.bitwise_xor.at(o, at, np.tile(v, PARTS))
            g = group[used // (PARTS * cells)]
            yield pa.RecordBatch.from_arrays(
                [pa.array((g >> 32).astype(np.int32)), pa.array((g & 0xFFFFFFFF).astype(np.int32)), pa.array((used % (PARTS * cells)).astype(np.int32)), *map(pa.array, out)],
                names=["snapshot_no", "bucket", "cell", "n", "kx", "vx", "cx"],
            )

    return run


def _peel(cells: int):
    """applyInArrow: the subtracted table of one (step, bucket) to its differing elements; side 1 is the later snapshot."""

    def run(t: pa.Table) -> pa.Table:
        step, bucket = t.column("step")[0].as_py(), t.column("bucket")[0].as_py()
        n, kx, vx, cx = (np.zeros(PARTS * cells, np.int64) for _ in range(4))
        at = t.column("cell").to_numpy()
        for a, c in ((n, "n"), (kx, "kx"), (vx, "vx"), (cx, "cx")):
            a[at] = t.column(c).to_numpy()
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(4 * PARTS * cells):
            one = np.flatnonzero(np.abs(n) == 1)
            if len(one):
                where, check = _cells(kx[one], vx[one], cells)
                fit = (check == cx[one]) & np.any([w == one for w in where], axis=0)
                one = one[fit]
            if not len(one):
                break
            found = np.unique(np.stack([kx[one], vx[one], n[one]], axis=1), axis=0)
            k, v, s = (np.ascontiguousarray(found[:, i]) for i in range(3))
            where, check = _cells(k, v, cells)
            for w in where:
                np.subtract.at(n, w, s)
                np.bitwise_xor.at(kx, w, k)
                np.bitwise_xor.at(vx, w, v)
                np.bitwise_xor.at(cx, w, check)
            got.append((k, v, s))
        # The digests agree only if nothing is left in any cell.
        ok = not (n.any() or kx.any() or vx.any() or cx.any())
        if not ok:
            got = [(np.zeros(1, np.int64),) * 3]
        k, v, s = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in range(3))
        m = len(k)
        return pa.table({"step": pa.array(np.full(m, step, np.int32)), "bucket": pa.array(np.full(m, bucket, np.int32)), "kh": k, "vh": v, "side": pa.array(s.astype(np.int32)), "ok": pa.array(np.full(m, ok))})

    return run


def changes(snapshots: DataFrame, no: str, key: str, text: str, delivered: str, cells: int = CELLS, bucket_records: int = RECORDS_A_BUCKET) -> DataFrame:
    """Records added, removed or changed from each snapshot to the next present: (snapshot_no int, card_id, change_kind).

    Of a key's rows in a snapshot the latest ``delivered`` counts. ``changed``: in both, with another ``text``, null
    being the empty text; no other column matters, nor any stored signature. Rows with a null key or snapshot number are
    dropped. One snapshot or none gives no rows. Numbers may have gaps.

    The keys that come out of peeling are looked up in both snapshots and the SHA-256 of their texts compared, so a clash
    of 64-bit hashes cannot make a false change; no text is shuffled beyond its first choice of rows.
    """
    spark = snapshots.sparkSession
    ship(spark)
    src = snapshots.select(F.col(f"`{no}`").cast("int").alias("snapshot_no"), F.col(f"`{key}`").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256)).alias("txt"), F.col(f"`{delivered}`").alias("at"))
    rows = cut(newest(src, ["snapshot_no", "id"], "at").select("snapshot_no", "id", "txt", F.xxhash64("id").alias("kh"), F.xxhash64("txt", F.lit(1)).alias("vh")))
    sizes = rows.groupBy("snapshot_no").count()
    # A row for each snapshot: as few as the deliveries.
    steps = cut(sizes.select("snapshot_no", "count", F.lag("snapshot_no").over(Window.orderBy("snapshot_no")).alias("before")))
    most = steps.agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // bucket_records))
    # The records of a bucket come together before they are sketched, else a batch hardly meets a cell twice.
    elements = rows.select("snapshot_no", F.pmod("kh", F.lit(buckets)).cast("int").alias("bucket"), "kh", "vh").repartition("bucket").sortWithinPartitions("bucket", "snapshot_no")
    pairs = steps.filter("before is not null").select("snapshot_no", "before")
    sides = pairs.select(F.col("snapshot_no").alias("step"), "snapshot_no", F.lit(1).alias("sign")).unionByName(pairs.select(F.col("snapshot_no").alias("step"), F.col("before").alias("snapshot_no"), F.lit(-1).alias("sign")))
    done: list[DataFrame] = []
    failed: DataFrame | None = None
    for attempt in range(ENLARGED + 1):
        part = elements
        if failed is not None:
            # Both snapshots of a failed (step, bucket) are sketched again, whole.
            again = failed.join(sides, "step").select("snapshot_no", "bucket").distinct()
            part = elements.join(again, ["snapshot_no", "bucket"], "left_semi")
        cellrows = part.mapInArrow(_sketch(cells), "snapshot_no int, bucket int, cell int, n long, kx long, vx long, cx long")
        summed = cellrows.groupBy("snapshot_no", "bucket", "cell").agg(F.sum("n").alias("n"), F.bit_xor("kx").alias("kx"), F.bit_xor("vx").alias("vx"), F.bit_xor("cx").alias("cx"))
        signed = summed.join(sides, "snapshot_no").withColumn("n", F.col("n") * F.col("sign"))
        if failed is not None:
            signed = signed.join(failed, ["step", "bucket"], "left_semi")
        less = signed.groupBy("step", "bucket", "cell").agg(F.sum("n").alias("n"), F.bit_xor("kx").alias("kx"), F.bit_xor("vx").alias("vx"), F.bit_xor("cx").alias("cx")).filter("n <> 0 or kx <> 0 or vx <> 0 or cx <> 0")
        peeled = Cut(less.groupBy("step", "bucket").applyInArrow(_peel(cells), PEELED)).df
        done.append(peeled.filter("ok").select("step", "kh"))
        failed = peeled.filter("not ok").select("step", "bucket").distinct()
        if failed.isEmpty():
            break
        if attempt == ENLARGED:  # these do not peel at all: all their records are compared
            done.append(elements.join(sides, "snapshot_no").join(failed, ["step", "bucket"], "left_semi").select("step", "kh"))
        cells *= 4
    hits = done[0]
    for d in done[1:]:
        hits = hits.unionByName(d)
    keys = hits.select(F.col("step"), "kh").distinct()
    sided = rows.join(sides, "snapshot_no").select("step", "sign", "id", "kh", "txt").join(keys, ["step", "kh"], "left_semi")
    new, old = F.max(F.when(F.col("sign") == 1, F.col("txt"))), F.max(F.when(F.col("sign") == -1, F.col("txt")))
    return (
        sided.groupBy(F.col("step").alias("snapshot_no"), F.col("id").alias("card_id"))
        .agg(new.alias("new"), old.alias("old"))
        .filter("not (new <=> old)")
        .select("snapshot_no", "card_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change_kind"))
    )
