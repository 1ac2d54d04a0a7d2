"""Most similar vectors: an inverted file of randomly rotated one-bit codes with error bounds.

Unit vectors are grouped by their nearest centroid. Of each vector the index keeps, besides the vector itself, one bit
for each dimension of its rotated residual to the centroid and three correction scalars: the residual's length, its
inner product with its own code, and its inner product with the centroid. A query is compared with the vectors of its
nearest centroids: the packed bits and scalars estimate each inner product without bias, the distribution of the
rotation bounds the error, and only vectors whose upper bound reaches the threshold and the k-th best lower bound are
compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.sampling import by_hash
from weftline.runtime import cut, ship

TRAIN = 1 << 20  # at most so many vectors of a field, chosen by hash, to fit the centroids on; every vector is indexed
TRAIN_A_LIST = 32  # vectors of that sample for each list, as long as TRAIN allows
WHOLE = 512  # lists up to which centroids are fitted at once; more are fitted group by group
HOT = 8  # times the average list; a list above that is divided again
BLOCK = 4096  # vectors, or queries, of one list in one task at once
FIELD = 1 << 24  # list numbers of one field
REACH = 0.3  # of the distance that the threshold allows, how far towards another list a neighbour is looked for (see _within)
MARGIN = 0.006  # above the error that eight bits a dimension of a query can make in a similarity
MANY = 65_536  # copies of one vector above which its class is a hot key
A_BROADCAST = 10_000  # such classes
SMALL = 1_000_000  # pairs of which the exact check broadcasts the pairs instead of shuffling the vectors


def _binary(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offs = pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, offs, pa.py_buffer(m)])


def _matrix(a: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Binary values of equal width, none null, as the rows of a matrix."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
        if isinstance(a, pa.ChunkedArray):
            a = a.chunk(0)
    if not len(a):
        return np.zeros((0, 1), kind)
    offs = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(kind).reshape(len(a), -1)


def usable_units(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a list column at unit length, and which rows they are of."""
    fit = pc.equal(pc.list_value_length(col), dim).fill_null(False)
    m = col.filter(fit).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(m).max(axis=1, initial=0)
        ok = np.isfinite(m).all(axis=1) & (scale > 0)
    m = m[ok] / scale[ok, None]
    at = np.flatnonzero(fit.to_numpy(zero_copy_only=False))[ok]
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32), at


def _units(fields: list[str], dim: int):
    """Rows (id, vectors) to rows (field, id, vec): usable vectors, as unit length float32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in range(len(fields)):
                m, at = usable_units(b.column(f + 1), dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), f, np.int32)), b.column(0).take(pa.array(at)), _binary(m)], names=["field", "id", "vec"])

    return run


def unit_vectors(rows: DataFrame, key: str, fields: list[str], dim: int = 64) -> DataFrame:
    """(field int, id string, vec binary) of the usable vectors of each array column, scaled to unit length.

    Vectors that are null, of another length, all zero, or hold a null or a number that is not finite are left out, as
    are rows with a null key. A key should occur once.
    """
    ship(rows.sparkSession)
    cols = [F.col(f"`{f}`").cast("array<float>").alias(f"v{i}") for i, f in enumerate(fields)]
    return rows.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("string").alias("id"), *cols).mapInArrow(_units(fields, dim), "field int, id string, vec binary")


def in_chunks(x: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, rows) of a matrix, so that a product of ``width`` columns with them stays at some 16 MB."""
    step = max(1, 4_000_000 // max(width, 1))
    for i in range(0, len(x), step):
        yield i, x[i : i + step]


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return np.concatenate([(part @ c.T).argmax(axis=1) for _, part in in_chunks(x, len(c))]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means; empty centroids are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = _own(x, c)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 1e-6, s / np.maximum(norm, 1e-6), c)
    return np.unique(c.astype(np.float32), axis=0)


def centroids(vectors: DataFrame, n: int, lists: int) -> np.ndarray:
    """About so many centroids of n distinct vectors (vec binary), fitted on a bounded sample by hash.

    More than WHOLE are fitted in two levels: the sample is divided into about sqrt(lists) groups, and each group into its
    share of the lists, so the work on the driver follows sample * sqrt(lists).
    """
    some = by_hash(vectors.select("vec"), "vec", n, min(TRAIN, TRAIN_A_LIST * lists)).toArrow()
    x = _matrix(some.column("vec"), np.float32)
    if lists <= WHOLE:
        return kmeans(x, lists)
    coarse = kmeans(x[: 32 * WHOLE], round(lists**0.5))
    own = _own(x, coarse)
    parts = [x[own == g] for g in range(len(coarse))]
    return np.concatenate([kmeans(p, max(1, round(lists * len(p) / len(x)))) for p in parts if len(p)])


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@dataclass
class Index:
    """What the tasks need: of each field the centroids and in how many blocks of vectors and queries its lists lie; the rotation."""

    centroids: dict[int, np.ndarray]
    turn: np.ndarray
    blocks: dict[int, tuple[np.ndarray, np.ndarray]]


def short(x: np.ndarray) -> np.ndarray:
    """Vectors as eight bits a dimension, followed by the four bytes of their scale: how queries travel to other lists."""
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30).astype(np.float32) / np.float32(127)
    return np.concatenate([np.rint(x / scale).astype(np.int8).view(np.uint8), np.ascontiguousarray(scale).view(np.uint8)], axis=1)


def unshort(b: np.ndarray) -> np.ndarray:
    return b[:, :-4].view(np.int8).astype(np.float32) * np.ascontiguousarray(b[:, -4:]).view(np.float32)


def _lists(index: Index, probes: int, least: float | None):
    """(list, n, asked): how many vectors of a batch lie in each list, and how many are compared with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field, vec = b.column("field").to_numpy(), b.column("vec")
            for f, c in index.centroids.items():
                on = np.flatnonzero(field == f)
                n, asked = (np.zeros(len(c), np.int64) for _ in range(2))
                for _, x in in_chunks(_matrix(vec.take(pa.array(on)), np.float32) if len(on) else np.zeros((0, 1)), len(c)):
                    sims = x @ c.T
                    own = sims.argmax(axis=1)
                    n += np.bincount(own, minlength=len(c))
                    asked += _within(sims, own, c, min(len(c), probes), least).sum(axis=0)
                at = np.flatnonzero(n | asked)
                yield pa.RecordBatch.from_arrays([pa.array((at + f * FIELD).astype(np.int32)), pa.array(n[at]), pa.array(asked[at])], names=["list", "n", "asked"])

    return run


def _within(sims: np.ndarray, own: np.ndarray, c: np.ndarray, p: int, least: float | None) -> np.ndarray:
    """Which lists (columns) each vector is compared with: the p nearest, and with ``least`` all in reach.

    Two vectors at least so similar are at most r = sqrt(2 - 2 least) apart, so one can only lie on the other side of the
    border to a list if it is within r of it. Of r a part of REACH is taken: in 64 dimensions 2.4 times what a direction
    at random comes to, so that nearly all pairs are within. In a dense group that has many lists, many are in reach.
    """
    want = np.zeros(sims.shape, bool)
    np.put_along_axis(want, np.argpartition(-sims, p - 1, axis=1)[:, :p], True, axis=1)
    rows = np.arange(len(sims))
    if least is not None:
        r = np.float32(REACH * math.sqrt(max(0.0, 2 - 2 * least)))
        square = np.einsum("ij,ij->i", c, c)
        for i in range(0, len(sims), 4096):
            s, o = sims[i : i + 4096], own[i : i + 4096]
            apart = np.sqrt(np.maximum(square[o][:, None] + square[None, :] - 2 * (c[o] @ c.T), 0))
            want[i : i + 4096] |= s[np.arange(len(o)), o][:, None] - s <= r * apart
    want[rows, own] = True
    return want


def copies(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of rows repeated so many times each."""
    row = np.repeat(np.arange(len(times)), times)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)


def cells(ids: np.ndarray, own: np.ndarray, who: np.ndarray, to: np.ndarray, data: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
    """(list, block of vectors, block of queries, row, as query, as data) of vectors ``ids`` that lie in the lists ``own``.

    ``who`` are compared with the lists ``to``. A list lies in ``data`` times ``asked`` cells: a vector goes to its block of
    vectors and all of queries, a query to its block of queries and all of vectors; where it is both it goes once.
    """
    row, q = copies(asked[own])
    held = (own[row], ids[row] % data[own[row]], q, row, q == ids[row] // 7 % asked[own[row]], np.ones(len(row), bool))
    rep, d = copies(data[to])
    to, who = to[rep], who[rep]
    new = (to != own[who]) | (d != ids[who] % data[to])
    to, who, d = to[new], who[new], d[new]
    asks = (to, d, ids[who] // 7 % asked[to], who, np.ones(len(to), bool), np.zeros(len(to), bool))
    return tuple(np.concatenate(z) for z in zip(held, asks))


def _place(index: Index, probes: int, least: float | None):
    """Rows (field, cid, vec) to rows for each list a vector is asked in; in its own list also with code and scalars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field, cid, vec = b.column("field").to_numpy(), b.column("cid").to_numpy(), b.column("vec")
            for f, c in index.centroids.items():
                on = np.flatnonzero(field == f)
                for i, x in in_chunks(_matrix(vec.take(pa.array(on)), np.float32) if len(on) else np.zeros((0, 1)), len(c)):
                    sims = x @ c.T
                    own = sims.argmax(axis=1)
                    who, to = np.nonzero(_within(sims, own, c, min(len(c), probes), least))
                    r = x - c[own]
                    length = np.linalg.norm(r, axis=1)
                    y = (r / np.maximum(length, 1e-12)[:, None]) @ index.turn.T
                    code = np.packbits(y > 0, axis=1)
                    self_ip = np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])
                    with_c = np.einsum("ij,ij->i", r, c[own])
                    ids = cid[on[i : i + len(x)]]
                    lst, dblk, qblk, row, as_query, as_data = cells(ids, own, who, to, *index.blocks[f])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((lst + f * FIELD).astype(np.int32)),
                            pa.array(dblk.astype(np.int32)),
                            pa.array(qblk.astype(np.int32)),
                            pa.array(ids[row]),
                            pa.array(as_query),
                            _binary(x).take(pa.array(row, mask=~as_data)),
                            _binary(code).take(pa.array(row, mask=~as_data)),
                            *(pa.array(z[row].astype(np.float32), mask=~as_data) for z in (length, self_ip, with_c)),
                            _binary(short(x)).take(pa.array(row, mask=as_data)),
                        ],
                        names=["list", "dblk", "qblk", "cid", "as_query", "vec", "code", "length", "self_ip", "with_c", "short"],
                    )

    return run


PLACED = "list int, dblk int, qblk int, cid long, as_query boolean, vec binary, code binary, length float, self_ip float, with_c float, short binary"


def _search(index: Index, k: int, least: float | None, eps: float):
    """One block of vectors and of queries of one list: rows (field, q, d, sim), the k best of each query."""

    def run(t: pa.Table) -> pa.Table:
        list_no = t.column("list")[0].as_py()
        f, c = list_no // FIELD, index.centroids[list_no // FIELD][list_no % FIELD]
        t = t.combine_chunks()
        is_data = pc.is_valid(t.column("vec"))
        held, others = t.filter(is_data), t.filter(pc.invert(is_data))
        asked = pc.equal(held.column("as_query"), True)
        out: list[tuple[np.ndarray, ...]] = []
        if held.num_rows:
            x = _matrix(held.column("vec"), np.float32)
            dcid, dim = held.column("cid").to_numpy(), x.shape[1]
            own = asked.to_numpy(zero_copy_only=False)
            qx, qcid = x[own], dcid[own]
            if others.num_rows:
                qx = np.concatenate([qx, unshort(_matrix(others.column("short"), np.uint8))])
                qcid = np.concatenate([qcid, others.column("cid").to_numpy()])
            signs = (np.unpackbits(_matrix(held.column("code"), np.uint8), axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))
            length, self_ip, with_c = (held.column(s).to_numpy() for s in ("length", "self_ip", "with_c"))
            self_ip = np.maximum(self_ip, 1e-6)
            scale = (length / self_ip)[None, :]
            spread = (eps * length * np.sqrt(np.maximum(1 - self_ip**2, 0) / max(dim - 1, 1)) / self_ip)[None, :]
            step = max(1, 2_000_000 // len(x))
            for i in range(0, len(qx), step):
                qs, qc = qx[i : i + step], qcid[i : i + step]
                r = qs - c
                # <x, q> = <c, q> + <r_x, q - c> + <r_x, c>, the middle one estimated from the bits
                about = ((r @ index.turn.T) @ signs.T) * scale + (qs @ c)[:, None] + with_c[None, :]
                err = spread * np.linalg.norm(r, axis=1)[:, None] + MARGIN
                upper = about + err
                upper[qc[:, None] == dcid[None, :]] = -9
                want = upper >= (-2 if least is None else least)
                if len(x) > k + 1 and least is None:
                    lower = np.where(upper < -8, -9, about - err)
                    want &= upper >= np.partition(lower, len(x) - k, axis=1)[:, len(x) - k][:, None]
                qi, di = np.nonzero(want)
                if not len(qi):
                    continue
                sim = np.concatenate([np.einsum("ij,ij->i", qs[qi[j : j + 65536]], x[di[j : j + 65536]], dtype=np.float64) for j in range(0, len(qi), 65536)])
                if least is not None:
                    fit = sim >= least - MARGIN
                    qi, di, sim = qi[fit], di[fit], sim[fit]
                order = np.lexsort((dcid[di], -sim, qi))
                qi, di, sim = qi[order], di[order], sim[order]
                start = np.flatnonzero(np.diff(qi, prepend=-1))
                rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.append(start, len(qi))))
                top = rank < k
                out.append((qc[qi[top]], dcid[di[top]], sim[top]))
        q, d, s = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, kind) for j, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
        return pa.table({"field": pa.array(np.full(len(q), f, np.int32)), "q": q, "d": d, "sim": s})

    return run


def nearest(classes: DataFrame, k: int, least: float | None = None, probes: int = 8, eps: float = 1.9) -> DataFrame:
    """(field, q, d, sim): the k most similar other vectors of each vector, best first, ties by the lower id.

    ``classes`` holds (field int, cid long, vec binary), unit vectors that differ within a field, as written by
    ``vector_classes``; it is read several times. ``least`` asks only for vectors at least so similar. ``probes`` lists
    are searched for each vector, and with ``least`` all lists in which there may be such vectors (see ``_within``);
    ``eps`` scales the error bound (1.9: it holds for nearly all pairs). A pair found from one side counts for the other
    too; the similarities of what was found are computed anew from the whole vectors. There are about sqrt(n) lists,
    fitted on a bounded sample (see ``centroids``); lists that come out far above the average are divided again as long as
    that helps, and what is still large is searched in blocks.
    """
    spark = classes.sparkSession
    ship(spark)
    sizes = {r.field: r["count"] for r in classes.groupBy("field").count().collect()}
    index = Index({}, rotation(1), {})
    for f, n in sorted(sizes.items()):
        index.centroids[f] = centroids(classes.filter(F.col("field") == f), n, max(1, round(n**0.5)))
        index.turn = rotation(index.centroids[f].shape[1])
    before = math.inf
    while True:
        seen = classes.mapInArrow(_lists(index, probes, least), "list int, n long, asked long").groupBy("list").agg(F.sum("n").alias("n"), F.sum("asked").alias("asked")).collect()
        hot = {r.list: r.n for r in seen if r.n > max(BLOCK, HOT * sizes[r.list // FIELD] / len(index.centroids[r.list // FIELD]))}
        mass = sum(hot.values())
        if mass > 0.9 * before or not hot:
            break
        before, index = mass, _divide(classes, index, hot, sizes)
    index.blocks = {f: (np.ones(len(c), np.int64), np.ones(len(c), np.int64)) for f, c in index.centroids.items()}
    for r in seen:
        if r.n > 2 * BLOCK:
            for blocks, many in zip(index.blocks[r.list // FIELD], (r.n, r.asked)):
                blocks[r.list % FIELD] = -(-many // BLOCK)
    placed = classes.mapInArrow(_place(index, probes, least), PLACED)
    found = placed.groupBy("list", "dblk", "qblk").applyInArrow(_search(index, k, least, eps), "field int, q long, d long, sim double")
    found = _checked(cut(found.select("field", F.least("q", "d").alias("q"), F.greatest("q", "d").alias("d")).distinct()), classes)
    found = cut(found if least is None else found.filter(F.col("sim") >= least))
    found = found.unionByName(found.select("field", F.col("d").alias("q"), F.col("q").alias("d"), "sim"))
    w = Window.partitionBy("field", "q").orderBy(F.desc("sim"), "d")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k).drop("rn")


def _checked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(field, q, d, sim) of pairs (field, q, d), from both whole vectors. Few pairs are broadcast, others shuffled."""
    few = pairs.count() <= SMALL
    side = lambda c: classes.select("field", F.col("cid").alias(c), F.col("vec").alias("v" + c))
    hint = F.broadcast if few else (lambda df: df)
    one = cut(side("q").join(hint(pairs), ["field", "q"]))
    both = side("d").join(hint(one) if few and one.count() <= SMALL // 10 else one, ["field", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", _matrix(b.column("vq"), np.float32), _matrix(b.column("vd"), np.float32), dtype=np.float64) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("q"), b.column("d"), pa.array(s)], names=["field", "q", "d", "sim"])

    return both.select("field", "q", "d", "vq", "vd").mapInArrow(run, "field int, q long, d long, sim double")


def _divide(classes: DataFrame, index: Index, hot: dict[int, int], sizes: dict[int, int]) -> Index:
    """More centroids inside lists that hold far more than the average, fitted on a bounded sample of those lists."""
    known = index

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            field, vec = b.column("field").to_numpy(), b.column("vec")
            for f, c in known.centroids.items():
                on = np.flatnonzero(field == f)
                if len(on):
                    v = vec.take(pa.array(on))
                    near = (_matrix(v, np.float32) @ c.T).argmax(axis=1) + f * FIELD
                    held = np.flatnonzero(np.isin(near, list(hot)))
                    yield pa.RecordBatch.from_arrays([pa.array(near[held].astype(np.int32)), v.take(pa.array(held))], names=["list", "vec"])

    most = TRAIN_A_LIST * sum(round(n * len(index.centroids[at // FIELD]) / sizes[at // FIELD]) for at, n in hot.items())
    rows = by_hash(classes.mapInArrow(only, "list int, vec binary"), "vec", sum(hot.values()), min(TRAIN, most)).toArrow()
    lists, x = rows.column("list").to_numpy(), _matrix(rows.column("vec"), np.float32)
    order = np.argsort(lists, kind="stable")
    names, first = np.unique(lists[order], return_index=True)
    held = dict(zip(names.tolist(), np.split(x[order], first[1:])))
    parts: dict[int, list[np.ndarray]] = {f: [] for f in index.centroids}
    for f, c in index.centroids.items():
        average = max(1, sizes[f] / len(c))
        for i in range(len(c)):
            some = held.get(f * FIELD + i)
            want = min(round(hot.get(f * FIELD + i, 0) / average), len(some) // 8 if some is not None else 0)
            parts[f].append(kmeans(some, want) if want > 1 else c[i : i + 1])
    return Index({f: np.concatenate(p) for f, p in parts.items()}, index.turn, {})


def vector_classes(units: DataFrame) -> DataFrame:
    """(field, cid, vec, n, rep): groups of exact copies with their number and smallest key."""
    return cut(units.groupBy("field", "vec").agg(F.count("*").alias("n"), F.min("id").alias("rep")).select("field", F.monotonically_increasing_id().alias("cid"), "vec", "n", "rep"))


def members(units: DataFrame, classes: DataFrame, most: int | None = None) -> DataFrame:
    """(field, cid, id, r, n): keys of each class, all or the ``most`` smallest, numbered from 1 in order of the keys.

    The numbering is made within salts first, so that a class of very many copies is not sorted in one task; with
    ``most`` None ``r`` is null beyond that. Classes of more than MANY copies, of which there are few, are joined by
    broadcast, as long as they are at most A_BROADCAST.
    """
    alone = classes.filter("n = 1").select("field", "cid", F.col("rep").alias("id"), F.lit(1).alias("r"), "n")
    several = classes.filter("n > 1").select("field", "cid", "vec", "n")
    hot = several.filter(F.col("n") > MANY)
    if 0 < hot.limit(A_BROADCAST + 1).count() <= A_BROADCAST:
        held = units.join(F.broadcast(hot), ["field", "vec"]).unionByName(units.join(several.filter(F.col("n") <= MANY), ["field", "vec"]))
    else:
        held = units.join(several, ["field", "vec"])
    held = held.select("field", "cid", "id", "n", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    if most is None:
        return alone.unionByName(held.select("field", "cid", "id", F.lit(None).cast("int").alias("r"), "n"))
    a = Window.partitionBy("field", "cid", "salt").orderBy("id")
    b = Window.partitionBy("field", "cid").orderBy("id")
    some = held.withColumn("r", F.row_number().over(a)).filter(F.col("r") <= most).withColumn("r", F.row_number().over(b)).filter(F.col("r") <= most)
    return alone.unionByName(some.select("field", "cid", "id", "r", "n"))


def similar_pairs(rows: DataFrame, key: str, fields: list[str], k: int = 5, least: float = 0.92, dim: int = 64, probes: int = 8, eps: float = 1.9) -> DataFrame:
    """(vector_field, card_a, card_b): pairs at least ``least`` similar of which one is among the other's k most similar.

    card_a < card_b by bytes; of equally similar vectors that differ those with the lower class number come first. Exact copies are searched once as
    a class. Each has its first k fellow copies as its most similar; what is left of k is filled from other classes.
    Unusable vectors (see ``unit_vectors``) take no part; empty tables give no rows.
    """
    units = cut(unit_vectors(rows, key, fields, dim))
    classes = vector_classes(units)
    near = cut(nearest(classes, k, least, probes, eps))
    first = cut(members(units, classes, k + 1))
    copies = classes.filter("n > 1")
    everyone = members(units, copies).filter("n > 1").select("field", "cid", F.col("id").alias("x"))
    mates = everyone.join(first.select("field", "cid", F.col("id").alias("y"), "r"), ["field", "cid"]).filter("x <> y")
    # Within a class: the first k that are not oneself. One that stands among the first k + 1 gives way to the last.
    own = first.filter("n > 1").select("field", "cid", F.col("id").alias("x"), F.col("r").alias("rx"))
    mates = mates.join(own, ["field", "cid", "x"], "left").filter((F.col("r") <= k) | ((F.col("r") == k + 1) & (F.col("rx") <= k)))
    inside = mates.select("field", F.col("x").alias("a"), F.col("y").alias("b"))
    n_of = lambda c: classes.select("field", F.col("cid").alias(c), F.col("n").alias("n_" + c), F.col("rep").alias("rep_" + c))
    w = Window.partitionBy("field", "q").orderBy(F.desc("sim"), "rep_d").rowsBetween(Window.unboundedPreceding, -1)
    takes = near.join(n_of("q"), ["field", "q"]).filter(F.col("n_q") <= k).join(n_of("d"), ["field", "d"])
    takes = takes.withColumn("left", F.lit(k) - (F.col("n_q") - 1) - F.coalesce(F.sum("n_d").over(w), F.lit(0))).filter("left > 0")
    part = lambda c, to: first.select("field", F.col("cid").alias(c), F.col("id").alias(to), F.col("r").alias("r_" + to))
    across = takes.join(part("q", "a"), ["field", "q"]).join(part("d", "b"), ["field", "d"]).filter(F.col("r_b") <= F.col("left")).select("field", "a", "b")
    name = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    return inside.unionByName(across).select(name.alias("vector_field"), F.least("a", "b").alias("card_a"), F.greatest("a", "b").alias("card_b")).distinct()
