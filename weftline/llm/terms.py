"""How often every term occurs, and in how many records: burst tries merged across workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.sampling import hashed
from weftline.runtime import ship

BURST = 256  # terms that a container holds before it bursts into one for each next character
FLUSH = 200_000  # distinct terms that a worker holds before it sends its trie on
ROUTE_SAMPLE = 1 << 20  # at most so many distinct terms, by hash, from which routing prefixes are taken; it decides only who merges what
ROUTE_TERMS = 32  # terms of the sample that one route stands for
A_ROUTE = 32_768  # distinct terms of one route, about, whatever the vocabulary
SUBTREE = "route string, shared array<int>, tails array<string>, occ array<long>, rec array<long>"


def clean_terms(c: Column) -> Column:
    """Values trimmed and in lower case; nulls and blanks are none. A null array is empty."""
    low = F.transform(c, lambda x: F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    return F.coalesce(F.filter(low, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


class BurstTrie:
    """Terms with two counters each. Inner nodes branch by character; leaves are containers of suffixes that burst."""

    def __init__(self, burst: int = BURST):
        self.burst, self.root, self.size = burst, {}, 0
        self.inner: set[int] = set()

    def add(self, term: str, occ: int, rec: int) -> None:
        node, at = self.root, 0
        while id(node) in self.inner and at < len(term):
            node = node.setdefault(term[at], {})
            at += 1
        # At an inner node the term that ends there has the suffix "".
        cell = node.get(term[at:])
        if cell is None:
            node[term[at:]] = [occ, rec]
            self.size += 1
            if id(node) not in self.inner and len(node) > self.burst:
                self._split(node)
        else:
            cell[0] += occ
            cell[1] += rec

    def _split(self, node: dict) -> None:
        held = list(node.items())
        node.clear()
        self.inner.add(id(node))
        for suffix, cell in held:
            if suffix:
                node.setdefault(suffix[0], {})[suffix[1:]] = cell
            else:
                node[""] = cell

    def leaves(self) -> Iterator[str]:
        """Prefixes of the containers."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if id(node) in self.inner:
                todo.extend((prefix + ch, sub) for ch, sub in node.items() if ch)
                yield prefix
            else:
                yield prefix

    def items(self) -> Iterator[tuple[str, int, int]]:
        """In order of the terms."""
        todo = [("", self.root)]
        while todo:
            prefix, node = todo.pop()
            if id(node) in self.inner:
                if "" in node:
                    yield prefix, *node[""]
                todo.extend((prefix + ch, node[ch]) for ch in sorted(node, reverse=True) if ch)
            else:
                for suffix in sorted(node):
                    yield prefix + suffix, *node[suffix]


def routes_of(terms: list[str], leaf: int = ROUTE_TERMS) -> list[str]:
    """Prefixes that divide the terms into parts of about ``leaf``; a term goes to its longest one."""
    trie = BurstTrie(leaf)
    for t in terms:
        trie.add(t, 1, 1)
    return sorted(set(trie.leaves()) | {""})


def _subtrees(trie: BurstTrie, routes: set[str], longest: int) -> pa.RecordBatch:
    """One row for each route: its terms front-coded (length shared with the term before, tail), and their counters."""
    rows: dict[str, list[tuple[str, int, int]]] = {}
    for term, occ, rec in trie.items():
        n = min(longest, len(term))
        while term[:n] not in routes:
            n -= 1
        rows.setdefault(term[:n], []).append((term, occ, rec))
    cols: list[list] = [[], [], [], [], []]
    for route, held in rows.items():
        shared, tails, last = [], [], ""
        for term, _, _ in held:
            n, most = 0, min(len(term), len(last))
            while n < most and term[n] == last[n]:
                n += 1
            shared.append(n)
            tails.append(term[n:])
            last = term
        for c, v in zip(cols, (route, shared, tails, [h[1] for h in held], [h[2] for h in held])):
            c.append(v)
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["route", "shared", "tails", "occ", "rec"])


def _count(routes: list[str]):
    known, longest = set(routes), max(map(len, routes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie()
        for b in batches:
            occ = pc.value_counts(b.column(0).flatten())
            rec = pc.value_counts(b.column(1).flatten())
            held = dict(zip(rec.field(0).to_pylist(), rec.field(1).to_pylist()))
            for term, n in zip(occ.field(0).to_pylist(), occ.field(1).to_pylist()):
                trie.add(term, n, held[term])
            if trie.size > FLUSH:
                yield _subtrees(trie, known, longest)
                trie = BurstTrie()
        if trie.size:
            yield _subtrees(trie, known, longest)

    return run


def _merge(t: pa.Table) -> pa.Table:
    """The subtrees of one route, from all workers, to one."""
    trie = BurstTrie()
    for shared, tails, occ, rec in zip(*(t.column(c).to_pylist() for c in ("shared", "tails", "occ", "rec"))):
        last = ""
        for n, tail, o, r in zip(shared, tails, occ, rec):
            last = last[:n] + tail
            trie.add(last, o, r)
    held = list(trie.items())
    return pa.table({"term": pa.array([h[0] for h in held], pa.string()), "n_occ": pa.array([h[1] for h in held], pa.int64()), "n_rec": pa.array([h[2] for h in held], pa.int64())})


def term_counts(records: DataFrame, terms: str) -> DataFrame:
    """(term, n_occ, n_rec) for every distinct value of an array column; each row is one record.

    Values are compared trimmed and in lower case; nulls, blanks, null and empty arrays count nothing. An empty table
    gives no rows. No other column is read. A worker adds up its own rows before anything is shuffled, so a term in a
    third of all rows costs one row for each worker; terms go to the merging tasks by prefixes as long as the terms are
    dense there.
    """
    ship(records.sparkSession)
    arrays = records.select(clean_terms(F.col(f"`{terms}`")).alias("every")).filter("size(every) > 0").select("every", F.array_distinct("every").alias("once"))
    each = arrays.select(F.explode("once").alias("term"))
    distinct = each.agg(F.approx_count_distinct("term")).first()[0]
    # As many terms as make a route for A_ROUTE of all; with few terms some routes all the same, to spread the merging.
    most = min(ROUTE_SAMPLE, max(ROUTE_TERMS * 64, ROUTE_TERMS * distinct // A_ROUTE))
    top = 2**63 - 1 if distinct <= most else int(-(2**63) + most / distinct * 2**64)
    sample = each.filter(hashed("term") <= F.lit(top)).distinct().limit(2 * most).toArrow().column("term").to_pylist()
    routes = routes_of(sample, max(ROUTE_TERMS, len(sample) * A_ROUTE // max(distinct, 1) if most == ROUTE_SAMPLE else 0))
    return arrays.mapInArrow(_count(routes), SUBTREE).groupBy("route").applyInArrow(_merge, "term string, n_occ long, n_rec long")


def marks(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.08) -> DataFrame:
    """Adds ``mark``: ``rare`` for fewer than ``rare_below`` records, else ``common`` above that share of all, else null."""
    return counts.withColumn("mark", F.when(F.col("n_rec") < rare_below, "rare").when(F.col("n_rec") > common_above * n_records, "common"))
