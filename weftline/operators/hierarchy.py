"""Parent-child links to full hierarchies: Euler tours with parallel list ranking.

Leaves and roots are peeled off until only what hangs on circles is left, where strongly connected components tell the
tags that are their own ancestors. Every node then keeps one parent outside its circle as its tree parent, which cannot
close a circle; the tour around this forest is ranked by pointer jumping in O(log n) rounds, whatever the depth, and
gives each node an entry, an exit and a depth. ``a`` is an ancestor of ``x`` in the forest if its interval holds the
entry of ``x``. The links left over (further parents, links within circles) lead from inside one subtree to another
subtree's top; they form a small graph of such tops, over which reach and distances are carried on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import Cut, cut, ship

LOCAL = 65_536  # links of the core, what is left by peeling, up to which its components are found in one task
SPREAD = 16  # points of a dyadic block of level SPREAD or less are one key; larger blocks are salted to as many each
FAN = 64  # buckets into which the children of one parent are spread
TOP = -1  # the node above all tree roots


def canonical_slug(c: Column) -> Column:
    """Slugs compare trimmed and in lower case; blank ones are null."""
    s = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(s != "", s)


def links(tags: DataFrame, key: str, parents: str, children: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, slug) and links (p, c, ps), each once; links told by either side, both ends known."""
    nodes = cut(tags.select(canonical_slug(F.col(f"`{key}`")).alias("slug")).filter("slug is not null").distinct().select(F.monotonically_increasing_id().alias("id"), "slug"))
    up = tags.select(canonical_slug(F.col(f"`{key}`")).alias("cs"), F.explode(f"`{parents}`").alias("x")).select(canonical_slug(F.col("x")).alias("ps"), "cs")
    down = tags.select(canonical_slug(F.col(f"`{key}`")).alias("ps"), F.explode(f"`{children}`").alias("x")).select("ps", canonical_slug(F.col("x")).alias("cs"))
    told = up.unionByName(down).distinct()
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("slug").alias(end + "s"))
    return nodes, cut(told.join(of("p"), "ps").join(of("c"), "cs").select("p", "c", "ps"))


def _components_here(t: pa.Table) -> pa.Table:
    """The components of a small core, depth first; the same as by joins."""
    ends = np.stack([t.column("p").to_numpy(), t.column("c").to_numpy()])
    ids, at = np.unique(ends, return_inverse=True)
    p, c = at.reshape(2, -1)
    kids: dict[int, list[int]] = {}
    for x, y in zip(p.tolist(), c.tolist()):
        kids.setdefault(x, []).append(y)
    low: dict[int, int] = {}
    index: dict[int, int] = {}
    trail: list[int] = []
    open_: set[int] = set()
    node, scc = [], []
    for start in kids:
        if start in index:
            continue
        work = [(start, iter(kids[start]))]
        index[start] = low[start] = len(index)
        trail.append(start)
        open_.add(start)
        while work:
            x, rest = work[-1]
            for y in rest:
                if y not in index:
                    index[y] = low[y] = len(index)
                    trail.append(y)
                    open_.add(y)
                    work.append((y, iter(kids.get(y, ()))))
                    break
                if y in open_:
                    low[x] = min(low[x], index[y])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[x])
                if low[x] == index[x]:
                    part = []
                    while not part or part[-1] != x:
                        part.append(trail.pop())
                        open_.discard(part[-1])
                    if len(part) > 1:
                        node += part
                        scc += [min(part)] * len(part)
    return pa.table({"id": ids[np.array(node, np.int64)] if node else np.zeros(0, np.int64), "scc": ids[np.array(scc, np.int64)] if scc else np.zeros(0, np.int64)})


def circles(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(id, scc): nodes on circles of two or more links, scc being the same for the nodes of one component.

    Leaves and roots are peeled off in rounds of joins until only the core is left, what lies on or between circles.
    """
    found: list[DataFrame] = []

    def peel(e: Cut) -> tuple[Cut, int]:
        n = e.df.count()
        while n:
            df = e.df
            for _ in range(3):
                df = df.join(df.select(F.col("p").alias("c")).distinct(), "c", "left_semi").join(df.select(F.col("c").alias("p")).distinct(), "p", "left_semi")
            less = Cut(df.select("p", "c"))
            m = less.df.count()
            e.drop()
            e = less
            if m == n:
                break
            n = m
        return e, n

    core, left = peel(Cut(edges.filter("p <> c").select("p", "c").distinct()))
    if left <= local:
        ship(edges.sparkSession)
        return core.df.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_components_here, "id long, scc long")
    while left:
        e = core.df
        colour = Cut(e.select(F.col("p").alias("id")).union(e.select("c")).distinct().withColumn("k", F.col("id")))
        while True:  # the smallest id that reaches each node
            had = colour.df
            told = e.join(had.withColumnRenamed("id", "p"), "p").groupBy(F.col("c").alias("id")).agg(F.min("k").alias("k2"))
            new = Cut(had.join(told, "id", "left").select("id", F.least("k", F.coalesce("k2", "k")).alias("k"), (F.col("k2") < F.col("k")).alias("moved")))
            colour.drop()
            colour = new
            if new.df.filter("moved").isEmpty():
                break
        k = colour.df.select("id", "k")
        inner = cut(e.join(k.select(F.col("id").alias("p"), F.col("k").alias("kp")), "p").join(k.select(F.col("id").alias("c"), F.col("k").alias("kc")), "c").filter("kp = kc").select("p", "c", F.col("kp").alias("k")))
        back = Cut(k.filter("id = k").select("id", "k"))
        size = -1
        while (n := back.df.count()) != size:  # what reaches that smallest id within its colour
            size = n
            back = Cut(back.df.union(inner.join(back.df.select(F.col("id").alias("c")), "c").select(F.col("p").alias("id"), "k")).distinct())
        # A node that only lies between circles is a component of its own.
        found.append(cut(back.df.withColumn("n", F.count("*").over(Window.partitionBy("k"))).filter("n > 1").select("id", F.col("k").alias("scc"))))
        rest = e.join(back.df.select(F.col("id").alias("p")), "p", "left_anti").join(back.df.select(F.col("id").alias("c")), "c", "left_anti")
        core, left = peel(Cut(rest))
    out = edges.sparkSession.createDataFrame([], "id long, scc long")
    for f in found:
        out = out.unionByName(f)
    return out


def euler(tree: DataFrame) -> DataFrame:
    """(id, entry, exit, depth) of every node of a forest given as (c, p), tree roots having the parent TOP.

    The arcs of the tour (down to a node, up from it) form one linked list, ranked by pointer jumping: each round every
    arc adds the count and the depth change of the arc it points at and points where that one pointed. Siblings are
    linked within buckets, and the buckets of a parent in turn, so that a parent with very many children is no hot key.
    """
    kids = tree.select("p", "c", F.pmod(F.xxhash64("c"), F.lit(FAN)).cast("int").alias("b"))
    w = Window.partitionBy("p", "b").orderBy("c")
    linked = cut(kids.select("p", "c", "b", F.lead("c").over(w).alias("next"), (F.row_number().over(w) == 1).alias("lead")))
    firsts = linked.filter("lead").select("p", "b", "c")
    v = Window.partitionBy("p").orderBy("b")
    heads = cut(firsts.select("p", "b", "c", F.lead("c").over(v).alias("after"), (F.row_number().over(v) == 1).alias("lead")))
    oldest = heads.filter("lead").select(F.col("p").alias("c"), F.col("c").alias("first"))
    even, odd = lambda c: F.col(c) * 2, lambda c: F.col(c) * 2 + 1
    down = linked.join(oldest, "c", "left").select(even("c").alias("arc"), F.coalesce(even("first"), odd("c")).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w"))
    up = linked.join(heads.select("p", "b", "after"), ["p", "b"]).select(
        odd("c").alias("arc"),
        F.coalesce(even("next"), even("after"), F.when(F.col("p") != TOP, odd("p"))).alias("nxt"),
        F.lit(1).cast("long").alias("n"),
        F.lit(-1).cast("long").alias("w"),
    )
    at = Cut(down.unionByName(up))
    while True:
        df = at.df
        for _ in range(2):
            to = df.select(F.col("arc").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("n").alias("n2"), F.col("w").alias("w2"))
            nil = F.lit(0).cast("long")
            df = df.join(to, "nxt", "left").select("arc", F.col("nxt2").alias("nxt"), (F.col("n") + F.coalesce("n2", nil)).alias("n"), (F.col("w") + F.coalesce("w2", nil)).alias("w"))
        jumped = Cut(df)
        at.drop()
        at = jumped
        if at.df.filter("nxt is not null").isEmpty():
            break
    # n counts the arcs from here to the end, so a larger n comes earlier; the changes from here on add up to -depth.
    total = at.df.agg(F.max("n")).first()[0] or 0
    pos = F.lit(total) - F.col("n")
    node = F.shiftright("arc", 1)
    is_down = F.col("arc") % 2 == 0
    return cut(at.df.groupBy(node.alias("id")).agg(F.max(F.when(is_down, pos)).alias("entry"), F.max(F.when(~is_down, pos)).alias("exit"), F.max(F.when(is_down, -F.col("w"))).alias("depth")))


def within(inner: DataFrame, point: str, outer: DataFrame, lo: str, hi: str, top: int) -> DataFrame:
    """Join each point of ``inner`` with the intervals of ``outer`` that hold it: an equi-join on dyadic blocks.

    An interval is cut into at most two blocks a level; a point lies in one block a level; they meet exactly once.
    A block of more than 2 ** SPREAD places is salted, so that the few blocks that hold most points are no hot keys.
    """
    levels = max(1, int(top).bit_length() + 1)
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    size, salts = F.expr("shiftleft(1L, lv)"), F.expr(f"shiftleft(1L, greatest(lv - {SPREAD}, 0))")
    o = outer.withColumn("lv", lv).withColumn("k1", F.ceil(F.col(lo) / size)).withColumn("k2", F.floor((F.col(hi) + 1) / size) - 1).filter("k1 <= k2").withColumn("blk", F.explode(F.array_distinct(F.array("k1", "k2"))))
    above = F.floor(F.col("blk") / 2)
    o = o.filter(~((above * 2 * size >= F.col(lo)) & ((above + 1) * 2 * size - 1 <= F.col(hi)))).drop("k1", "k2").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    # Only levels on which intervals lie, at most some sixty.
    used = [r.lv for r in o.select("lv").distinct().collect()]
    i = inner.withColumn("lv", F.explode(F.lit(used or [0]))).withColumn("blk", F.floor(F.col(point) / size)).withColumn("salt", F.pmod(F.xxhash64(point), salts))
    return i.join(o, ["lv", "blk", "salt"]).drop("lv", "blk", "salt")


@dataclass
class Hierarchy:
    nodes: DataFrame  # id, slug, entry, exit, depth (in the forest), tree parent p or TOP, is_root
    edges: DataFrame  # p, c, ps
    extra: DataFrame  # p, c: links that are not in the forest
    scc: DataFrame  # id, scc
    top: int

    def cyclic(self) -> DataFrame:
        """(slug, smallest): tags that are their own ancestors, and the smallest slug of their circle."""
        loops = self.edges.filter("p = c").select(F.col("c").alias("id")).join(self.scc, "id", "left_anti").withColumn("scc", F.col("id"))
        on = self.scc.unionByName(loops).join(self.nodes.select("id", "slug"), "id")
        return on.join(on.groupBy("scc").agg(F.min("slug").alias("smallest")), "scc").select("slug", "smallest")

    def portals(self) -> DataFrame:
        """(id, entry, exit, depth): the roots, and the tops of subtrees that links outside the forest lead to."""
        ids = self.extra.select(F.col("c").alias("id")).union(self.nodes.filter("is_root").select("id")).distinct()
        return cut(self.nodes.join(ids, "id", "left_semi").select(F.col("id").alias("portal"), F.col("entry").alias("lo"), F.col("exit").alias("hi"), F.col("depth").alias("pd")))

    def reach(self, paths: bool = False) -> DataFrame:
        """(slug, root_slug, depth): each tag and each root it is reached from, with the fewest links between.

        ``paths`` adds ``path``, the slugs of one such shortest way (the smallest one found), joined by " > ".
        """
        portals = self.portals()
        tails = self.extra.join(self.nodes.select(F.col("id").alias("p"), F.col("entry").alias("e"), F.col("depth").alias("d")), "p")
        # From subtree top to subtree top: down inside the forest to a link's tail, then over the link.
        hops = within(tails, "e", portals, "lo", "hi", self.top).select("portal", F.col("c").alias("to"), (F.col("d") - F.col("pd") + 1).alias("step"), "p", "pd")
        trail = self.trails() if paths else None
        if trail is not None:
            cslug = self.nodes.select(F.col("id").alias("to"), F.col("slug").alias("to_slug"))
            hops = hops.join(trail.select(F.col("id").alias("p"), "trail"), "p").join(cslug, "to").select("portal", "to", "step", F.concat(F.expr("slice(trail, pd + 2, greatest(size(trail) - pd - 1, 0))"), F.array("to_slug")).alias("leg"))
        hops = cut(hops.drop("p", "pd") if trail is None else hops)
        start = self.nodes.filter("is_root").select(F.col("id").alias("root"), F.col("id").alias("portal"), F.lit(0).cast("long").alias("dist"), *([F.array("slug").alias("way")] if paths else []))
        best = front = Cut(start)
        keys = ["root", "portal"]
        pick = F.min(F.struct("dist", "way") if paths else F.struct("dist")).alias("m")
        while True:
            step = front.df.join(hops, "portal").select("root", F.col("to").alias("portal"), (F.col("dist") + F.col("step")).alias("dist"), *([F.concat("way", "leg").alias("way")] if paths else []))
            step = step.groupBy(*keys).agg(pick).select(*keys, "m.*")
            known = best.df.select(*keys, F.col("dist").alias("old"))
            new = Cut(step.join(known, keys, "left").filter("old is null or dist < old").drop("old"))
            if front is not best:
                front.drop()
            front = new
            if front.df.isEmpty():
                break
            more = Cut(best.df.unionByName(front.df).groupBy(*keys).agg(pick).select(*keys, "m.*"))
            best.drop()
            best = more
        inside = within(self.nodes.select("id", "entry", "depth"), "entry", portals, "lo", "hi", self.top)
        far = inside.join(best.df, "portal").select("root", "id", "portal", "pd", (F.col("dist") + F.col("depth") - F.col("pd")).alias("depth"), *(["way"] if paths else []))
        if trail is not None:
            far = far.join(trail, "id").withColumn("path", F.array_join(F.concat("way", F.expr("slice(trail, pd + 2, greatest(size(trail) - pd - 1, 0))")), " > "))
        m = F.min(F.struct("depth", "path") if paths else F.struct("depth")).alias("m")
        far = far.groupBy("root", "id").agg(m).select("root", "id", "m.*")
        name = lambda end, to: self.nodes.select(F.col("id").alias(end), F.col("slug").alias(to))
        return far.join(name("id", "slug"), "id").join(name("root", "root_slug"), "root").select("slug", "root_slug", "depth", *(["path"] if paths else []))

    def intervals(self) -> DataFrame:
        """(slug, entry, exit, depth, top, extra_parents): the hierarchy without any pair of tags written out.

        ``a`` is an ancestor of ``x`` in the forest if ``a.entry <= x.entry <= a.exit``; ``top`` tells the tags that have
        no tree parent, ``extra_parents`` the parents by links that are not in the forest.
        """
        name = self.nodes.select(F.col("id").alias("p"), F.col("slug").alias("parent"))
        more = self.extra.join(name, "p").groupBy(F.col("c").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("extra_parents"))
        return self.nodes.join(more, "id", "left").select("slug", "entry", "exit", "depth", (F.col("p") == TOP).alias("top"), F.coalesce("extra_parents", F.lit("")).alias("extra_parents"))

    def trails(self) -> DataFrame:
        """(id, trail): the slugs from the forest's root down to the node, by its ancestors' intervals."""
        outer = self.nodes.select(F.col("slug").alias("s"), F.col("entry").alias("lo"), F.col("exit").alias("hi"), F.col("depth").alias("d"))
        pairs = within(self.nodes.select("id", "entry"), "entry", outer, "lo", "hi", self.top)
        return cut(pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("z")).select("id", F.col("z.s").alias("trail")))

    def descendants(self) -> DataFrame:
        """(slug, descendant): every tag below another over any links; a tag on a circle is below itself."""
        portals = self.portals()
        mine = self.nodes.select(F.col("id").alias("a"), F.col("entry").alias("lo"), F.col("exit").alias("hi"))
        tails = self.extra.join(self.nodes.select(F.col("id").alias("p"), F.col("entry").alias("e")), "p")
        over = cut(within(tails, "e", mine, "lo", "hi", self.top).select("a", F.col("c").alias("portal")).distinct())
        hops = over.select(F.col("a").alias("portal"), F.col("portal").alias("to"))
        best = front = Cut(over)
        while True:
            step = front.df.join(hops, "portal").select("a", F.col("to").alias("portal")).distinct()
            new = Cut(step.join(best.df, ["a", "portal"], "left_anti"))
            if front is not best:
                front.drop()
            front = new
            if front.df.isEmpty():
                break
            more = Cut(best.df.unionByName(front.df))
            best.drop()
            best = more
        points = self.nodes.select("id", "entry")
        tree = within(points, "entry", mine, "lo", "hi", self.top).filter("a <> id").select("a", "id")
        sub = within(points, "entry", portals, "lo", "hi", self.top).select("portal", "id")
        loops = self.edges.filter("p = c").select(F.col("p").alias("a"), F.col("c").alias("id"))
        pairs = tree.unionByName(best.df.join(sub, "portal").select("a", "id")).unionByName(loops).distinct()
        name = lambda end, to: self.nodes.select(F.col("id").alias(end), F.col("slug").alias(to))
        return pairs.join(name("a", "slug"), "a").join(name("id", "descendant"), "id").select("slug", "descendant")


def hierarchy(tags: DataFrame, key: str = "_id", parents: str = "parent_slugs", children: str = "child_slugs", local: int = LOCAL) -> Hierarchy:
    """The forest, the links outside it and the circles of a table of tags.

    A link exists if any row of either end tells it and both ends are keys of the table. Null and blank slugs are
    ignored, repeated rows and links count once, null arrays are empty. A root has no parent, not even itself. An empty
    table gives an empty hierarchy. Further columns are not read.
    """
    nodes, edges = links(tags, key, parents, children)
    scc = cut(circles(edges, local))
    at = lambda end, to: scc.select(F.col("id").alias(end), F.col("scc").alias(to))
    free = edges.filter("p <> c").join(at("p", "sp"), "p", "left").join(at("c", "sc"), "c", "left").filter("sp is null or sc is null or sp <> sc")
    chosen = cut(free.groupBy("c").agg(F.min(F.struct("ps", "p")).alias("m")).select("c", F.col("m.p").alias("p")))
    tree = cut(nodes.select(F.col("id").alias("c")).join(chosen, "c", "left").select("c", F.coalesce("p", F.lit(TOP).cast("long")).alias("p")))
    extra = cut(edges.filter("p <> c").select("p", "c").join(chosen, ["p", "c"], "left_anti"))
    toured = euler(tree)
    child = edges.select(F.col("c").alias("id"), F.lit(False).alias("free")).distinct()
    full = cut(nodes.join(toured, "id").join(tree.withColumnRenamed("c", "id"), "id").join(child, "id", "left").select("id", "slug", "entry", "exit", "depth", "p", F.coalesce("free", F.lit(True)).alias("is_root")))
    top = full.agg(F.max("exit")).first()[0] or 0
    return Hierarchy(full, edges, extra, scc, top)
