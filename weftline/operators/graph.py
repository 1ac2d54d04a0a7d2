"""Closures and components of small hierarchies and similarity graphs, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import Cut, cut


def closure(edges: DataFrame) -> DataFrame:
    """(a, b): all pairs with a way of one or more links from a to b, circles included.

    Ways double in length each round, so a chain of n links takes log2(n) rounds. Only pairs found in the last round are
    carried on: whatever is twice as far has one of them halfway.
    """
    at = new = Cut(edges.select("a", "b").filter("a is not null and b is not null").distinct())
    while True:
        step = new.df.select("a", F.col("b").alias("m")).join(at.df.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
        found = Cut(step.join(at.df, ["a", "b"], "left_anti"))
        if found.df.isEmpty():
            return at.df
        more = Cut(at.df.unionByName(found.df))
        at.drop()
        if new is not at:
            new.drop()
        at, new = more, found


def descendants(catalogue: DataFrame) -> DataFrame:
    """(slug, member): each slug with itself and all that its child links lead to; unknown slugs dropped, circles safe."""
    known = catalogue.select("slug")
    edges = catalogue.select(F.col("slug").alias("a"), F.explode("children").alias("b")).join(known.withColumnRenamed("slug", "b"), "b", "left_semi")
    return closure(edges).select(F.col("a").alias("slug"), F.col("b").alias("member")).union(known.select("slug", F.col("slug").alias("member"))).distinct()


def roots(catalogue: DataFrame) -> DataFrame:
    """(slug, root): the parentless slugs each slug's parent links lead to; a parentless one is its own."""
    top = catalogue.filter(F.size("parents") == 0).select(F.col("slug").alias("root"))
    known = catalogue.select(F.col("slug").alias("b"))
    edges = catalogue.select(F.col("slug").alias("a"), F.explode("parents").alias("b")).join(known, "b", "left_semi")
    up = closure(edges).select(F.col("a").alias("slug"), F.col("b").alias("root")).join(top, "root", "left_semi").select("slug", "root")
    return up.union(top.select("root", "root")).distinct()


def components(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, name, keeper): connected components within each group; the keeper has the largest (weight, name).

    ``nodes`` is (group, name, weight), ``edges`` (group, a, b). The largest key spreads until nothing changes.
    """
    both = cut(edges.select(group, "a", "b").union(edges.select(group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = Cut(nodes.select(group, "name", F.struct("weight", "name").alias("key"), F.lit(True).alias("moved")))
    while True:
        told = both.join(at.df.select(group, F.col("name").alias("b"), F.col("key").alias("k")), [group, "b"]).groupBy(group, F.col("a").alias("name")).agg(F.max("k").alias("k"))
        new = Cut(at.df.join(told, [group, "name"], "left").select(group, "name", F.when(F.col("k") > F.col("key"), F.col("k")).otherwise(F.col("key")).alias("key"), F.coalesce(F.col("k") > F.col("key"), F.lit(False)).alias("moved")))
        if new.df.filter("moved").isEmpty():
            return new.df.select(group, "name", F.col("key.name").alias("keeper"))
        at.drop()
        at = new
