"""References to records that do not exist, are deleted or come later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import cut

MANY = 1000  # different intervals of one key above which its rows are swept instead of looked up in an array

def canonical_key(c: Column) -> Column:
    """Keys compare without letter case, hyphens and outer blanks; a blank key is null, that is no reference."""
    k = F.lower(F.replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("-"), F.lit("")))
    return F.when(k != "", k)


def unheld(child: DataFrame, parent: DataFrame, row_key: str, ref: str, at: str, parent_key: str, start: str, end: str, many_spans: int = MANY) -> DataFrame:
    """Rows of ``child`` whose reference does not hold at the time of the row: (ref_month, row_key string, kind).

    A reference holds if some parent row of the key has start <= at and (end is null or end > at). ``kind`` is
    ``missing`` if the key has no parent row, ``deleted`` if one started by then, else ``late``. Repeated rows give one
    row. Null and blank keys and rows without a time are no references; a parent row without a start never began, but
    its key is known. Empty tables give no rows. Only the named columns are used, so further columns cannot clash.

    Keys that no parent has come from a left anti-join of the distinct keys; the other keys bring their intervals along
    as an array, and both are joined back to the rows, which are shuffled once. A key of more than MANY intervals is not
    put into one array: its rows are swept in time (see ``_swept``).
    """
    c = (
        child.select(
            F.col(f"`{row_key}`").cast("string").alias("row_key"),
            canonical_key(F.col(f"`{ref}`")).alias("k"),
            F.col(f"`{at}`").alias("t"),
        )
        .filter("k is not null and t is not null and row_key is not null")
    )
    p = cut(
        parent.select(
            canonical_key(F.col(f"`{parent_key}`")).alias("k"),
            F.col(f"`{start}`").alias("s"),
            F.col(f"`{end}`").alias("e"),
        )
        .filter("k is not null")
        .distinct()
    )
    many = p.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > many_spans).select("k")
    hot = not many.isEmpty()
    few = p.join(many, "k", "left_anti") if hot else p
    spans = few.groupBy("k").agg(F.filter(F.collect_list(F.struct("s", "e")), lambda x: x["s"].isNotNull()).alias("spans"))
    gone = c.select("k").distinct().join(p.select("k").distinct(), "k", "left_anti").select("k", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    told = c.join(spans.unionByName(gone), "k")
    begun = F.exists("spans", lambda x: x["s"] <= F.col("t"))
    holds = F.exists("spans", lambda x: (x["s"] <= F.col("t")) & (x["e"].isNull() | (x["e"] > F.col("t"))))
    kind = F.when(F.col("spans").isNull(), "missing").when(begun, "deleted").otherwise("late")
    found = told.filter(F.col("spans").isNull() | ~holds).select(F.date_format("t", "yyyy-MM").alias("ref_month"), "row_key", kind.alias("kind"))
    if hot:
        found = found.unionByName(_swept(c.join(many, "k", "left_semi"), p.join(many, "k", "left_semi")))
    return found.distinct()


def _swept(asked: DataFrame, p: DataFrame) -> DataFrame:
    """Rows (k, t, row_key) that no interval (k, s, e) of their key holds, by a running count of open intervals.

    The sweep is partitioned by key and day, with what is open at the day's begin carried in from sums for each key and
    day, so a key with very many rows is spread over many tasks.
    """
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    none = F.lit(None).cast("string")
    live = F.col("s").isNotNull() & (F.col("e").isNull() | (F.col("e") > F.col("s")))
    spans = p.filter("s is not null")
    starts = spans.select("k", F.col("s").alias("t"), none.alias("row_key"), F.when(live, one).otherwise(nil).alias("opened"), one.alias("begun"))
    ends = spans.filter(live & F.col("e").isNotNull()).select("k", F.col("e").alias("t"), none.alias("row_key"), (-one).alias("opened"), nil.alias("begun"))
    asked = asked.select("k", "t", "row_key", nil.alias("opened"), nil.alias("begun"))
    turns = starts.unionByName(ends)
    day = F.col("t").cast("date").alias("m")
    before = Window.partitionBy("k").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    # Days on which only questions lie need their carry too, hence the questions' (key, day) pairs.
    daily = turns.select("k", day, "opened", "begun").unionByName(asked.select("k", day, "opened", "begun").distinct())
    carry = (
        daily.groupBy("k", "m")
        .agg(F.sum("opened").alias("o"), F.sum("begun").alias("b"))
        .select("k", "m", F.coalesce(F.sum("o").over(before), nil).alias("o0"), F.coalesce(F.sum("b").over(before), nil).alias("b0"))
    )
    upto = Window.partitionBy("k", "m").orderBy("t", F.col("row_key").isNotNull(), "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.unionByName(asked)
        .select("*", day)
        .select("k", "m", "t", "row_key", F.sum("opened").over(upto).alias("o"), F.sum("begun").over(upto).alias("b"))
        .filter("row_key is not null")
        .join(carry, ["k", "m"])
        .filter("o + o0 <= 0")
        .select(F.date_format("t", "yyyy-MM").alias("ref_month"), "row_key", F.when(F.expr("b + b0 > 0"), "deleted").otherwise("late").alias("kind"))
    )


def counted(found: DataFrame) -> DataFrame:
    """Unheld references for each table, month and kind: (src_table, ref_month, kind, n_refs)."""
    return found.groupBy("src_table", "ref_month", "kind").agg(F.count("*").alias("n_refs"))
