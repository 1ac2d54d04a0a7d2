"""Queries p1, p2 and p4 over the catalogue's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.hierarchy import hierarchy
from weftline.operators.references import counted, unheld
from weftline.operators.snapshots import changes
from weftline.runtime import cut
from weftline.sources import latest_cards, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cut(latest_cards(spark, sf_dir, "oracle_id", "added_at", "removed_at"))
    signals, register = table(spark, sf_dir, "card_signals"), table(spark, sf_dir, "oracle_register")
    a = unheld(cards, register, "_id", "oracle_id", "added_at", "oracle_id", "registered_at", "deleted_at")
    b = unheld(signals, cards, "signal_id", "scryfall_id", "fetched_at", "_id", "added_at", "removed_at")
    cols = ["src_table", "ref_month", "row_key", "kind"]
    return a.withColumn("src_table", F.lit("cards")).select(cols).unionByName(b.withColumn("src_table", F.lit("card_signals")).select(cols))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(p1_found(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(table(spark, sf_dir, "card_snapshots"), "snapshot_no", "_id", "oracle_text", "delivered_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hierarchy(table(spark, sf_dir, "tags"))
    held = h.reach().select("slug", "root_slug", F.col("depth").cast("long").alias("tag_depth"))
    return held.unionByName(h.cyclic().select("slug", F.col("smallest").alias("root_slug"), F.lit(-1).cast("long").alias("tag_depth")))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tag and root with one shortest way between them."""
    return hierarchy(table(spark, sf_dir, "tags")).reach(paths=True).select("slug", "root_slug", F.col("depth").cast("long").alias("tag_depth"), "path")


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "tags")).descendants()


def p4_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry, exit and depth of each tag: all descendants without writing out a pair."""
    return hierarchy(table(spark, sf_dir, "tags")).intervals()


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p2_found, p4_found, p4_paths, p4_descendants, p4_intervals)}

_LATEST_CARDS = "cc AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY updated_at DESC) rn FROM cards WHERE _id IS NOT NULL) WHERE rn = 1)"
_P1 = f"""WITH {_LATEST_CARDS},
refs AS (
  SELECT 'cards' AS src_table, _id AS row_key, lower(replace(trim(oracle_id), '-', '')) AS k, added_at AS t FROM cc
  UNION SELECT 'card_signals', CAST(signal_id AS VARCHAR), lower(replace(trim(scryfall_id), '-', '')), fetched_at FROM card_signals),
tgt AS (
  SELECT 'cards' AS src_table, lower(replace(trim(oracle_id), '-', '')) AS k, registered_at AS s, deleted_at AS e FROM oracle_register
  UNION SELECT 'card_signals', lower(replace(trim(_id), '-', '')), added_at, removed_at FROM cc),
told AS (
  SELECT r.src_table, strftime(r.t, '%Y-%m') AS ref_month, r.row_key, count(g.k) AS n,
         coalesce(bool_or(g.s <= r.t AND (g.e IS NULL OR g.e > r.t)), false) AS holds, coalesce(bool_or(g.s <= r.t), false) AS begun
  FROM refs r LEFT JOIN tgt g ON g.src_table = r.src_table AND g.k = r.k
  WHERE r.k <> '' AND r.t IS NOT NULL AND r.row_key IS NOT NULL GROUP BY r.src_table, r.t, r.row_key, r.k),
found AS (SELECT DISTINCT src_table, ref_month, row_key, CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS kind FROM told WHERE NOT holds)
"""
_EDGES = """n AS (SELECT DISTINCT lower(trim(_id)) AS s FROM tags WHERE trim(_id) <> ''),
told AS (
  SELECT lower(trim(x)) AS p, lower(trim(_id)) AS c FROM (SELECT _id, unnest(parent_slugs) AS x FROM tags)
  UNION SELECT lower(trim(_id)), lower(trim(x)) FROM (SELECT _id, unnest(child_slugs) AS x FROM tags)),
e AS (SELECT p, c FROM told WHERE p IN (SELECT s FROM n) AND c IN (SELECT s FROM n)),
up AS (SELECT p AS a, c AS b FROM e UNION SELECT up.a, e.c FROM up JOIN e ON e.p = up.b)"""

ORACLES = {
    "p1_found": _P1 + "SELECT src_table, ref_month, row_key, kind FROM found",
    "p1_counts": _P1 + "SELECT src_table, ref_month, kind, count(*) AS n_refs FROM found GROUP BY ALL",
    "p2_found": """WITH r AS (SELECT * FROM (SELECT snapshot_no, _id, coalesce(oracle_text, '') AS txt, row_number() OVER (PARTITION BY snapshot_no, _id ORDER BY delivered_at DESC) AS rn FROM card_snapshots WHERE _id IS NOT NULL) WHERE rn = 1),
s AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS b FROM (SELECT DISTINCT snapshot_no FROM r)),
x AS (SELECT s.snapshot_no AS no, r._id AS id, r.txt FROM s JOIN r ON r.snapshot_no = s.snapshot_no WHERE s.b IS NOT NULL),
y AS (SELECT s.snapshot_no AS no, r._id AS id, r.txt FROM s JOIN r ON r.snapshot_no = s.b)
SELECT CAST(coalesce(x.no, y.no) AS INTEGER) AS snapshot_no, coalesce(x.id, y.id) AS card_id, CASE WHEN y.id IS NULL THEN 'added' WHEN x.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM x FULL JOIN y ON x.no = y.no AND x.id = y.id WHERE x.txt IS DISTINCT FROM y.txt""",
    "p4_found": f"""WITH RECURSIVE {_EDGES},
r AS (SELECT s AS root, s AS x, 0 AS d FROM n WHERE s NOT IN (SELECT c FROM e) UNION SELECT r.root, e.c, r.d + 1 FROM r JOIN e ON e.p = r.x WHERE r.d < 200),
cy AS (SELECT u.a AS slug, min(v.b) AS root_slug FROM up u JOIN up v ON v.a = u.a JOIN up w ON w.a = v.b AND w.b = u.a WHERE u.a = u.b GROUP BY u.a)
SELECT x AS slug, root AS root_slug, CAST(min(d) AS BIGINT) AS tag_depth FROM r GROUP BY x, root UNION ALL SELECT slug, root_slug, CAST(-1 AS BIGINT) FROM cy""",
    "p4_descendants": f"WITH RECURSIVE {_EDGES} SELECT a AS slug, b AS descendant FROM up",
}
