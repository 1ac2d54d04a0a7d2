"""Queries p3 and p5 to p10, and their SQL where it can express them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.canonical import Forms, alike_classes, alike_pairs, canonical_texts
from weftline.llm.clusters import described, groups
from weftline.llm.cooccurrence import cooccurrences
from weftline.llm.mixing import Mix
from weftline.llm.packing import Packing, packed, packing_report
from weftline.llm.terms import marks, term_counts
from weftline.llm.vectors import similar_pairs
from weftline.runtime import cut
from weftline.sources import latest_cards, table


def _cards(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Of each card the row that counts."""
    return latest_cards(spark, sf_dir, *columns)


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cut(_cards(spark, sf_dir, "tags"))
    return marks(term_counts(cards, "tags"), cards.count()).withColumnRenamed("term", "slug")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).filter("mark is not null").select("slug", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["card_vector", "text_embedding"]
    return similar_pairs(_cards(spark, sf_dir, *fields), "_id", fields)


def _tag_pairs(spark: SparkSession, sf_dir: str, at_least: int) -> DataFrame:
    cards = cut(_cards(spark, sf_dir, "tags"))
    return cooccurrences(cards, "tags", cards.count(), at_least)


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tag_pairs(spark, sf_dir, 1)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = cut(_cards(spark, sf_dir, "tags"))
    n = cards.count()
    return cooccurrences(cards, "tags", n, 5).filter(F.col("n_both") * F.lit(n) >= 3 * F.col("n_a") * F.col("n_b")).select("slug_a", "slug_b")


def _groups(spark: SparkSession, sf_dir: str, sims: bool) -> DataFrame:
    return groups(_cards(spark, sf_dir, "card_vector", "tags"), "_id", "card_vector", "tags", sims=sims)


def p7_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, False).select(F.col("id").alias("card_id"), F.col("group").alias("group_id"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(cut(_groups(spark, sf_dir, True))).withColumnRenamed("group", "group_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = cut(p7_members(spark, sf_dir))
    side = lambda c: g.select(F.col("card_id").alias(c), F.col("group_id").alias("g_" + c))
    probes = table(spark, sf_dir, "cluster_probes").select("card_a", "card_b").distinct()
    return probes.join(side("card_a"), "card_a").join(side("card_b"), "card_b").filter("g_card_a = g_card_b").select("card_a", "card_b")


def _packed(spark: SparkSession, sf_dir: str) -> Packing:
    return packed(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).places


def p8_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certificate of every partition that was packed."""
    return _packed(spark, sf_dir).partitions


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_packing(spark, sf_dir).filter("piece > 0").select("doc_id").distinct()


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).copies()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources whose documents at their most repeats stay below their share."""
    return _mix(spark, sf_dir).shorts()


def p10_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_texts(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "canonical")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of one form that is stored in several texts, each with its class."""
    return alike_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_terms, p5_found, p6_found, p6_pairs, p7_found, p7_members, p7_groups, p8_found, p8_packing, p8_partitions, p8_report, p9_found, p9_copies, p9_report, p10_found, p10_texts, p10_classes)}

_CC = "cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY updated_at DESC) AS rn FROM cards WHERE _id IS NOT NULL) WHERE rn = 1)"
_TERMS = f"""{_CC}, v AS (SELECT _id, lower(trim(x)) AS slug FROM (SELECT _id, unnest(tags) AS x FROM cc) WHERE trim(x) <> ''),
c AS (SELECT slug, count(*) AS n_occ, count(DISTINCT _id) AS n_rec FROM v GROUP BY slug),
m AS (SELECT *, CASE WHEN n_rec < 3 THEN 'rare' WHEN n_rec > 0.08 * (SELECT count(*) FROM cc) THEN 'common' END AS mark FROM c)"""
_PAIRS = f"""{_TERMS}, d AS (SELECT DISTINCT _id, slug FROM v), n AS (SELECT count(*) AS n FROM cc),
p AS (SELECT x.slug AS slug_a, y.slug AS slug_b, count(*) AS n_both FROM d x JOIN d y ON x._id = y._id AND x.slug < y.slug GROUP BY ALL),
q AS (SELECT p.*, a.n_rec AS n_a, b.n_rec AS n_b, n.n FROM p JOIN c a ON a.slug = p.slug_a JOIN c b ON b.slug = p.slug_b CROSS JOIN n)"""


def _term(k: str, row: str, col: str) -> str:
    return f"CASE WHEN {k} > 0 THEN ({k}) * ln(CAST({k} AS DOUBLE) * n / (CAST({row} AS DOUBLE) * ({col}))) ELSE 0 END"


_NEAR = """SELECT '{f}' AS vector_field, least(q, d) AS card_a, greatest(q, d) AS card_b FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS r FROM (
    SELECT x._id AS q, y._id AS d, list_cosine_similarity(x.v, y.v) AS s FROM u_{f} x JOIN u_{f} y ON x._id <> y._id)) WHERE r <= 5 AND s >= 0.92"""
_UNITS = """u_{f} AS (SELECT _id, CAST({f} AS DOUBLE[]) AS v FROM cc WHERE len({f}) = 64 AND len(list_filter({f}, lambda x: isfinite(x))) = 64 AND len(list_filter({f}, lambda x: x <> 0)) > 0)"""

# Tokens counted roughly, by runs of letters, digits and signs: no case is so close that the tokenizer matters.
_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}]{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]+|\n'))"


def _shown_table() -> str:
    """What each character shows, where that is not itself, as rows (ch, shown)."""
    forms = Forms()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    every = (chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF)
    rows = [(ch, forms.shown(ch)) for ch in every if unicodedata.category(ch) not in ("Cn", "Co") and unicodedata.normalize("NFC", forms.shown(ch)) != ch]
    low = [(chr(c), "") for c in (*range(1, 9), *range(11, 32), 127)]
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in [*rows, *low])


def _alike_sql(select: str) -> str:
    return f"""WITH sh(ch, shown) AS (VALUES {_shown_table()}), d AS (SELECT doc_id, text, regexp_full_match(text, '[\\n\\t\\x20-\\x7e]*') AS plain FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM d WHERE NOT plain),
n AS (SELECT doc_id, nfc_normalize(coalesce(string_agg(coalesce(shown, u.ch), '' ORDER BY i), '')) AS canon FROM u LEFT JOIN sh ON sh.ch = u.ch GROUP BY doc_id),
t AS (SELECT d.doc_id, d.text, coalesce(n.canon, CASE WHEN plain THEN d.text ELSE '' END) AS canon FROM d LEFT JOIN n USING (doc_id)) {select}"""


ORACLES = {
    "p3_found": f"WITH {_TERMS} SELECT slug, mark FROM m WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {_TERMS} SELECT slug, n_occ, n_rec, mark FROM m",
    "p5_found": f"WITH {_CC}, {_UNITS.format(f='card_vector')}, {_UNITS.format(f='text_embedding')} SELECT DISTINCT * FROM ({_NEAR.format(f='card_vector')} UNION ALL {_NEAR.format(f='text_embedding')})",
    "p6_found": f"WITH {_PAIRS} SELECT slug_a, slug_b FROM q WHERE n_both >= 5 AND n_both * n >= 3 * n_a * n_b",
    "p6_pairs": f"WITH {_PAIRS} SELECT slug_a, slug_b, n_both, n_a, n_b, n_both * CAST(n AS DOUBLE) / (n_a * n_b) AS lift, 2.0 * ({_term('n_both', 'n_a', 'n_b')} + {_term('n_a - n_both', 'n_a', 'n - n_b')} + {_term('n_b - n_both', 'n - n_a', 'n_b')} + {_term('n - n_a - n_b + n_both', 'n - n_a', 'n - n_b')}) AS llr FROM q",
    "p8_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 2048",
    "p9_found": f"""WITH s AS (SELECT lower(trim(source)) AS source, sum({_TOKENS}) AS n FROM documents GROUP BY 1),
t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS share, max(max_repeats) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
q AS (SELECT t.source, share, cap, coalesce(n, 0) AS n, sum(n) OVER () AS total FROM t LEFT JOIN s ON s.source = t.source) SELECT source FROM q WHERE n * cap < share * total""",
    "p10_found": _alike_sql("SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_a, greatest(a.doc_id, b.doc_id) AS doc_b FROM t a JOIN t b ON a.canon = b.canon AND a.text < b.text"),
    "p10_classes": _alike_sql("SELECT doc_id, class_id, n_docs, n_texts FROM t JOIN (SELECT canon, min(doc_id) AS class_id, count(*) AS n_docs, count(DISTINCT text) AS n_texts FROM t GROUP BY canon) c USING (canon) WHERE n_texts > 1"),
}
