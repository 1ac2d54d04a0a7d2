"""SQL (DuckDB) equal to the queries of ``catalogue``, over the same tables."""

from __future__ import annotations

from weftline.functions.features import COLOURS, SUPERTYPES, TYPES
from weftline.operators.themes import BLOCKED
from weftline.plans.catalogue import ALPHA, AS_OF, MERGE, TTL_DAYS

CC = "cc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY updated_at DESC) AS rn FROM cards WHERE _id IS NOT NULL) WHERE rn = 1)"


def _key(c: str) -> str:
    return f"lower(replace(trim({c}), '-', ''))"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _usable(v: str, n: int) -> str:
    return f"(len({v}) = {n} AND len(list_filter({v}, lambda x: isfinite(x))) = {n} AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def _hot(values: str, vocab: str) -> str:
    return f"list_transform({vocab}, lambda w: CASE WHEN list_contains({values}, w) THEN 1.0 ELSE 0.0 END)"


def _text(v: str, places: int = 1) -> str:
    """A list of numbers as Spark writes doubles of few digits."""
    return f"array_to_string(list_transform({v}, lambda q: CAST(round(CAST(q AS DOUBLE) + 0.0, {places}) AS VARCHAR)), ',')"


_FACES = "string_split(coalesce(name, ''), ' // ')"
_TAGS = """t0 AS (SELECT lower(trim(_id)) AS slug, label, description, parent_slugs, child_slugs, embedding FROM tags WHERE trim(_id) <> ''),
nodes AS (SELECT slug, max(label) AS label, max(description) AS description FROM t0 GROUP BY slug),
pp AS (SELECT DISTINCT slug, lower(trim(x)) AS x FROM (SELECT slug, unnest(parent_slugs) AS x FROM t0) WHERE trim(x) <> ''),
ch AS (SELECT DISTINCT slug, lower(trim(x)) AS x FROM (SELECT slug, unnest(child_slugs) AS x FROM t0) WHERE trim(x) <> ''),
dn AS (SELECT slug, slug AS member FROM nodes UNION SELECT dn.slug, ch.x FROM dn JOIN ch ON ch.slug = dn.member JOIN nodes n ON n.slug = ch.x),
ups AS (SELECT slug, slug AS a FROM nodes UNION SELECT ups.slug, pp.x FROM ups JOIN pp ON pp.slug = ups.a JOIN nodes n ON n.slug = pp.x),
rt AS (SELECT slug, a AS root FROM ups WHERE a NOT IN (SELECT slug FROM pp))"""
_CT = "ct AS (SELECT DISTINCT _id AS card_id, lower(trim(x)) AS slug FROM (SELECT _id, unnest(tags) AS x FROM cc) WHERE trim(x) <> '')"
_DECKS = f"""ids AS (SELECT DISTINCT _id AS card_id, {_key('_id')} AS k FROM cards WHERE {_key('_id')} <> ''),
sg AS (SELECT DISTINCT s.signal_id, s.commander, i.card_id, s.lift, s.fetched_at FROM card_signals s JOIN ids i ON i.k = {_key('s.scryfall_id')} WHERE s.commander IS NOT NULL),
dk AS (SELECT DISTINCT commander AS deck_id, card_id FROM sg)"""
_TV = f"""tvx AS (SELECT slug, unnest(embedding) AS x, unnest(range(16)) AS i FROM t0 WHERE {_usable('embedding', 16)}),
tv AS (SELECT slug, i, avg(CAST(x AS DOUBLE)) AS x FROM tvx GROUP BY slug, i)"""
_THEMES = f"""{_TV},
cand AS (SELECT slug AS name FROM nodes WHERE slug NOT IN (SELECT slug FROM pp) AND (SELECT count(*) FROM ch WHERE ch.slug = nodes.slug) >= 2 AND slug NOT IN ({', '.join(f"'{b}'" for b in BLOCKED)})),
mem AS (SELECT dn.slug AS name, dn.member FROM dn JOIN cand ON cand.name = dn.slug),
cov AS (SELECT name, count(DISTINCT card_id) AS coverage FROM mem JOIN ct ON ct.slug = mem.member GROUP BY name),
wide AS (SELECT * FROM cov WHERE coverage BETWEEN ceil(0.02 * (SELECT count(*) FROM cc)) AND (60 * (SELECT count(*) FROM cc)) // 100),
rep0 AS (SELECT mem.name, i, avg(x) AS x FROM mem JOIN tv ON tv.slug = mem.member WHERE mem.name IN (SELECT name FROM wide) GROUP BY mem.name, i),
repn AS (SELECT name, sqrt(sum(x * x)) AS n FROM rep0 GROUP BY name),
rep AS (SELECT rep0.name, i, CASE WHEN n > 0 THEN x / n ELSE x END AS x FROM rep0 JOIN repn USING (name)),
th AS (SELECT wide.* FROM wide WHERE name IN (SELECT name FROM rep)),
thm AS (SELECT mem.* FROM mem WHERE name IN (SELECT name FROM th))"""
_TEXT = f"""tx0 AS (SELECT _id AS card_id, CAST(text_embedding AS DOUBLE[]) AS e FROM cc WHERE {_usable('text_embedding', 64)}),
tx1 AS (SELECT card_id, list_transform(range(1, 17), lambda i: e[i] + e[i + 16] + e[i + 32] + e[i + 48]) AS v FROM tx0), tx AS (SELECT * FROM tx1 WHERE {_usable('v', 16)})"""
_CLASS = f"""{_TEXT},
repl AS (SELECT name, list(x ORDER BY i) AS r FROM rep GROUP BY name),
hit AS (SELECT DISTINCT ct.card_id, thm.name FROM ct JOIN thm ON thm.member = ct.slug),
sc AS (SELECT hit.card_id, hit.name, th.coverage, round(CASE WHEN tx.v IS NULL THEN 0 ELSE list_cosine_similarity(tx.v, repl.r) END, 9) AS score FROM hit JOIN th USING (name) JOIN repl USING (name) LEFT JOIN tx USING (card_id)),
cl AS (SELECT card_id, name FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY score DESC, coverage DESC, name) AS rn FROM sc) WHERE rn = 1),
asg AS (SELECT dk.deck_id, dk.card_id, cl.name FROM dk JOIN cl USING (card_id))"""
_PAIRS = f"""cvx AS (SELECT _id AS card_id, unnest(card_vector) AS x, unnest(range(64)) AS i FROM cc WHERE {_usable('card_vector', 64)}),
pr0 AS (SELECT deck_id, name, i, avg(CAST(x AS DOUBLE)) AS x FROM asg JOIN cvx USING (card_id) GROUP BY deck_id, name, i),
pr AS (SELECT deck_id, name, list(x ORDER BY i) AS p FROM pr0 GROUP BY deck_id, name),
prs AS (SELECT a.deck_id, a.name AS a, b.name AS b, list_cosine_similarity(a.p, b.p) AS sim FROM pr a JOIN pr b ON a.deck_id = b.deck_id AND a.name < b.name WHERE list_cosine_similarity(a.p, b.p) >= {MERGE})"""
_MERGE = """hold AS (SELECT DISTINCT deck_id, name FROM asg),
lnk AS (SELECT deck_id, a, b FROM prs UNION SELECT deck_id, b, a FROM prs),
cmp AS (SELECT deck_id, name, name AS other FROM hold UNION SELECT cmp.deck_id, cmp.name, lnk.b FROM cmp JOIN lnk ON lnk.deck_id = cmp.deck_id AND lnk.a = cmp.other),
mm AS (SELECT deck_id, name, keeper FROM (SELECT cmp.deck_id, cmp.name, cmp.other AS keeper, row_number() OVER (PARTITION BY cmp.deck_id, cmp.name ORDER BY th.coverage DESC, cmp.other DESC) AS rn FROM cmp JOIN th ON th.name = cmp.other) WHERE rn = 1)"""
_ALL = f"WITH RECURSIVE {CC}, {_TAGS}, {_CT}, {_DECKS}, {_THEMES}, {_CLASS}, {_PAIRS}, {_MERGE}"
_LINES = """ln AS (SELECT commander AS deck_id, signal_id AS pos, coalesce(CASE coalesce(num_decks, 0) % 5 WHEN 0 THEN 'SB: 1 ' || name || ' (ABC) 12' WHEN 1 THEN '  4x ' || name || '  ' WHEN 2 THEN '# ' || name WHEN 3 THEN upper(name) ELSE '2 ' || name END, '') AS line
  FROM (SELECT DISTINCT signal_id, commander, name, num_decks FROM card_signals WHERE commander IS NOT NULL)),
ps AS (SELECT deck_id, pos, CASE WHEN trim(line) = '' OR starts_with(trim(line), '#') THEN NULL ELSE nullif(trim(regexp_replace(regexp_replace(regexp_replace(trim(line), '^\\s*SB:\\s*', '', 'i'), '^\\s*\\d+x?\\s+', '', 'i'), '\\s*\\([^)]+\\)(?:\\s+\\S+)?\\s*$', '')), '') END AS name FROM ln),
pl AS (SELECT deck_id, pos, name FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, lower(name) ORDER BY pos) AS rn FROM ps WHERE name IS NOT NULL) WHERE rn = 1)"""
_INDEX = "ix AS (SELECT DISTINCT _id AS card_id, unnest(names) AS low FROM cc)"
_WORDS = lambda part: f"list_filter(flatten(list_transform(string_split(coalesce(type_line, ''), ' // '), lambda f: string_split_regex({part}, '\\s+'))), lambda w: w <> '')"
_LEFT, _RIGHT = _WORDS("string_split(f, ' — ')[1]"), _WORDS("array_to_string(string_split(f, ' — ')[2:], ' — ')")
_SYM = "list_transform(regexp_extract_all(coalesce(mana_cost, ''), '\\{([^}]+)\\}', 1), lambda s: upper(s))"
_SLASH = "contains(s, '/') AND s NOT IN ('X', 'Y', 'Z', 'S')"
_MANA = "[list_sum(list_transform(list_filter(sy, lambda s: regexp_matches(s, '^\\d+$')), lambda s: CAST(s AS DOUBLE)))," + ",".join(f"len(list_filter(sy, lambda s: s = '{c}'))" for c in COLOURS) + f",len(list_filter(sy, lambda s: s IN ('X', 'Y', 'Z'))),len(list_filter(sy, lambda s: {_SLASH} AND NOT list_contains(string_split(s, '/'), 'P'))),len(list_filter(sy, lambda s: {_SLASH} AND list_contains(string_split(s, '/'), 'P'))),len(list_filter(sy, lambda s: s = 'S'))]"


def _stat(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN [0.0, 0.0] ELSE [coalesce(TRY_CAST(nullif(regexp_extract(ltrim({c}), '^-?\\d+'), '') AS DOUBLE), 0.0), 1.0] END"


_SIG = "substr(sha256(coalesce(oracle_text, '')), 1, 16)"
_KW = ["leech", "skyborne", "bulwark"]

ORACLES = {
    "content_signature": f"WITH {CC} SELECT _id, {_SIG} AS sig FROM cc",
    "alias_array": f"""WITH {CC}, a AS (SELECT _id, list_filter(list_concat([lower(name)], list_transform({_FACES}, lambda x: lower(x))), lambda x: x IS NOT NULL AND x <> '') AS l FROM cc)
SELECT _id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') AS aliases FROM a""",
    "face_fallback": f"""WITH {CC} SELECT _id, CASE WHEN mana_cost <> '' THEN mana_cost ELSE array_to_string(list_transform({_FACES}, lambda x: upper(x)), ' // ') END AS mana_cost,
CASE WHEN oracle_text IS NULL THEN array_to_string(list_transform({_FACES}, lambda x: CASE WHEN x <> '' THEN x || '.' ELSE '' END), chr(10) || '---' || chr(10)) ELSE oracle_text END AS oracle_text FROM cc""",
    "decklist_parse": f"WITH {_LINES} SELECT deck_id, pos, name FROM pl",
    "slugify": "SELECT DISTINCT name, nullif(trim(regexp_replace(replace(replace(lower(name), '''', ''), '’', ''), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug FROM cards WHERE name IS NOT NULL",
    "type_line_vector": f"WITH {CC} SELECT _id, {_text(f'list_concat({_hot(_LEFT, _list(SUPERTYPES))}, {_hot(_LEFT, _list(TYPES))})')} AS vec, array_to_string({_RIGHT}, ' ') AS subtypes FROM cc",
    "mana_vector": f"WITH {CC}, s AS (SELECT _id, {_SYM} AS sy FROM cc) SELECT _id, {_text(f'list_transform({_MANA}, lambda z: coalesce(z, 0))')} AS vec FROM s",
    "pt_vector": f"WITH {CC} SELECT _id, {_text(_stat('power'))} AS power, {_text(_stat('toughness'))} AS toughness FROM cc",
    "multi_hot": f"""WITH {CC} SELECT _id, {_text(_hot('coalesce(colors, [])', _list(COLOURS)))} AS colors, {_text(_hot('coalesce(color_identity, [])', _list(COLOURS)))} AS identity,
{_text(_hot('list_transform(coalesce(keywords, []), lambda k: lower(k))', _list(_KW)))} AS keywords FROM cc""",
    "tag_text": f"WITH RECURSIVE {_TAGS} SELECT slug, coalesce(nullif(label, ''), slug) || CASE WHEN description <> '' THEN '. ' || description ELSE '' END AS text FROM nodes",
    "name_lookup": f"WITH {CC}, {_INDEX}, a AS (SELECT DISTINCT name FROM card_signals WHERE name IS NOT NULL) SELECT name, count(card_id) AS n_matches, min(card_id) AS first_id FROM a LEFT JOIN ix ON ix.low = lower(name) GROUP BY name",
    "resolve_deck": f"""WITH {CC}, {_INDEX}, {_LINES}, x AS (SELECT deck_id, pos, name, (SELECT min(card_id) FROM ix WHERE ix.low = lower(pl.name)) AS card_id FROM pl)
SELECT deck_id, pos, name, card_id FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, coalesce(card_id, '?' || name) ORDER BY pos) AS rn FROM x) WHERE rn = 1""",
    "card_diff_merge": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, _id ORDER BY delivered_at DESC) AS rn FROM card_snapshots WHERE _id IS NOT NULL) WHERE rn = 1),
s AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS b FROM (SELECT DISTINCT snapshot_no FROM r)),
n AS (SELECT r.*, s.b FROM r JOIN s ON s.snapshot_no = r.snapshot_no WHERE s.b IS NOT NULL)
SELECT n.snapshot_no, CASE WHEN o._id IS NULL THEN 'new' WHEN n.oracle_text_sha IS DISTINCT FROM o.oracle_text_sha THEN 'changed' WHEN o.name IS NULL OR o.oracle_id IS NULL THEN 'patched' ELSE 'unchanged' END AS status, count(*) AS n_cards FROM n LEFT JOIN r o ON o._id = n._id AND o.snapshot_no = n.b GROUP BY 1, 2""",
    "tag_invert": f"""WITH {CC}, t AS (SELECT DISTINCT {_key('oracle_id')} AS k, lower(trim(x)) AS s FROM (SELECT oracle_id, unnest(tags) AS x FROM cc) WHERE trim(x) <> '')
SELECT k AS oracle_key, string_agg(s, ',' ORDER BY s) AS slugs FROM t WHERE k <> '' GROUP BY k""",
    "tag_catalog": f"""WITH RECURSIVE {_TAGS}, p AS (SELECT slug, string_agg(x, ',' ORDER BY x) AS v FROM pp WHERE x IN (SELECT slug FROM nodes) GROUP BY slug), c AS (SELECT slug, string_agg(x, ',' ORDER BY x) AS v FROM ch WHERE x IN (SELECT slug FROM nodes) GROUP BY slug)
SELECT n.slug AS _id, coalesce(p.v, '') AS parents, coalesce(c.v, '') AS children FROM nodes n LEFT JOIN p ON p.slug = n.slug LEFT JOIN c ON c.slug = n.slug""",
    "tag_attach_diff": f"""WITH {CC}, c AS (SELECT *, nullif({_key('oracle_id')}, '') AS k FROM cc),
t AS (SELECT k, list(DISTINCT lower(trim(x)) ORDER BY lower(trim(x))) AS want FROM (SELECT k, unnest(tags) AS x FROM c) WHERE trim(x) <> '' AND k IS NOT NULL GROUP BY k),
r AS (SELECT DISTINCT {_key('oracle_id')} AS k FROM oracle_register WHERE oracle_id IS NOT NULL), w AS (SELECT r.k, coalesce(t.want, []) AS want FROM r LEFT JOIN t ON t.k = r.k),
g AS (SELECT c.k, coalesce(c.tags, []) AS have FROM c WHERE c.k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c.k ORDER BY c._id) = 1),
s AS (SELECT coalesce(w.k, g.k) AS k, coalesce(w.want, []) AS want, g.k IS NOT NULL AS there, coalesce(w.want, []) IS DISTINCT FROM coalesce(g.have, []) AS diff FROM w FULL JOIN g ON g.k = w.k)
SELECT count(*) FILTER (diff) AS n_changed, count(*) FILTER (diff AND there) AS n_changed_matched, count(*) FILTER (there AND len(want) > 0) AS n_matched, count(*) FILTER (there AND len(want) = 0) AS n_empty, count(*) FILTER (NOT there) AS n_unmatched FROM s""",
    "first_per_group": f"WITH {CC} SELECT oracle_id, name FROM (SELECT oracle_id, name, row_number() OVER (PARTITION BY oracle_id ORDER BY _id) AS r FROM cc WHERE oracle_id IS NOT NULL) WHERE r = 1",
    "top_tags": f"WITH {CC} SELECT slug, count(*) AS n_cards FROM (SELECT unnest(tags) AS slug FROM cc) WHERE slug IS NOT NULL GROUP BY slug ORDER BY n_cards DESC, slug LIMIT 10",
    "tag_stats": f"""WITH {CC} SELECT count(*) AS n_cards, count(oracle_id) AS n_with_oracle_id, count(*) FILTER (len(tags) > 0) AS n_with_tags, count(*) - count(*) FILTER (len(tags) > 0) AS n_without_tags, count(DISTINCT oracle_id) AS n_oracle_ids,
round(100.0 * count(*) FILTER (len(tags) > 0) / count(*), 1) AS pct_tagged FROM cc""",
    "list_by_tag": f"WITH {CC} SELECT _id, name FROM cc WHERE list_contains(tags, 'value-engine')",
    "cap_and_page": f"WITH {CC} SELECT _id, name FROM cc ORDER BY name NULLS FIRST, _id LIMIT 20",
    "signal_extract": """WITH v AS (SELECT DISTINCT signal_id, commander, scryfall_id AS id, name, lift, synergy, num_decks, potential_decks FROM card_signals WHERE commander IS NOT NULL AND scryfall_id <> '' AND name <> '' AND lift IS NOT NULL AND num_decks IS NOT NULL)
SELECT commander, id, lift, coalesce(synergy, 0.0) AS synergy, num_decks, coalesce(potential_decks, 0) AS potential_decks, CASE WHEN coalesce(potential_decks, 0) > 0 THEN round(num_decks / CAST(potential_decks AS DOUBLE), 6) ELSE 0.0 END AS inclusion
FROM (SELECT *, row_number() OVER (PARTITION BY commander, id ORDER BY lift DESC, signal_id) AS rn FROM v) WHERE rn = 1""",
    "ttl_cache": f"SELECT commander, coalesce(max(fetched_at) FILTER (fetched_at < TIMESTAMP '{AS_OF}') > TIMESTAMP '{AS_OF}' - INTERVAL {TTL_DAYS} DAY, false) AS is_fresh FROM card_signals WHERE commander IS NOT NULL GROUP BY commander",
    "embed_queue": f"WITH {CC} SELECT _id FROM cc WHERE oracle_text <> '' AND NOT (text_embedding IS NOT NULL AND coalesce(oracle_text_sha = {_SIG}, false))",
    "invalidation": f"""WITH {CC}, f AS (SELECT text_embedding IS NOT NULL AS t, card_vector IS NOT NULL AS c, oracle_text_sha IS NOT DISTINCT FROM {_SIG} AS fits FROM cc)
SELECT count(*) FILTER (t) AS n_text_vectors, count(*) FILTER (t AND NOT fits) AS n_stale_text, count(*) FILTER (c AND (NOT t OR NOT fits)) AS n_stale_fused, count(*) FILTER (c) AS n_stale_on_new_alpha FROM f""",
    "display_names": f"""WITH {CC}, l AS (SELECT s._id, coalesce(cc.name, s._id) AS shown, list_filter(coalesce(cc.tags, []), lambda x: x IS NOT NULL) AS t FROM (SELECT DISTINCT scryfall_id AS _id FROM card_signals WHERE scryfall_id IS NOT NULL) s LEFT JOIN cc ON cc._id = s._id)
SELECT _id, shown, array_to_string(list_concat(t[1:2], CASE WHEN len(t) > 2 THEN ['(+' || (len(t) - 2) || ' more)'] ELSE [] END), ', ') AS tags_head FROM l""",
    "health_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("cards", "tags", "card_signals", "card_snapshots", "oracle_register")),
    "jsonl_roundtrip": f"WITH {CC} SELECT _id, name, oracle_text, cmc, array_to_string(keywords, ',') AS keywords FROM cc",
    "descendants": f"WITH RECURSIVE {_TAGS} SELECT slug, member FROM dn",
    "tag_roots": f"WITH RECURSIVE {_TAGS} SELECT slug, root FROM rt",
    "theme_coverage": f"{_ALL} SELECT name, coverage FROM th",
    "theme_order": f"{_ALL} SELECT name, coverage, row_number() OVER (ORDER BY coverage DESC, name) AS place FROM th",
    "theme_representative": f"{_ALL} SELECT name, CAST(i AS BIGINT) AS i, round(x, 6) + 0.0 AS x FROM rep WHERE name IN (SELECT name FROM th)",
    "classify_card": f"{_ALL} SELECT card_id, name FROM cl",
    "theme_pairs": f"{_ALL} SELECT deck_id, a, b, round(sim, 5) AS sim FROM prs",
    "theme_merge": f"{_ALL} SELECT deck_id, name, keeper FROM mm",
    "noise_tags": f"{_ALL} SELECT DISTINCT dk.deck_id, ct.slug FROM dk JOIN ct USING (card_id) ANTI JOIN (SELECT DISTINCT deck_id, thm.member AS slug FROM asg JOIN thm USING (name)) z ON z.deck_id = dk.deck_id AND z.slug = ct.slug",
    "theme_profile": f"""{_ALL}, pla AS (SELECT asg.*, mm.keeper FROM asg JOIN mm USING (deck_id, name)),
nn AS (SELECT deck_id, keeper, count(*) AS n_cards FROM pla GROUP BY deck_id, keeper), cs AS (SELECT deck_id, keeper, string_agg(name, ',' ORDER BY name) AS constituents FROM mm GROUP BY deck_id, keeper),
tt AS (SELECT deck_id, keeper, string_agg(slug, ',' ORDER BY slug) AS tags FROM (SELECT DISTINCT pla.deck_id, pla.keeper, ct.slug FROM pla JOIN ct USING (card_id) SEMI JOIN (SELECT mm.deck_id, mm.keeper, thm.member FROM mm JOIN thm USING (name)) z ON z.deck_id = pla.deck_id AND z.keeper = pla.keeper AND z.member = ct.slug) GROUP BY deck_id, keeper),
lo AS (SELECT deck_id, count(*) AS n FROM dk WHERE card_id NOT IN (SELECT card_id FROM cl) GROUP BY deck_id)
SELECT nn.deck_id, nn.keeper AS label, n_cards, coalesce(tags, '') AS tags, constituents, coalesce(lo.n, 0) AS n_unassigned FROM nn JOIN cs USING (deck_id, keeper) LEFT JOIN tt USING (deck_id, keeper) LEFT JOIN lo USING (deck_id)""",
    "tag_universe": f"WITH RECURSIVE {CC}, {_CT}, {_DECKS} SELECT DISTINCT deck_id, slug FROM dk JOIN ct USING (card_id)",
    "theme_profile_full": f"""{_ALL}, pla AS (SELECT asg.*, mm.keeper FROM asg JOIN mm USING (deck_id, name)), uni AS (SELECT DISTINCT deck_id, slug FROM dk JOIN ct USING (card_id)),
own AS (SELECT DISTINCT mm.deck_id, mm.keeper, thm.member AS slug FROM mm JOIN thm USING (name))
SELECT deck_id, keeper AS label, 'member' AS kind, card_id AS value FROM pla
UNION ALL SELECT deck_id, keeper, 'constituent', name FROM mm
UNION ALL SELECT DISTINCT pla.deck_id, pla.keeper, 'tag', ct.slug FROM pla JOIN ct USING (card_id) JOIN own ON own.deck_id = pla.deck_id AND own.keeper = pla.keeper AND own.slug = ct.slug
UNION ALL SELECT deck_id, '', 'unassigned', card_id FROM dk WHERE card_id NOT IN (SELECT card_id FROM cl)
UNION ALL SELECT deck_id, '', 'universe', slug FROM uni
UNION ALL SELECT deck_id, '', 'noise', slug FROM uni ANTI JOIN own USING (deck_id, slug)
UNION ALL SELECT DISTINCT commander, '', 'missing', name FROM card_signals WHERE commander IS NOT NULL AND name IS NOT NULL AND coalesce({_key('scryfall_id')}, '') NOT IN (SELECT k FROM ids)""",
    "theme_centroid": f"""{_ALL}, c0 AS (SELECT mm.deck_id, mm.keeper, rep.i, avg(rep.x) AS x FROM mm JOIN rep USING (name) GROUP BY ALL), cn AS (SELECT deck_id, keeper, sqrt(sum(x * x)) AS n FROM c0 GROUP BY ALL)
SELECT deck_id, keeper AS label, CAST(i AS BIGINT) AS i, round(CASE WHEN n > 0 THEN x / n ELSE x END, 5) + 0.0 AS x FROM c0 JOIN cn USING (deck_id, keeper)""",
    "deck_vocab": f"""WITH {CC}, {_DECKS}, w AS (SELECT dk.deck_id, cc.keywords, cc.type_line FROM dk JOIN cc ON cc._id = dk.card_id),
k AS (SELECT deck_id, string_agg(x, ',' ORDER BY x) AS v FROM (SELECT DISTINCT deck_id, lower(unnest(keywords)) AS x FROM w) WHERE x IS NOT NULL GROUP BY deck_id), s AS (SELECT deck_id, string_agg(x, ',' ORDER BY x) AS v FROM (SELECT DISTINCT deck_id, unnest({_RIGHT}) AS x FROM w) GROUP BY deck_id)
SELECT d.deck_id, coalesce(k.v, '') AS keywords, coalesce(s.v, '') AS subtypes FROM (SELECT DISTINCT deck_id FROM w) d LEFT JOIN k USING (deck_id) LEFT JOIN s USING (deck_id)""",
    "label_vote": f"""WITH RECURSIVE {CC}, {_TAGS}, {_CT}, {_DECKS}, v AS (SELECT dk.deck_id AS cluster, rt.root, count(DISTINCT dk.card_id) AS n_votes FROM dk JOIN ct USING (card_id) JOIN rt USING (slug) WHERE rt.root NOT IN ({', '.join(f"'{b}'" for b in BLOCKED)}) GROUP BY ALL)
SELECT cluster, root AS label, n_votes FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n_votes DESC, root) AS rn FROM v) WHERE rn = 1""",
    "eta_squared": f"""WITH {CC}, {_DECKS}, x AS (SELECT sg.commander AS deck_id, sg.lift, coalesce(list_filter({_LEFT}, lambda w: NOT list_contains({_list(SUPERTYPES)}, w))[1], '') AS kind FROM sg JOIN cc ON cc._id = sg.card_id WHERE sg.lift IS NOT NULL),
g AS (SELECT deck_id, avg(lift) AS gm, count(*) AS n FROM x GROUP BY deck_id), p AS (SELECT deck_id, kind, count(*) AS k, avg(lift) AS m FROM x GROUP BY ALL),
b AS (SELECT p.deck_id, sum(k * (m - gm) ** 2) AS ssb FROM p JOIN g USING (deck_id) GROUP BY p.deck_id), t AS (SELECT x.deck_id, sum((lift - gm) ** 2) AS sst FROM x JOIN g USING (deck_id) GROUP BY x.deck_id)
SELECT g.deck_id, CASE WHEN n < 2 OR sst <= 1e-18 THEN 0.0 ELSE round(greatest(0, least(1, ssb / sst)), 6) END AS eta2 FROM g JOIN b USING (deck_id) JOIN t USING (deck_id)""",
    "fuse_vectors": f"""WITH RECURSIVE {CC}, {_TAGS}, {_CT}, {_TV}, {_TEXT}, u AS (SELECT card_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM tx),
m0 AS (SELECT ct.card_id, i, avg(x) AS x FROM ct JOIN tv USING (slug) GROUP BY ct.card_id, i), m1 AS (SELECT card_id, list(x ORDER BY i) AS m FROM m0 GROUP BY card_id),
m AS (SELECT card_id, list_transform(m, lambda x: CASE WHEN list_inner_product(m, m) > 0 THEN x / sqrt(list_inner_product(m, m)) ELSE x END) AS m FROM m1),
f AS (SELECT u.card_id, CASE WHEN m.m IS NULL THEN u.v ELSE list_transform(list_zip(u.v, m.m), lambda z: {ALPHA} * z[1] + (1 - {ALPHA}) * z[2]) END AS f FROM u LEFT JOIN m USING (card_id))
SELECT card_id, CAST(i AS BIGINT) AS i, round(f[i + 1] / sqrt(list_inner_product(f, f)), 5) + 0.0 AS x FROM (SELECT card_id, f, unnest(range(16)) AS i FROM f)""",
    "augmented_cosine": f"""WITH {CC}, b AS (SELECT _id, CAST(card_vector AS DOUBLE[]) AS v, {_hot('coalesce(colors, [])', _list(COLOURS))} AS c, {_stat('power')} AS p FROM cc WHERE {_usable('card_vector', 64)}),
n AS (SELECT _id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v, list_transform(c, lambda x: CASE WHEN list_sum(c) > 0 THEN 0.8 * x / sqrt(list_sum(c)) ELSE 0 END) AS c, list_transform(p, lambda x: CASE WHEN p[2] > 0 THEN 0.5 * x / sqrt(p[1] * p[1] + p[2] * p[2]) ELSE 0 END) AS p FROM b),
z AS (SELECT _id, list_concat(list_concat(v, CAST(c AS DOUBLE[])), CAST(p AS DOUBLE[])) AS v FROM n)
SELECT DISTINCT q.card_a, q.card_b, round(list_cosine_similarity(x.v, y.v), 5) AS sim FROM cluster_probes q JOIN z x ON x._id = q.card_a JOIN z y ON y._id = q.card_b""",
    "text_encode": f"""WITH {CC}, s AS (SELECT _id, {_SIG} AS sig, list_sum(list_transform(string_split(oracle_text, ''), lambda x: unicode(x))) % 1000 AS h FROM cc WHERE oracle_text <> '')
SELECT _id AS key, sig AS text_sha, {_text('list_transform(range(8), lambda i: h + i)')} AS vec FROM s""",
}
