"""The queries' SQL, for those that SQL can express: plain definitions, without the operators' ways."""

from __future__ import annotations

from tidewave.llm.line_dedup import BLOCKS, HIDDEN, HOST, LEAST, NAMED, TAGS
from tidewave.llm.quotes import APART, INTRODUCES, MARKS

_NL, _BLANK = "chr(10)", "chr(32) || chr(9) || chr(13) || chr(11) || chr(12)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _page_text() -> str:
    text = f"regexp_replace(regexp_replace(regexp_replace(html, {_q(HIDDEN)}, '', 'g'), {_q(BLOCKS)}, {_NL}, 'g'), {_q(TAGS)}, '', 'g')"
    for name, character in NAMED.items():
        text = f"replace({text}, {_q(name)}, {_q(character)})"
    return text


_LINES, _TRIM = f"string_split(text, {_NL})", f"trim(x, {_BLANK})"
OP1 = f"""WITH t AS (SELECT page_id, lower(nullif(regexp_extract(url, {_q(HOST)}, 1), '')) AS host, {_page_text()} AS text FROM pages),
  l AS (SELECT host, unnest(list_distinct(list_filter(list_transform({_LINES}, lambda x: {_TRIM}), lambda x: x <> ''))) AS line FROM t WHERE host IS NOT NULL),
  c AS (SELECT host, line, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= {LEAST}), n AS (SELECT host, count(*) AS total FROM t GROUP BY host),
  b AS (SELECT c.host, list(line) AS gone FROM c JOIN n ON n.host = c.host WHERE c.n > total * CAST(0.1 AS DOUBLE) GROUP BY c.host),
  k AS (SELECT page_id, t.host, text, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter({_LINES}, lambda x: {_TRIM} = '' OR NOT list_contains(gone, {_TRIM})), {_NL}) END AS kept FROM t LEFT JOIN b ON b.host = t.host),
  f AS (SELECT *, coalesce(len(list_filter({_LINES}, lambda x: {_TRIM} <> '')), 0) AS a, coalesce(len(list_filter(string_split(kept, {_NL}), lambda x: {_TRIM} <> '')), 0) AS z FROM k)
  SELECT page_id, host, CAST(a AS INTEGER) AS n_lines, CAST(a - z AS INTEGER) AS n_dropped, kept AS text FROM f"""

_RAW = f"string_split(replace(text, chr(13), ''), {_NL})"
OP3 = rf"""WITH RECURSIVE m AS (SELECT *, row_number() OVER () AS rid FROM conversations),
  r AS (SELECT rid, conv_id, turn, unnest({_RAW}) AS raw, generate_subscripts({_RAW}, 1) AS i FROM m WHERE text IS NOT NULL),
  l AS (SELECT *, length(regexp_replace(regexp_extract(raw, {_q(MARKS)}), '[^>]', '', 'g')) AS level, regexp_replace(raw, {_q(MARKS)}, '') AS body FROM r),
  x AS (SELECT *, trim(regexp_replace(lower(body), {_q(APART)}, ' ', 'g')) AS norm, coalesce(regexp_matches(body, {_q(INTRODUCES)}) AND lead(level) OVER (PARTITION BY rid ORDER BY i) > 0, false) AS introduces FROM l),
  k AS (SELECT *, CASE WHEN norm = '' THEN -1 WHEN level = 0 AND introduces THEN -2 ELSE level END AS kind FROM x), y AS (SELECT *, lag(kind) OVER (PARTITION BY rid ORDER BY i) AS above FROM k),
  g AS (SELECT *, sum(CASE WHEN kind = above THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM y), q AS (SELECT rid, run, string_agg(norm, ' ' ORDER BY i) AS passage FROM g GROUP BY rid, run),
  z AS (SELECT g.*, passage FROM g JOIN q ON q.rid = g.rid AND q.run = g.run), asks AS (SELECT DISTINCT conv_id, turn, level, passage, norm FROM z WHERE kind > 0),
  has AS (SELECT DISTINCT conv_id, turn AS origin, unnest([norm, passage]) AS key FROM z WHERE kind = 0),
  o AS (SELECT asks.*, coalesce((SELECT max(origin) FROM has WHERE has.conv_id = asks.conv_id AND key = passage AND origin < turn), (SELECT max(origin) FROM has WHERE has.conv_id = asks.conv_id AND key = norm AND origin < turn)) AS origin FROM asks),
  found AS (SELECT conv_id, turn, level, norm, max(origin) AS origin FROM o WHERE origin IS NOT NULL GROUP BY ALL),
  votes AS (SELECT conv_id, turn, level, origin, count(*) AS n FROM found GROUP BY ALL), parents AS (SELECT conv_id, turn, origin AS parent_turn FROM votes QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
  linked AS (SELECT conv_id, turn, count(*) AS n_linked FROM (SELECT DISTINCT conv_id, turn, level, norm FROM found) GROUP BY ALL),
  up AS (SELECT conv_id, turn, parent_turn AS above, 1 AS depth FROM parents UNION ALL SELECT up.conv_id, up.turn, p.parent_turn, depth + 1 FROM up JOIN parents p ON p.conv_id = up.conv_id AND p.turn = up.above),
  place AS (SELECT conv_id, turn, arg_max(above, depth) AS root, max(depth) AS depth FROM up GROUP BY ALL),
  kept AS (SELECT rid, count(*) FILTER (level > 0) AS n_quoted, string_agg(body, {_NL} ORDER BY i) FILTER (level = 0 AND NOT introduces) AS own FROM x GROUP BY rid)
  SELECT m.conv_id, m.turn, m.role, parent_turn, coalesce(root, m.turn) AS root_turn, CAST(coalesce(depth, 0) AS INTEGER) AS depth, CAST(coalesce(n_quoted, 0) AS INTEGER) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
    CASE WHEN contains(m.text, '>') THEN regexp_replace(coalesce(own, ''), '^\n+|\n+$', '', 'g') ELSE m.text END AS text
  FROM m LEFT JOIN kept ON kept.rid = m.rid LEFT JOIN parents p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN place ON place.conv_id = m.conv_id AND place.turn = m.turn LEFT JOIN linked ON linked.conv_id = m.conv_id AND linked.turn = m.turn"""

_WORD = r"'[^\x20\x09-\x0D]+'"
OP5 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
  u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
  l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)), reach AS (SELECT doc_id AS id, doc_id AS r FROM s UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r), k AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
  SELECT s.doc_id, len(sh) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN k ON k.id = s.doc_id"""

OP6 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
  reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r), k AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
  SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN k ON k.id = vec_id"""

OP7 = f"""WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, {_WORD})) END AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
  w AS (SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
  f AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM w),
  g AS (SELECT *, (total * CAST(1.5 AS DOUBLE) - CAST(before AS DOUBLE) * 2) / CAST(weight_on AS DOUBLE) AS level FROM f), h AS (SELECT *, CASE WHEN source_size * 2 > level * weight THEN level END AS open FROM g),
  t AS (SELECT source, source_size, CASE WHEN open IS NULL THEN CAST(source_size * 2 AS DOUBLE) ELSE max(open) OVER () * weight END AS target FROM h),
  r AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)), code, doc_id NULLS FIRST, size) AS k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST(CAST('0x' || substr(md5('7:' || CASE WHEN d.source IS NULL THEN 'true' ELSE 'false' END || ':' || coalesce(d.source, '')), 1, 7) AS BIGINT) AS DOUBLE) / 268435456 AS u FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
  c AS (SELECT *, CAST(least(floor(k * rate + u) - floor((k - 1) * rate + u), 2) AS BIGINT) AS copies FROM r)
  SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, copies, copies * CAST(size AS BIGINT) AS taken FROM c"""

OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(range(1, greatest(len(q.b), len(v.b)) + 1), lambda i: CAST(coalesce(q.b[i], false) <> coalesce(v.b[i], false) AS INTEGER))) AS INTEGER) AS distance
    FROM v q JOIN v ON q.vec_id <> v.vec_id AND (len(q.b) - 1) // 64 = (len(v.b) - 1) // 64 WHERE q.vec_id % 20 = 0),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, rank, vec_id, distance FROM k WHERE rank <= 10"""

_COLUMNS = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)")
_LEAF = lambda text: "sha256(concat(" + ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (*_COLUMNS, text)) + "))"
#: CRC-32 bit by bit: a byte is taken in, then shifted out in eight steps.
_CRC32 = "xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(id[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END))"
OP11 = f"""WITH RECURSIVE d AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, row_number() OVER () AS rid, {_LEAF("text")} AS leaf, {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower FROM documents),
  x AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM d),
  t AS (SELECT tree, 0 AS level, pos, leaf AS node FROM x UNION ALL SELECT tree, level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree, level) AS n FROM t) WHERE n > 1 GROUP BY tree, level, pos // 16),
  s AS (SELECT tree, max(level) AS height, arg_max(node, level) AS subroot FROM t GROUP BY tree),
  u AS (SELECT 0 AS level, tree AS pos, subroot AS node FROM s UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM u) WHERE n > 1 GROUP BY level, pos // 16),
  e AS (SELECT tree, level, pos, node FROM t UNION ALL SELECT -1, level, pos, node FROM u),
  g AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r FROM e a JOIN e b ON b.tree = a.tree AND b.level = a.level AND b.pos // 16 = a.pos // 16 GROUP BY ALL),
  w AS (SELECT rid, tree, 0 AS step, CASE WHEN {_CRC32} % 5 = 0 THEN lower ELSE leaf END AS node, '' AS proof, x.pos, height, (SELECT max(level) FROM u) AS top, tree AS own FROM x JOIN s USING (tree)
    UNION ALL SELECT rid, w.tree, step + 1, sha256(l || w.node || r), proof || l || r, CASE WHEN step + 1 = height THEN own ELSE w.pos // 16 END, height, top, own FROM (SELECT *, CASE WHEN step = 0 AND height = 0 THEN own ELSE pos END AS here FROM w) w
      JOIN g ON g.tree = CASE WHEN step < height THEN w.tree ELSE -1 END AND g.level = CASE WHEN step < height THEN step ELSE step - height END AND g.pos = here WHERE step < height + top)
  SELECT doc_id, leaf, subroot, (SELECT arg_max(node, level) FROM u) AS root, sha256(proof) AS proof_sha256, w.node AS folded_root, w.node = (SELECT arg_max(node, level) FROM u) AS verified
    FROM w JOIN x ON x.rid = w.rid JOIN s ON s.tree = w.tree WHERE step = w.height + top"""


def _rounds(n: int) -> str:
    """Centroids c0 .. cn, by round: all vectors against all centroids, and the floors of exact means."""
    steps = []
    for r in range(n + 1):
        steps.append(f"d{r} AS (SELECT i, x, c, list_sum(list_transform(range(1, 65), lambda k: (x[k] - z[k]) * (x[k] - z[k]))) AS distance FROM v, c{r}), a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY distance, c) = 1)")
        if r < n:
            mean = f"SELECT c, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS m FROM a{r}, range(1, 65) AS q(k) GROUP BY c, k"
            steps.append(f"m{r} AS (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY k) AS z FROM ({mean}) GROUP BY c), c{r + 1} AS (SELECT c, coalesce(m{r}.z, c{r}.z) AS z FROM c{r} LEFT JOIN m{r} USING (c))")
    return ", ".join(steps)


OP13 = f"""WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
  c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS z FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 16)), {_rounds(3)},
  n AS (SELECT c, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a3 GROUP BY c)
  SELECT vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM n) AS BIGINT) AS inertia, sha256(array_to_string(z, ',')) AS centroid_sha256
    FROM a3 JOIN v ON v.i = a3.i JOIN n ON n.c = a3.c JOIN c3 ON c3.c = a3.c"""
