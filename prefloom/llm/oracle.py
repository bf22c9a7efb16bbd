"""DuckDB SQL for the corpus queries that SQL can state.

Left out: op1, op4, op6, op7, op8, op10 and op13 rest on trained models, hashes, surrogates or tokenizers that DuckDB
lacks; their tests hold them against plain versions, the tokenizer's library or held-out accuracy.
"""

from __future__ import annotations

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def _lloyd(rounds: int = 3) -> str:
    """Integer vectors, hashed starts, and one assignment and one mean a round."""
    nearest = """
a{k} AS MATERIALIZED (SELECT r, vec_id, x, c, d FROM (SELECT r, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM v CROSS JOIN c{k} m)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    mean = """
s{k} AS (SELECT c, i, sum(t) AS t, count(*) AS n FROM (SELECT c, unnest(x) AS t, unnest(range(64)) AS i FROM a{k}) GROUP BY 1, 2),
c{next} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{k} LEFT JOIN (SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i) AS y FROM s{k} GROUP BY 1) USING (c))"""
    steps = ",".join(x for k in range(rounds) for x in (nearest.format(k=k), mean.format(k=k, next=k + 1)))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x FROM v) WHERE c < 16),{steps},{nearest.format(k=rounds)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, x FROM c{rounds}) m USING (c)"""


SQL: dict[str, str] = {
    "op11_centroids": _lloyd(),
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM k GROUP BY 1),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) AS p, 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u QUALIFY part = 'pair' OR rank <= 200""",
    # the tables' pages name no canonical address and no redirect, so that no verdict comes from an alias
    "op2_url_filter": r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(rule, h, pre, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS rn FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, pre))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS decided_by
FROM p LEFT JOIN m ON p.page_id = m.page_id AND rn = 1""",
    "op3_mix_sources": f"""
WITH d AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT source, source_size, source_size * 2 AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST) AS rn FROM w),
l AS (SELECT *, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  (SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left FROM o),
f AS (SELECT lft, w_left FROM l WHERE w * lft <= cap * w_left ORDER BY rn LIMIT 1),
t AS (SELECT l.source, source_size, CASE WHEN w * l.lft <= cap * l.w_left THEN w * f.lft / f.w_left ELSE cap::DOUBLE END AS target FROM l LEFT JOIN f ON true),
b AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS "full" FROM b),
g AS (SELECT *, greatest(0, least(size, budget - "full" * source_size - before)) AS part FROM e)
SELECT doc_id, size, source_size, target, "full" * size + part AS taken, source, "full", part FROM g""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, item, i, n FROM dw JOIN bw USING (n, g)),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN p ON d.doc_id = p.doc_id""",
    "op9_secret_ledger": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, 0 AS no, 'assign' AS kind, regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ms,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS ps, 6 AS least, text FROM d
  UNION ALL SELECT doc_id, 1, 'access', regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 20, text FROM d
  UNION ALL SELECT doc_id, 2, 'hex', regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}'), 24, text FROM d
  UNION ALL SELECT doc_id, 3, 'pem', regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), 1, text FROM d
  UNION ALL SELECT doc_id, 4, 'github', regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}'), 40, text FROM d
  UNION ALL SELECT doc_id, 5, 'slack', regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}'), regexp_extract_all(text, 'xox[abprs]-[A-Za-z0-9-]{10,}'), 15, text FROM d
  UNION ALL SELECT doc_id, 6, 'jwt', regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'), 30, text FROM d),
h AS (SELECT m.*, CASE no
    WHEN 0 THEN regexp_split_to_array(text, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?(?:[A-Za-z0-9+/_.=-]+)')
    WHEN 1 THEN regexp_split_to_array(text, 'AKIA[A-Z0-9]+') WHEN 2 THEN regexp_split_to_array(text, '[0-9a-f]{24,}')
    WHEN 3 THEN regexp_split_to_array(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----') WHEN 4 THEN regexp_split_to_array(text, 'gh[pousr]_[A-Za-z0-9]{36,}')
    WHEN 5 THEN regexp_split_to_array(text, 'xox[abprs]-[A-Za-z0-9-]{10,}') ELSE regexp_split_to_array(text, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') END AS gaps
  FROM m WHERE len(ms) > 0),
x AS (SELECT doc_id, no, kind, least, i, ms[i] AS t, ps[i] AS p, gaps[i] AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM h)),
y AS (SELECT *, sum(length(g) + length(t)) OVER (PARTITION BY doc_id, no ORDER BY i) AS e FROM x),
z AS (SELECT doc_id, no, kind, (e - length(t))::BIGINT AS s, e::BIGINT AS e FROM y WHERE length(p) >= least),
a AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM z GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id""",
}
