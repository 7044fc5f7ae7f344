"""SQL for DuckDB that gives the rows of those queries that SQL can express."""

from __future__ import annotations

TOP_K = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 10"""

#: CRC-32 by a table, which the reflected polynomial gives.
SHARDS = """WITH RECURSIVE t0 AS (SELECT range AS i, range AS c, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS l FROM t0 WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
b AS (SELECT doc_id, row, octet_length(encode(text)) + 1 AS size, [CAST('0x' || h AS BIGINT) FOR h IN regexp_extract_all(hex(encode(text)), '..')] AS bytes FROM d),
s AS (SELECT doc_id, row, size, xor(4294967295, list_reduce(bytes, lambda a, x: xor(a >> 8, list_extract(t.l, xor(a, x) % 256 + 1)), 4294967295)) AS crc FROM b, t),
o AS (SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS total, row_number() OVER w AS place FROM s WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, crc, row)),
p AS (SELECT *, CAST(least(15, (2 * start + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p"""

NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(len(w) - 4, 1) + 1)])) AS s, len(w) AS n FROM w),
k AS (SELECT doc_id, CASE WHEN n = 0 THEN 'none ' || CAST(doc_id AS VARCHAR) ELSE md5(array_to_string(s, '|')) END AS k, s, n FROM s),
c AS (SELECT k, min(doc_id) AS first, count(*) AS copies, any_value(s) AS s, any_value(n) AS n FROM k GROUP BY k),
u AS (SELECT k, unnest(s) AS x FROM c WHERE n > 0),
m AS (SELECT a.k AS a, b.k AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2),
l AS (SELECT m.a, m.b FROM m JOIN c x ON x.k = m.a JOIN c y ON y.k = m.b WHERE 5 * m.n >= 4 * (len(x.s) + len(y.s) - m.n)),
r AS (SELECT k AS a, k AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
g AS (SELECT r.a AS k, min(c.first) AS class_id FROM r JOIN c ON c.k = r.b GROUP BY 1)
SELECT k.doc_id, g.class_id, (SELECT count(*) FROM l WHERE l.a = k.k) AS n_links, c.copies AS n_copies, k.doc_id = g.class_id AS keep FROM k JOIN c ON c.k = k.k JOIN g ON g.k = k.k"""

MIX = r"""WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s GROUP BY 1),
w AS (SELECT *, i % 3 + 1 AS weight, CAST(3 * source_size AS DOUBLE) AS cap, CAST(3 * source_size AS DOUBLE) / (i % 3 + 1) AS ratio FROM o),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER q - cap)) / (CAST(sum(weight) OVER () AS DOUBLE) - (sum(weight) OVER q - weight)) AS level FROM w WINDOW q AS (ORDER BY ratio, source NULLS FIRST)),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM v WHERE level <= ratio), 0) * weight) AS target FROM v),
d AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(3.0, t.target / t.source_size) ELSE 0.0 END AS rate,
row_number() OVER (PARTITION BY s.doc_id, s.source, s.size) - 1 AS k FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', '42', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(source, 'null'), CAST(size AS VARCHAR), CAST(k AS VARCHAR))), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS draw FROM d)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM b"""

SECRETS = """WITH k(rank, kind, form, least) AS (VALUES (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', NULL), (1, 'access', 'AKIA[A-Z0-9]{14,}', NULL), (2, 'hex', '[0-9a-f]{16,}', NULL),
(3, 'entropy_hex', '[0-9A-Fa-f]{20,}', 2.8), (4, 'entropy_base64', '[A-Za-z0-9+/_=-]{20,}', 3.8)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
z AS (SELECT doc_id, rank, kind, form, least, string_split_regex(text, form) AS parts, regexp_extract_all(text, form) AS hits FROM d, k),
u AS (SELECT doc_id, rank, kind, form, least, unnest(hits) AS hit, unnest(parts[1:len(hits)]) AS part, generate_subscripts(hits, 1) AS i FROM z),
h AS (SELECT *, sum(length(part)) OVER w + sum(length(hit)) OVER w - length(hit) AS beg FROM u WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i)),
b AS (SELECT doc_id, rank, kind, beg, beg + length(hit) AS stop FROM h WHERE rank < 3 AND (rank > 0 OR length(regexp_extract(hit, form, 2)) >= 12)),
c AS (SELECT * FROM h WHERE rank > 2 AND NOT regexp_matches(hit, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$|[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|^[^0-9]*$|^[^A-Za-z]*$|^[a-z]+(?:[-_/][a-z]+)*[-_/]?[0-9]{1,4}$')),
v AS (SELECT doc_id, rank, kind, beg AS base, least, hit, unnest(range(0, length(hit) - 19)) AS j FROM c),
e AS (SELECT doc_id, rank, kind, base + min(j) AS beg, base + max(j) + 20 AS stop FROM (SELECT *, list_aggregate(string_split(substr(hit, j + 1, 20), ''), 'entropy') AS bits FROM v) WHERE bits >= least - 1e-9 GROUP BY doc_id, rank, kind, base, hit),
s AS (SELECT * FROM b UNION ALL SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.beg < e.stop AND e.beg < b.stop))
SELECT d.doc_id, count(*) FILTER (s.rank = 0) AS n_assign, count(*) FILTER (s.rank = 1) AS n_access, count(*) FILTER (s.rank = 2) AS n_hex,
sha256(coalesce(string_agg(s.kind || ':' || CAST(s.beg AS VARCHAR) || ':' || CAST(s.stop AS VARCHAR), ',' ORDER BY s.beg, s.rank) FILTER (s.rank < 3), '')) AS base_sha256,
coalesce(string_agg(s.kind || ':' || CAST(s.beg AS VARCHAR) || ':' || CAST(s.stop AS VARCHAR), ',' ORDER BY s.beg, s.rank), '') AS spans FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""

URL_BASE = r"""p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
q AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+(\.[A-Za-z]{1,5})?$') THEN regexp_replace(x, '^[0-9]+', '{n}')
WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '^[0-9A-Za-z_-]{6,}(\.[A-Za-z]{1,5})?$') THEN regexp_replace(x, '^[0-9A-Za-z_-]+', '{id}') ELSE x END) AS whole,
TRY_CAST(regexp_extract(path, '(?:^|/)([0-9]+)(?:[.][A-Za-z]{1,5})?(?:/|$)', 1) AS BIGINT) AS number FROM p),
b AS (SELECT page_id, host, path, number, whole AS parts FROM q),
m AS (SELECT doc_id AS number, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1),
c0 AS (SELECT host, parts, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS tree FROM b LEFT JOIN m ON m.number = b.number GROUP BY host, parts)"""
URL_LEVEL = """k{i} AS (SELECT host, tree, parts[{i}] AS own, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM c{j} WHERE parts[{i}] IS NOT NULL GROUP BY ALL),
a{i} AS (SELECT host, tree, count(*) AS kinds, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM k{i} GROUP BY ALL),
e{i} AS (SELECT k.host, k.tree, own, kinds, all_n, n, labelled, bad, bad / labelled - (all_bad - bad) / (all_labelled - labelled) AS off, CASE WHEN labelled = 0 OR all_labelled = labelled OR
abs(off) <= 2.58 * sqrt(all_bad / all_labelled * (1 - all_bad / all_labelled) * (1 / labelled + 1 / (all_labelled - labelled))) THEN '*' WHEN off < 0 THEN '*-' ELSE '*+' END AS side FROM k{i} k JOIN a{i} a ON a.host = k.host AND a.tree = k.tree),
g{i} AS (SELECT host, tree, side, count(*) AS c, CAST(sum(labelled) AS DOUBLE) AS l, CAST(sum(bad) AS DOUBLE) AS b, sum(CASE WHEN labelled > 0 THEN bad * bad / labelled END) AS q FROM e{i} GROUP BY ALL),
s{i} AS (SELECT e.host, e.tree, e.own, CASE WHEN kinds > 20 AND all_n < 2 * kinds THEN '*' WHEN e.side = '*' THEN CASE WHEN kinds > 1 THEN '*' ELSE own END
WHEN g.c > 1 AND (g.b = 0 OR g.b = g.l OR (g.q - g.b * g.b / g.l) / (g.b / g.l * (1 - g.b / g.l)) <= g.c - 1 + 2.58 * sqrt(2.0 * (g.c - 1))) THEN e.side ELSE own END AS step FROM e{i} e JOIN g{i} g ON g.host = e.host AND g.tree = e.tree AND g.side = e.side),
c{i} AS (SELECT c.host, c.parts, c.n, c.labelled, c.bad, CASE WHEN step IS NULL THEN c.tree ELSE c.tree || '/' || step END AS tree FROM c{j} c LEFT JOIN s{i} s ON s.host = c.host AND s.tree = c.tree AND s.own = c.parts[{i}])"""
URL_RULES = (("block", "example.org", "/en/1"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("allow", "org", "/"))
#: Segments that the SQL walks; the operator walks all.
URL_DEPTH = 8
URLS = f"""WITH {URL_BASE}, {", ".join(URL_LEVEL.format(i=i, j=i - 1) for i in range(1, URL_DEPTH + 1))},
w AS (SELECT CASE WHEN sum(labelled) > 0 THEN (sum(bad) + 1) / (sum(labelled) + 2) ELSE 0.0 END AS base FROM c{URL_DEPTH}), h AS (SELECT host, sum(labelled) AS l, sum(bad) AS b FROM c{URL_DEPTH} GROUP BY 1),
t AS (SELECT c.host, c.tree, CAST((sum(c.bad) + 5.0 * (any_value(h.b) + 5.0 * any_value(base)) / (any_value(h.l) + 5.0)) / (sum(c.labelled) + 5.0) AS DOUBLE) AS share FROM c{URL_DEPTH} c JOIN h ON h.host = c.host, w GROUP BY 1, 2),
r AS (SELECT b.page_id, b.host, b.path, c.tree, t.share, CASE {" ".join(f"WHEN (b.host = '{h}' OR suffix(b.host, '.{h}')) AND prefix(b.path, '{p}') THEN '{v} {h}{p}'" for v, h, p in URL_RULES)} END AS hit
FROM b JOIN c{URL_DEPTH} c ON c.host = b.host AND c.parts = b.parts JOIN t ON t.host = c.host AND t.tree = c.tree)
SELECT page_id, host, path, string_split(hit, ' ')[2] AS rule, coalesce(string_split(hit, ' ')[1], CASE WHEN share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, tree AS template, round(share, 9) AS bad_share FROM r"""

ORACLES = {"op1_topk": TOP_K, "op3_sharding": SHARDS, "op4_ngram_join": NEAR, "op5_mixing": MIX, "op8_url_filter": URLS, "op10_secrets": SECRETS}
