"""DuckDB SQL with the results of those operators that SQL can express on whole tables."""

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Least label reachable by ``links`` (x, y, both ways) from each of ``nodes`` (id).
_COMPONENTS = "reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, links.y FROM reach JOIN links ON links.x = reach.b), component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END), lambda i: md5(array_to_string(ws[i + 1:i + 5], ' ')))) AS g FROM w),
nodes AS (SELECT DISTINCT doc_id AS id FROM s), e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS k FROM s),
c AS (SELECT x.doc_id AS x, y.doc_id AS y, x.n AS nx, y.n AS ny, count(*) AS common FROM e x JOIN e y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2, 3, 4),
links AS MATERIALIZED (SELECT x, y FROM c WHERE 100 * common >= 80 * (nx + ny - common)), {_COMPONENTS}
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN component ON id = doc_id"""

EMBEDDING_DEDUP = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS x, y.vec_id AS y FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
n AS (SELECT x AS id, count(*) AS n FROM links GROUP BY 1), {_COMPONENTS}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN n USING (id)"""

SUBSTRING_DEDUP = f"""WITH w AS MATERIALIZED (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS ws FROM documents),
h AS (SELECT doc_id, list_transform(range(len(ws) - 19), lambda i: md5(array_to_string(ws[i + 1:i + 20], ' '))) AS hs FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, unnest(hs) AS k, unnest(range(len(hs))) AS i FROM h),
d AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM d, range(20) t(j)),
r AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
a AS (SELECT r.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY r.i) FILTER (gone.i IS NULL), '') AS kept FROM r LEFT JOIN gone ON gone.doc_id = r.doc_id AND gone.i = r.i GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS newest FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to FROM d"""

DIVERGENCE = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT id, lang, source, unnest(ws) AS term FROM d), c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS kn FROM c GROUP BY ALL HAVING sum(docs) >= 30), v AS (SELECT lang, count(*) AS v, sum(kn) AS vn FROM k GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, kn, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS gn, v, vn FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (gn + 5 * v) AS p, 1 + 1000000000 * (kn + 5) // (vn + 5 * v) AS q FROM x),
u AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term GROUP BY ALL
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50"""
