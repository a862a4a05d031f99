"""SQL (DuckDB) with the same results as the registered queries, where SQL can express them."""

_RUNS = r"""
WITH w AS (
  SELECT id, regexp_extract_all(lower(coalesce(section, '') || chr(10) || chr(10) || coalesce(content, '')), '[\p{L}\p{N}]+') AS ws FROM chunks),
s AS (
  SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (
  SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT p.id_a, p.id_b FROM p JOIN n x ON x.id = p.id_a JOIN n y ON y.id = p.id_b
WHERE shared * 10 >= (x.n + y.n - shared) * 6
"""

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_OVERSIZED = rf"""
WITH e AS (
  SELECT DISTINCT url, chunking.max_tokens AS m, chunking.tokens_per_word AS t, c.chunk_index AS chunk_index, c.content AS content
  FROM (SELECT url, chunking, unnest(chunks) AS c FROM chunk_files)),
big AS (
  SELECT url, chunk_index, m, t, content FROM e
  WHERE ceil(len(regexp_extract_all(content, '[^{_SPACE}]+')) * t) > m),
parts AS (
  SELECT url, chunk_index, m, t,
    unnest(string_split(regexp_replace(content, '([.!?])[{_SPACE}]+([A-Z0-9(\[])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS x FROM big)
SELECT url, chunk_index, CASE WHEN max(ceil(len(regexp_extract_all(x, '[^{_SPACE}]+')) * t) > m) THEN 'forced' ELSE 'natural' END AS cut
FROM parts GROUP BY url, chunk_index
"""

_TERMS = r"""
WITH x AS (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS term FROM chunks),
c AS (SELECT term, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT id) AS BIGINT) AS records FROM x GROUP BY term),
m AS (SELECT term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > 30 * (SELECT count(*) FROM chunks) THEN 'common' END AS mark FROM c)
"""

_TOKENS = rf"""
WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+')) AS tokens FROM documents)"""
_LENGTHS = _TOKENS + """
SELECT window_id, doc_id FROM n, context_windows WHERE tokens > capacity
"""

# Classes of equal sets, similar classes as links, and components by repeated steps to the smallest id.
_CLASSES = _RUNS.replace("WITH w AS", "WITH RECURSIVE w AS").replace("SELECT p.id_a, p.id_b FROM p", "SELECT * FROM sized").strip()
_CLASSES = _CLASSES[: _CLASSES.index("SELECT * FROM sized")].rstrip() + """,
sized AS (SELECT p.id_a, p.id_b, shared, x.n AS n, y.n AS m FROM p JOIN n x ON x.id = p.id_a JOIN n y ON y.id = p.id_b WHERE shared * 10 >= (x.n + y.n - shared) * 6),
twice AS (SELECT id_a AS a, id_b AS b, shared = n AND shared = m AS same FROM sized UNION ALL SELECT id_b, id_a, shared = n AND shared = m FROM sized),
rep AS (SELECT n.id AS id, least(n.id, coalesce(min(b) FILTER (WHERE same), n.id)) AS rep FROM n LEFT JOIN twice ON a = n.id GROUP BY n.id),
edge AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM twice JOIN rep x ON x.id = a JOIN rep y ON y.id = b WHERE x.rep <> y.rep),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS links FROM edge GROUP BY a)
SELECT CAST(rep.id AS BIGINT) AS id, CAST(coalesce(c, rep) AS BIGINT) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS links FROM rep LEFT JOIN comp ON comp.a = rep LEFT JOIN deg ON deg.a = rep
"""

_PLACED = _TOKENS + """
SELECT CAST(window_id AS BIGINT) AS window_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS "over", CAST(0 AS BIGINT) AS wrong, true AS "full" FROM n, context_windows GROUP BY window_id
"""

_PAGE_WORDS = rf"""
WITH e AS (SELECT DISTINCT url, chunking, c FROM (SELECT url, chunking, unnest(chunks) AS c FROM chunk_files)),
x AS (SELECT DISTINCT url, chunking.max_tokens, chunking.overlap_tokens, chunking.tokens_per_word, c.chunk_index, c.section, c.anchor, c.content FROM e)
SELECT url, CAST(sum(len(regexp_extract_all(coalesce(content, ''), '[^{_SPACE}]+'))) AS BIGINT) AS words, CAST(0 AS BIGINT) AS "over" FROM x GROUP BY url
"""

_RANKED = """
WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE len(embedding) > 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
d AS (SELECT a.id AS id, b.id AS other, round(1 - list_inner_product(a.e, b.e), 6) AS distance FROM u a JOIN u b ON a.id <> b.id),
r AS (SELECT id, other, distance, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS n FROM d)
"""
_CLOSEST = _RANKED + """
SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM r WHERE n <= 5
"""

ORACLE: dict[str, str] = {
    "p1_found": _RUNS,
    "p1_classes": _CLASSES,
    "p2_found": _OVERSIZED,
    "p2_checks": _PAGE_WORDS,
    "p3_found": _CLOSEST,
    "p3_neighbours": _RANKED + "SELECT CAST(id AS BIGINT) AS id, CAST(n AS INT) AS rank, CAST(other AS BIGINT) AS neighbour, distance + 0.0 AS distance FROM r WHERE n <= 5",
    "p4_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p4_terms": _TERMS + "SELECT * FROM m",
    "p6_found": _LENGTHS,
    "p6_checks": _PLACED,
}
