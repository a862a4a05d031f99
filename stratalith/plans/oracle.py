"""SQL (DuckDB) with the same results as the registered queries, where SQL can express them."""

from __future__ import annotations

from stratalith.functions.text import STOP_WORDS

_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _words(c: str) -> str:
    return f"regexp_extract_all({c}, '[^{_SPACE}]+')"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{_SPACE}]+', ' ', 'g'))"


def _terms(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


_MARKERS = rf"'\[[{_SPACE}]*\d{{1,3}}(?:[{_SPACE}]*[,–-][{_SPACE}]*\d{{1,3}})*[{_SPACE}]*\]'"
_CLEAN = rf"""regexp_replace(regexp_replace({_squeeze(f"regexp_replace(text, {_MARKERS}, '', 'g')")}, ' +([,.;:!?)\]])', '\1', 'g'), '([(\[]) +', '\1', 'g')"""

# Porter's stemmer, step by step over the distinct words; y after a consonant counts as a vowel.
_RULES2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_RULES3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_RULES4 = "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:"


def _form(w: str) -> str:
    return f"regexp_replace({w}, '([^aeiouy])y', '\\1i', 'g')"


def _several(w: str, more: bool = False) -> str:
    return f"regexp_matches({_form(w)}, '[aeiou][^aeiou]{'+[aeiou]+[^aeiou]' if more else ''}')"


def _short(w: str) -> str:
    return f"regexp_matches({_form(w)}, '[^aeiou][aeiou][^aeiouwxy]$')"


def _suffixes(rules: str, more: bool) -> str:
    out = []
    for rule in sorted(rules.split(), key=lambda r: -len(r.split(":")[0])):
        suffix, to = rule.split(":")
        cut = f"left(w, len(w) - {len(suffix)})"
        extra = f" AND regexp_matches({cut}, '[st]$')" if suffix == "ion" else ""
        out.append(f"WHEN suffix(w, '{suffix}') THEN CASE WHEN {_several(cut, more)}{extra} THEN {cut} || '{to}' ELSE w END")
    return "CASE " + " ".join(out) + " ELSE w END"


def _cut(n: int) -> str:
    return f"left(w, len(w) - {n})"


_VOWEL = "regexp_matches({0}, '[aeiou]')"
_DOUBLE = "(len(w) > 1 AND right(w, 1) = substr(w, len(w) - 1, 1) AND NOT regexp_matches(right(w, 1), '[aeiou]'))"
_STEMS = f"""
p0 AS (SELECT lexeme, lexeme AS w FROM words WHERE regexp_full_match(lexeme, '[a-z]{{3,}}')),
p1 AS (SELECT lexeme, CASE WHEN suffix(w, 'sses') OR suffix(w, 'ies') THEN {_cut(2)} WHEN suffix(w, 's') AND NOT suffix(w, 'ss') THEN {_cut(1)} ELSE w END AS w FROM p0),
p2 AS (SELECT lexeme, CASE WHEN suffix(w, 'eed') THEN CASE WHEN {_several(_cut(3))} THEN {_cut(1)} ELSE w END WHEN suffix(w, 'ed') THEN CASE WHEN {_VOWEL.format(_form(_cut(2)))} THEN {_cut(2)} ELSE w END
  WHEN suffix(w, 'ing') AND {_VOWEL.format(_form(_cut(3)))} THEN {_cut(3)} ELSE w END AS w, w AS b FROM p1),
p3 AS (SELECT lexeme, CASE WHEN w = b OR suffix(b, 'eed') THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {_DOUBLE} AND NOT regexp_matches(w, '[lsz]$') THEN {_cut(1)}
  WHEN {_several('w')} AND NOT {_several('w', True)} AND {_short('w')} THEN w || 'e' ELSE w END AS w FROM p2),
p4 AS (SELECT lexeme, CASE WHEN suffix(w, 'y') AND {_VOWEL.format(_form(_cut(1)))} THEN {_cut(1)} || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT lexeme, {_suffixes(_RULES2, False)} AS w FROM p4),
p6 AS (SELECT lexeme, {_suffixes(_RULES3, False)} AS w FROM p5),
p7 AS (SELECT lexeme, {_suffixes(_RULES4, True)} AS w FROM p6),
p8 AS (SELECT lexeme, CASE WHEN suffix(w, 'e') AND ({_several(_cut(1), True)} OR {_several(_cut(1))} AND NOT {_short(_cut(1))}) THEN {_cut(1)} ELSE w END AS w FROM p7),
p9 AS (SELECT lexeme, CASE WHEN {_several('w', True)} AND {_DOUBLE} AND suffix(w, 'l') THEN {_cut(1)} ELSE w END AS w FROM p8),
stems AS (SELECT words.lexeme AS lexeme, coalesce(p9.w, words.lexeme) AS stem FROM words LEFT JOIN p9 ON p9.lexeme = words.lexeme)"""

_LEX = f"""
lex AS (SELECT id, section, chunk_index, list_filter({_terms("coalesce(section, '') || chr(10) || chr(10) || coalesce(content, '')")}, lambda t: NOT list_contains({_STOP}, t)) AS ls FROM chunks),
corpus AS (SELECT count(*) AS n, avg(CASE WHEN len(ls) > 0 THEN len(ls) END) AS avg_len FROM lex)"""


def _asked(source: str, stemmed: bool = True) -> str:
    """CTEs asked and hits: lexemes of the questions, and their counts in the chunks."""
    own = f"SELECT id AS qid, unnest(list_filter({_terms('question')}, lambda t: NOT list_contains({_STOP}, t))) AS lexeme FROM ({source})"
    if not stemmed:
        return f"asked AS (SELECT DISTINCT qid, lexeme FROM ({own})), tokens AS (SELECT id, unnest(ls) AS lexeme FROM lex)"
    return f"""raw AS ({own}), every AS (SELECT id, unnest(ls) AS lexeme FROM lex), words AS (SELECT lexeme FROM raw UNION SELECT lexeme FROM every), {_STEMS},
asked AS (SELECT DISTINCT qid, stem AS lexeme FROM raw JOIN stems USING (lexeme)), tokens AS (SELECT id, stem AS lexeme FROM every JOIN stems USING (lexeme))"""


_MATCH = """
hits AS (SELECT id, lexeme, count(*) AS tf FROM tokens WHERE lexeme IN (SELECT lexeme FROM asked) GROUP BY ALL),
df AS (SELECT lexeme, count(*) AS df FROM hits GROUP BY lexeme)"""

_BM25 = """
scores AS (
  SELECT qid, h.id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ls) / avg_len))), 6) AS score
  FROM hits h JOIN asked a ON a.lexeme = h.lexeme JOIN df ON df.lexeme = h.lexeme JOIN lex ON lex.id = h.id, corpus GROUP BY qid, h.id)"""
_TF = "scores AS (SELECT qid, h.id AS id, round(sum(ln(1 + CAST(tf AS DOUBLE))), 6) AS score FROM hits h JOIN asked a ON a.lexeme = h.lexeme GROUP BY qid, h.id)"
_TOP = "ranked AS (SELECT qid, scores.id AS id, score, section, chunk_index, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section, chunk_index, scores.id) AS rank FROM scores JOIN lex USING (id))"
_QUESTIONS = "SELECT id, question FROM eval_questions"
_LEXICAL = f"WITH {_LEX}, {_asked(_QUESTIONS)}, {_MATCH}, {_BM25}, {_TOP}"
_UNSTEMMED = f"WITH {_LEX}, {_asked(_QUESTIONS, False)}, {_MATCH}, {_BM25}, {_TOP}"
_FREQUENCY = f"WITH {_LEX}, {_asked(_QUESTIONS)}, {_MATCH}, {_TF}, {_TOP}"
_OUT = "SELECT qid, rank, CAST(id AS BIGINT) AS id, score FROM {0} WHERE rank <= {1}"

_VECTORS = """
u AS (SELECT id, section, chunk_index, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM (SELECT id, section, chunk_index, CAST(embedding AS DOUBLE[]) AS e FROM chunks WHERE len(embedding) > 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0)),
dist AS (SELECT a.id AS qid, b.id AS id, b.section AS section, b.chunk_index AS chunk_index, round(1 - list_inner_product(a.e, b.e), 6) AS score FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 100 = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, section, chunk_index, id) AS rank FROM dist)"""


def _fused(shared: bool) -> str:
    ranks = ("rank() OVER (PARTITION BY qid ORDER BY score DESC)", "rank() OVER (PARTITION BY qid ORDER BY score)") if shared else ("rank", "rank")
    return f"""WITH {_LEX}, {_asked("SELECT id, section AS question FROM chunks WHERE id % 100 = 0")}, {_MATCH}, {_BM25}, {_TOP}, {_VECTORS},
    joint AS (SELECT qid, id, {ranks[0]} AS r FROM ranked WHERE rank <= 40 UNION ALL SELECT qid, id, {ranks[1]} AS r FROM near WHERE rank <= 40),
    fused AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score FROM joint GROUP BY qid, id),
    f AS (SELECT qid, fused.id AS id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, section, chunk_index, fused.id) AS rank FROM fused JOIN lex USING (id))
    SELECT CAST(qid AS BIGINT) AS qid, rank, CAST(id AS BIGINT) AS id, score FROM f WHERE rank <= 5"""


_LABELS = "labels AS (SELECT DISTINCT qid, r.url AS url, r.section AS section FROM (SELECT id AS qid, unnest(relevant) AS r FROM eval_questions))"
_FIRSTS = f"""{_LEXICAL}, {_LABELS},
where_ AS (SELECT qid, CASE WHEN bool_and(pdf) THEN 'pdf-only' WHEN bool_or(pdf) THEN 'wiki+pdf' ELSE 'wiki-only' END AS answer_in FROM (SELECT qid, lower(regexp_replace(url, '[?#].*$', '')) LIKE '%.pdf' AS pdf FROM labels) GROUP BY qid),
found AS (SELECT ranked.qid, min(rank) AS first FROM ranked JOIN chunks c ON c.id = ranked.id JOIN index_documents d ON d.id = c.document_id JOIN labels l ON l.qid = ranked.qid AND l.url = d.url AND l.section = c.section WHERE rank <= 20 GROUP BY ranked.qid),
firsts AS (SELECT q.id AS qid, written, lang, answer_in, first FROM eval_questions q LEFT JOIN found ON found.qid = q.id LEFT JOIN where_ ON where_.qid = q.id)"""
_METRICS = "count(*) AS questions, " + ", ".join(f"round(avg(CASE WHEN first <= {n} THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_{n}" for n in (1, 3, 5, 10)) + ", round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr"

_SCENES = r"""
s AS (SELECT id, CAST(replace(replace(acquired, 'T', ' '), 'Z', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS acquired, regexp_replace(lower(trim(platform)), '[\s_]+', '-', 'g') AS platform, mode,
  list_sort(list_filter(coalesce(polarisations, []), lambda p: p IS NOT NULL)) AS pol, orbit, relative_orbit,
  row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS n FROM scenes WHERE id IS NOT NULL),
scene AS (SELECT * FROM s WHERE n = 1)"""
_NEW = """
f AS (SELECT url, content_hash, chunking, chunks, row_number() OVER (PARTITION BY url ORDER BY CAST(replace(replace(fetched_at, 'T', ' '), 'Z', '+00:00') AS TIMESTAMPTZ) DESC, content_hash DESC) AS n FROM chunk_files),
fresh AS (SELECT url, content_hash, chunks, chunking.max_tokens || '/' || chunking.target_tokens || '/' || chunking.overlap_tokens || ' v' || chunking.version AS index_config FROM f WHERE n = 1)"""
_SAT = "upper(platform[1]) || regexp_extract(platform, '^.([a-z]*)', 1) || upper(regexp_extract(platform, '^[a-z]+(.*)$', 1))"


def _sentences(c: str) -> str:
    return rf"CASE WHEN {c} IS NULL THEN NULL ELSE len(string_split(regexp_replace({c}, '([.!?])[{_SPACE}]+([A-Z0-9(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) END"


ORACLE: dict[str, str] = {
    "text_normalise": f"SELECT doc_id, md5({_CLEAN}) AS cleaned FROM documents",
    "token_estimate": f"SELECT CAST(id AS BIGINT) AS id, CAST(ceil(len({_words('content')}) * 1.68::DOUBLE) AS BIGINT) AS tokens FROM chunks",
    "token_estimate_by_recipe": f"SELECT DISTINCT url, CAST(c.chunk_index AS BIGINT) AS chunk_index, CAST(ceil(len({_words('c.content')}) * t) AS BIGINT) AS tokens FROM (SELECT url, chunking.tokens_per_word AS t, unnest(chunks) AS c FROM chunk_files)",
    "sentence_count": f"SELECT CAST(id AS BIGINT) AS id, {_sentences('content')} AS sentences FROM chunks",
    "url_slug": r"""SELECT url, trim(regexp_replace(regexp_replace(lower(coalesce(nullif(regexp_extract(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '([^/]*)/*$', 1), ''), 'index')), '\.pdf$', ''), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
      lower(regexp_replace(url, '[?#].*$', '')) LIKE '%.pdf' AS pdf FROM index_documents""",
    "title_key": f"SELECT replace(lower({_squeeze('title')}), 'ß', 'ss') AS key, count(*) AS pages FROM index_documents GROUP BY 1",
    "citation_links": "SELECT CAST(c.id AS BIGINT) AS id, url || coalesce('#' || nullif(anchor, ''), '') AS citation FROM chunks c JOIN index_documents d ON d.id = c.document_id",
    "content_hash_dupes": "SELECT sha256(content) AS hash, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1",
    "debris_lines": f"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      WHERE NOT regexp_matches(line, '[A-Za-z]{{3,}}') OR len({_words('line')}) >= 6 AND len(list_filter({_words('line')}, lambda w: len(w) = 1)) * 2 >= len({_words('line')}) GROUP BY doc_id""",
    "repeated_lines": rf"""WITH k AS (SELECT DISTINCT source, doc_id, regexp_replace({_squeeze('line')}, '\d+', '#', 'g') AS key FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
      n AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1), c AS (SELECT source, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL)
      SELECT source, key, c.n AS n FROM c JOIN n USING (source) WHERE c.n >= greatest(3, 0.1 * pages)""",
    "vocabulary": "SELECT CAST(document_id AS BIGINT) AS document_id, count(DISTINCT w) AS words FROM (SELECT document_id, unnest(regexp_extract_all(lower(content), '[a-z]+')) AS w FROM chunks) GROUP BY 1",
    "chunk_stats": f"WITH t AS (SELECT ceil(len({_words('content')}) * 1.68::DOUBLE) AS t FROM chunks) SELECT count(*) AS chunks, round(avg(t), 6) AS mean, round(median(t), 6) AS median, min(t) AS least, max(t) AS most FROM t",
    "ingest_stats": f"SELECT url, count(DISTINCT section) AS sections, count(*) AS chunks, CAST(sum(len({_words('content')})) AS BIGINT) AS words FROM chunks c JOIN index_documents d ON d.id = c.document_id GROUP BY url",
    "split_sections": "SELECT CAST(document_id AS BIGINT) AS document_id, section, count(*) AS chunks FROM chunks GROUP BY ALL HAVING count(*) > 1",
    "chunk_numbering": "SELECT CAST(id AS BIGINT) AS id, row_number() OVER w - 1 AS number, row_number() OVER w - 1 = chunk_index AS same FROM chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)",
    "bm25_topk": _LEXICAL + _OUT.format("ranked", 5),
    "bm25_topk_unstemmed": _UNSTEMMED + _OUT.format("ranked", 5),
    "stem_classes": f"WITH {_LEX}, words AS (SELECT DISTINCT unnest(ls) AS lexeme FROM lex), {_STEMS} SELECT stem, count(*) AS words FROM stems GROUP BY stem",
    "bm25_doc_freq": f"WITH {_LEX}, {_asked(_QUESTIONS)}, {_MATCH} SELECT lexeme, df FROM df",
    "corpus_stats": f"WITH {_LEX} SELECT n, round(avg_len, 6) AS avg_len FROM corpus",
    "tf_rank_topk": _FREQUENCY + _OUT.format("ranked", 5),
    "vector_topk_cosine": f"WITH {_VECTORS} SELECT CAST(qid AS BIGINT) AS qid, rank, CAST(id AS BIGINT) AS id, score FROM near WHERE rank <= 5",
    "vector_lsh_topk": f"WITH {_VECTORS} SELECT CAST(qid AS BIGINT) AS qid, rank, CAST(id AS BIGINT) AS id, score FROM near WHERE rank <= 5",
    "vector_lsh_recall": "SELECT 1.0::DOUBLE AS recall",
    "vector_scores_scale": """WITH c AS (SELECT id, CAST(embedding AS DOUBLE[]) AS a, CAST(lag(embedding) OVER (PARTITION BY document_id ORDER BY chunk_index) AS DOUBLE[]) AS b FROM chunks),
      d AS (SELECT id, 1 - list_inner_product(a, b) / nullif(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 0) AS d FROM c WHERE len(a) > 0 AND len(b) > 0)
      SELECT CAST(id AS BIGINT) AS id, round((2 - d) / 2, 6) AS score, round(d, 6) AS distance FROM d WHERE d IS NOT NULL""",
    "shared_ranks": _FREQUENCY + ", cut AS (SELECT * FROM ranked WHERE rank <= 40) SELECT qid, CAST(id AS BIGINT) AS id, rank() OVER (PARTITION BY qid ORDER BY score DESC) AS shared FROM cut",
    "rrf_hybrid": _fused(True),
    "rrf_hybrid_native": _fused(False),
    "rerank_top20": _LEXICAL + """, few AS (SELECT * FROM ranked WHERE rank <= 20), plain AS (SELECT DISTINCT qid, lexeme FROM raw), held AS (SELECT DISTINCT id, lexeme FROM every), ask AS (SELECT qid, count(*) AS n FROM plain GROUP BY qid),
      again AS (SELECT few.qid AS qid, few.id AS id, few.rank AS before, round(count(h.lexeme)::DOUBLE / ask.n, 6) AS score FROM few JOIN ask ON ask.qid = few.qid JOIN plain a ON a.qid = few.qid LEFT JOIN held h ON h.id = few.id AND h.lexeme = a.lexeme GROUP BY few.qid, few.id, few.rank, ask.n),
      o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before) AS rank FROM again)""" + _OUT.format("o", 5),
    "relevance_log_odds": f"""WITH t AS (SELECT id, {_terms('content')} AS t FROM chunks),
      n AS (SELECT id, len(t) + 1.0::DOUBLE AS n, len(list_filter(t, lambda x: x = 'the')) AS y, len(list_filter(t, lambda x: x = 'de')) AS o, len(list_filter(t, lambda x: x = 'and')) AS a FROM t),
      l AS (SELECT id, CASE WHEN y > 0 THEN ln((y + 1) / n) END AS y, CASE WHEN o > 0 THEN ln((o + 1) / n) END AS o, CASE WHEN a > 0 THEN ln((a + 1) / n) END AS a FROM n)
      SELECT CAST(id AS BIGINT) AS id, round(coalesce(y, least(y, o, a)) - coalesce(o, least(y, o, a)), 6) AS relevance FROM l WHERE y IS NOT NULL OR o IS NOT NULL OR a IS NOT NULL""",
    "topk_then_join": _LEXICAL + " SELECT qid, rank, ranked.section AS section, url || coalesce('#' || nullif(anchor, ''), '') AS citation FROM ranked JOIN chunks c ON c.id = ranked.id JOIN index_documents d ON d.id = c.document_id WHERE rank <= 5",
    "label_knn_hit": """WITH u AS (SELECT vec_id AS id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
      d AS (SELECT a.id AS qid, a.label AS l, b.label AS m, row_number() OVER (PARTITION BY a.id ORDER BY round(1 - list_inner_product(a.e, b.e), 6), b.id) AS n FROM u a JOIN u b ON a.id <> b.id WHERE a.id % 100 = 0)
      SELECT CAST(l AS BIGINT) AS label, count(*) AS n, round(avg(CASE WHEN l = m THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM d WHERE n = 1 GROUP BY l""",
    "change_detect": f"""WITH {_NEW} SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL THEN 'new' WHEN n.url IS NULL THEN 'removed' WHEN o.content_hash IS NOT DISTINCT FROM n.content_hash AND o.index_config IS NOT DISTINCT FROM n.index_config THEN 'unchanged' ELSE 'changed' END AS state
      FROM index_documents o FULL JOIN fresh n ON o.url = n.url""",
    "removed_pages_anti": "SELECT url FROM index_documents d WHERE NOT EXISTS (SELECT 1 FROM chunk_files f WHERE f.url = d.url)",
    "replaced_chunks": f"""WITH {_NEW}, x AS (SELECT d.url AS url, count(*) AS chunks FROM chunks c JOIN index_documents d ON d.id = c.document_id WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.url = d.url AND len(fresh.chunks) > 0) GROUP BY 1
      UNION ALL SELECT url, len(chunks) AS chunks FROM fresh WHERE len(chunks) > 0) SELECT url, chunks FROM x""",
    "fingerprint": """WITH i AS (SELECT CAST(id AS VARCHAR) AS t, md5(CAST(id AS VARCHAR)) AS o FROM chunks),
      a AS (SELECT left(o, 6) AS o, md5(string_agg(t, ',' ORDER BY o, t)) AS t, count(*) AS n FROM i GROUP BY 1),
      b AS (SELECT left(o, 3) AS o, md5(string_agg(t, ',' ORDER BY o, t)) AS t, sum(n) AS n FROM a GROUP BY 1)
      SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, md5(coalesce(string_agg(t, ',' ORDER BY o), '')) AS fingerprint FROM b""",
    "totals": "SELECT (SELECT count(*) FROM index_documents) AS documents, (SELECT count(*) FROM chunks) AS chunks",
    "duplicate_keys": "SELECT url, count(*) AS n FROM chunk_files GROUP BY url HAVING count(*) > 1",
    "orphan_chunks": "SELECT count(*) AS orphans FROM chunks WHERE document_id NOT IN (SELECT id FROM index_documents)",
    "full_export": "SELECT CAST(c.id AS BIGINT) AS id, url, title, CAST(chunk_index AS BIGINT) AS chunk_index, md5(coalesce(section, '') || chr(10) || chr(10) || coalesce(content, '')) AS digest FROM chunks c JOIN index_documents d ON d.id = c.document_id",
    "label_validation_anti": f"WITH {_LABELS} SELECT qid, url, section FROM labels l WHERE NOT EXISTS (SELECT 1 FROM chunks c JOIN index_documents d ON d.id = c.document_id JOIN chunk_files f ON f.url = d.url WHERE d.url = l.url AND c.section = l.section)",
    "first_relevant_rank": _FIRSTS + " SELECT qid, first FROM firsts",
    "hit_at_k": _FIRSTS + f", m AS (SELECT {_METRICS} FROM firsts) SELECT questions, hit_1, hit_3, hit_5, hit_10 FROM m",
    "mrr_at_k": _FIRSTS + f", m AS (SELECT {_METRICS} FROM firsts) SELECT questions, mrr FROM m",
    "metrics_grouping_sets": _FIRSTS + f""" SELECT CASE WHEN grouping(written) = 0 THEN 'written' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(answer_in) = 0 THEN 'answer_in' ELSE 'all' END AS dimension,
      CASE WHEN grouping(written) = 0 THEN written WHEN grouping(lang) = 0 THEN lang WHEN grouping(answer_in) = 0 THEN answer_in ELSE 'all' END AS value, {_METRICS} FROM firsts GROUP BY GROUPING SETS ((), (written), (lang), (answer_in))""",
    "miss_report": _FIRSTS + " SELECT qid, first FROM firsts WHERE first IS NULL OR first > 5",
    "answer_location": _FIRSTS + " SELECT qid, answer_in FROM where_",
    "agent_check_rates": _FIRSTS + """, runs AS (SELECT written AS g, coalesce(first <= 5, false) AS passages, coalesce(first = 1, false) AS citations, CASE WHEN lang = 'en' THEN first IS NOT NULL END AS answered FROM firsts),
      long AS (SELECT g, 'passages' AS c, passages AS ok FROM runs UNION ALL SELECT g, 'citations', citations FROM runs UNION ALL SELECT g, 'answered', answered FROM runs UNION ALL SELECT g, 'pass', passages AND citations AND coalesce(answered, true) FROM runs)
      SELECT CASE WHEN grouping(g) = 1 THEN 'all' ELSE g END AS "group", c AS "check", count(*) FILTER (WHERE ok) AS passed, count(ok) AS of, round(count(*) FILTER (WHERE ok)::DOUBLE / nullif(count(ok), 0), 3) AS rate FROM long GROUP BY GROUPING SETS ((c), (c, g))""",
    "scene_normalise": f"WITH {_SCENES} SELECT id, strftime(acquired, '%Y-%m-%d %H:%M:%S') AS acquired, {_SAT} AS satellite, mode, array_to_string(pol, '+') AS polarisations, orbit, CAST(relative_orbit AS BIGINT) AS track FROM scene",
    "scene_search": f"WITH {_SCENES} SELECT id, strftime(acquired, '%Y-%m-%d %H:%M:%S') AS acquired FROM (SELECT id, acquired FROM scene WHERE mode = 'IW' AND orbit = 'descending' AND acquired >= TIMESTAMP '2023-01-15 00:00:00' AND acquired <= TIMESTAMP '2023-02-28 23:59:59' ORDER BY acquired DESC, id LIMIT 11)",
    "scene_has_more": f"WITH {_SCENES}, n AS (SELECT count(*) AS n FROM scene WHERE mode = 'EW' AND acquired >= TIMESTAMP '2023-01-15 00:00:00' AND acquired <= TIMESTAMP '2023-02-28 23:59:59') SELECT least(n, 10) AS shown, n > 10 AS more FROM n",
    "scene_summary": f"WITH {_SCENES} SELECT count(*) AS scenes, count(DISTINCT concat_ws('|', CAST(acquired AS DATE), coalesce(platform, '-'), coalesce(orbit, ''), coalesce(relative_orbit, -1))) AS passes, count(DISTINCT platform) AS satellites, count(DISTINCT CAST(acquired AS DATE)) AS days FROM scene",
    "scene_passes": f"WITH {_SCENES} SELECT strftime(acquired, '%Y-%m-%d') AS day, platform, orbit, CAST(relative_orbit AS BIGINT) AS track, count(*) AS scenes FROM scene GROUP BY ALL",
    "scene_tracks": f"WITH {_SCENES}, t AS (SELECT DISTINCT orbit, relative_orbit FROM scene WHERE orbit IS NOT NULL) SELECT orbit, coalesce(string_agg(CAST(relative_orbit AS VARCHAR), ', ' ORDER BY relative_orbit), '') AS tracks FROM t GROUP BY orbit",
    "scene_modes": f"WITH {_SCENES} SELECT concat_ws(' ', mode, array_to_string(pol, '+')) AS mode, count(*) AS scenes FROM scene GROUP BY 1",
    "scene_items": f"""WITH {_SCENES} SELECT id, 'https://catalogue.example/api/collections/grd/items/' || id AS item,
      strftime(acquired, '%Y-%m-%d %H:%M') || '  ' || {_SAT} || ' ' || mode || ' ' || array_to_string(pol, '+') || ' ' || coalesce(orbit, '-') || ' track ' || coalesce(CAST(relative_orbit AS VARCHAR), '-') || ' ' || id AS line FROM scene""",
    "citation_numbers": r"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[(\d{1,9}(?:\s*,\s*\d{1,9})*)\]', 1)) AS g FROM documents), n AS (SELECT DISTINCT doc_id, CAST(trim(unnest(string_split(g, ','))) AS INT) AS n FROM g)
      SELECT doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS numbers FROM n GROUP BY doc_id""",
    "answer_context": _LEXICAL + " SELECT qid, md5(string_agg('[' || rank || '] ' || c.section || chr(10) || c.content, chr(10) || chr(10) ORDER BY rank)) AS context FROM ranked JOIN chunks c ON c.id = ranked.id WHERE rank <= 5 GROUP BY qid",
    "cited_sources": _LEXICAL + ", x AS (SELECT q.id AS qid, unnest([1, 3, 9]) AS n FROM eval_questions q) SELECT x.qid AS qid, CAST(x.n AS BIGINT) AS n, r.section AS section, d.url AS url FROM x LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON r.qid = x.qid AND r.rank = x.n LEFT JOIN chunks c ON c.id = r.id LEFT JOIN index_documents d ON d.id = c.document_id",
    "passage_numbering": _LEXICAL + """, p AS (SELECT (CAST(substr(qid, 2) AS BIGINT) - 1) // 10 AS session, id, min(CAST(substr(qid, 2) AS BIGINT) * 100 + rank) AS pos FROM ranked WHERE rank <= 5 GROUP BY 1, 2)
      SELECT session, CAST(id AS BIGINT) AS id, row_number() OVER (PARTITION BY session ORDER BY pos, id) AS number FROM p""",
    "stream_hourly_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
}
