"""DuckDB SQL for the queries: written apart from the DataFrame plans, over the same tables."""

from __future__ import annotations

from ravine.functions import fixed

ORACLE_SQL: dict[str, str] = {}


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(text: str, words: list[str]) -> str:
    return f"list_bool_or(list_transform({_list(words)}, lambda w: contains({text}, w)))"


def _starts(text: str, words: list[str]) -> str:
    return f"list_bool_or(list_transform({_list(words)}, lambda w: starts_with({text}, w)))"


def _count(text: str, words: list[str]) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains({text}, w)))"


TERMS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
WORDS = "list_filter(string_split_regex(lower({0}), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')"
CONTENT_HASH = "sha256(lower(trim(regexp_replace({0}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))))"
UNIT = "(SELECT vec_id, label, list_transform(e, lambda x: x / n) AS e FROM (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, label, {0} AS e FROM embeddings WHERE embedding IS NOT NULL)))"
CALLS = """(SELECT o_orderkey AS call_id, o_custkey AS customer_id, o_orderdate AS started_at, o_totalprice AS duration,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'no_answer' END AS status,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'inbound' ELSE 'outbound' END AS direction FROM orders)"""
ENTITIES = """(SELECT 'R' || r_regionkey AS entity_id, r_name AS name, 'REGION' AS entity_type FROM region
  UNION ALL SELECT 'N' || n_nationkey, n_name, 'NATION' FROM nation UNION ALL SELECT 'S' || s_suppkey, s_name, 'SUPPLIER' FROM supplier)"""
RELATIONS = """(SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'BASED_IN' AS relation_type FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'PART_OF' FROM nation)"""
MENTIONS = "(SELECT DISTINCT 'S' || l_suppkey AS entity_id, l_orderkey AS child_id FROM lineitem)"


def _similar(e: str, k: int, same: str = "") -> str:
    u = UNIT.format(e)
    return f"""
WITH u AS {u}, p AS (SELECT q.vec_id AS query_id, v.vec_id AS child_id, list_inner_product(q.e, v.e) AS sim
  FROM u q JOIN u v ON true {same} WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, child_id) AS rank FROM p)
SELECT query_id, child_id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= {k}"""


ORACLE_SQL["semantic_topk"] = """
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS child_id, round(list_inner_product(q.e, v.embedding::DOUBLE[]) /
  (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS similarity
FROM embeddings v, q ORDER BY similarity DESC, child_id LIMIT 10"""
ORACLE_SQL["semantic_batch_topk"] = _similar("embedding::DOUBLE[]", 10)
ORACLE_SQL["semantic_topk_by_collection"] = _similar("embedding::DOUBLE[]", 5, "AND q.label = v.label")
ORACLE_SQL["matryoshka_topk"] = _similar("(embedding::DOUBLE[])[1:16]", 10)
ORACLE_SQL["l2_normalize_check"] = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, sqrt(list_inner_product(e, e)) AS whole, sqrt(list_inner_product(e[1:16], e[1:16])) AS part FROM v)
SELECT vec_id AS child_id, round(whole / whole, 6) AS unit, round(part / part, 6) AS short, round(part / whole, 6) AS late, 16 AS dims FROM n"""

ORACLE_SQL["keyword_extract"] = f"""
WITH w AS (SELECT item_id, {WORDS.format("text")} AS ws FROM benchmark),
k AS (SELECT item_id, list_transform(list_filter(ws, lambda x: NOT list_contains({_list(fixed.STOP_WORDS)}, x) AND length(x) > 2),
  lambda x: trim(x, '.,!?;:''"()[]{{}}')) AS ks FROM w)
SELECT item_id AS query_id, array_to_string(list_filter(ks, lambda x, i: list_position(ks, x) = i), ' ') AS keywords FROM k"""
ORACLE_SQL["query_intent"] = f"""
WITH q AS (SELECT conv_id, turn, lower(text) AS t FROM conversations WHERE role = 'user'),
g AS (SELECT *, {_any("t", fixed.GRAPH_HINTS)} AS g FROM q)
SELECT conv_id, turn, CASE WHEN {_starts("t", fixed.FACTUAL_STARTS)} THEN 'factual' WHEN {_starts("t", fixed.PROCEDURAL_STARTS)} THEN 'procedural'
  WHEN {_any("t", fixed.COMPARATIVE_HINTS)} THEN 'comparative' WHEN g THEN 'relational' ELSE 'general' END AS intent,
  g AS requires_graph, CASE WHEN g THEN 1.0 ELSE 0.5 END::DOUBLE AS graph_weight FROM g"""
ORACLE_SQL["content_hash_dedup"] = f"""
SELECT {CONTENT_HASH.format("text")} AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"""
ORACLE_SQL["batch_dedup_first_wins"] = """
SELECT min(doc_id) AS doc_id, source, substr(sha256(text), 1, 32) AS hash FROM documents GROUP BY source, hash"""
ORACLE_SQL["idempotent_register"] = f"""
WITH h AS (SELECT doc_id, lang, {CONTENT_HASH.format("text")} AS hash FROM documents)
SELECT doc_id, hash FROM h WHERE lang = 'en' AND hash NOT IN (SELECT hash FROM h WHERE lang <> 'en')"""
ORACLE_SQL["chunk_store_dedup"] = f"""
WITH h AS (SELECT doc_id, source, {CONTENT_HASH.format("text")} AS content_hash FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS n FROM h
  WHERE source >= 'src15' AND content_hash NOT IN (SELECT content_hash FROM h WHERE source < 'src15'))
SELECT doc_id, source, content_hash FROM r WHERE n = 1"""
ORACLE_SQL["token_estimate"] = "SELECT source, sum(length(text) // 4)::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY source"
ORACLE_SQL["section_heading"] = """
WITH f AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS l FROM documents),
h AS (SELECT doc_id, coalesce(nullif(trim(regexp_extract(l, '^#+[ \\t]+(.+?)$', 1)), ''), nullif(trim(regexp_extract(l, '^([A-Za-z][A-Za-z ]+)$', 1)), ''),
  nullif(trim(regexp_extract(l, '^([0-9]+\\.?[ \\t]+.+?)$', 1)), ''), nullif(trim(regexp_extract(l, '^((?i:chapter)[ \\t]+[0-9]+.*)$', 1)), ''),
  nullif(trim(regexp_extract(l, '^((?i:section)[ \\t]+[0-9]+.*)$', 1)), '')) AS heading FROM f)
SELECT * FROM h WHERE heading IS NOT NULL"""
ORACLE_SQL["table_context"] = """
SELECT n_name, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || s_suppkey || ' | ' || s_name || ' |', chr(10) ORDER BY s_suppkey) AS markdown,
  'Table with columns: key, name. ' || count(*) || ' rows.' AS context, true AS is_table
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"""
ORACLE_SQL["ocr_confidence"] = """
WITH c AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\\p{L}\\p{N} .,;:!?\\n\\t-]', '', 'g')) AS good FROM documents)
SELECT doc_id, round(CASE WHEN text IS NULL OR length(trim(text)) < 10 THEN 0.1::DOUBLE ELSE
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, (good::DOUBLE / n * 0.8::DOUBLE + (1 - (n - good)::DOUBLE / n) * 0.2::DOUBLE) * CASE WHEN n < 50 THEN 0.7::DOUBLE WHEN n < 100 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END)) END, 6) AS confidence
FROM c"""
ORACLE_SQL["regroup_chunks"] = """
WITH n AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5 AS p FROM conversations),
g AS (SELECT conv_id, p, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM n GROUP BY 1, 2)
SELECT conv_id AS document, p AS parent_index, md5(t) AS text_md5, length(t) AS chars FROM g"""
_TRANSCRIPT = "(SELECT conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS t, string_agg(CASE WHEN role = 'user' THEN coalesce(text, '') END, ' ' ORDER BY turn) AS u, count(*) AS n FROM conversations GROUP BY conv_id)"
_LADDER = " ".join(f"WHEN {_any('t', w)} THEN '{o}'" for o, w in fixed.OUTCOMES.items())
ORACLE_SQL["outcome_classifier"] = f"""
WITH c AS (SELECT conv_id, lower(t) AS t FROM {_TRANSCRIPT}), s AS (SELECT *, {_count("t", fixed.POSITIVE)} AS p, {_count("t", fixed.NEGATIVE)} AS m FROM c)
SELECT conv_id, CASE {_LADDER} ELSE 'completed' END AS outcome, CASE WHEN p > m + 1 THEN 'positive' WHEN m > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM s"""
ORACLE_SQL["transcript_assembly"] = f"SELECT conv_id, n AS turns, md5(t) AS transcript_md5 FROM {_TRANSCRIPT}"
ORACLE_SQL["customer_text_only"] = f"SELECT conv_id, md5(coalesce(u, '')) AS text_md5, length(coalesce(u, '')) AS chars FROM {_TRANSCRIPT}"
ORACLE_SQL["phone_normalize"] = """
SELECT c_custkey, '+55' || lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0') AS clean,
  '+55' || lpad(c_nationkey::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 9, '0') AS e164 FROM customer"""
ORACLE_SQL["csv_lead_normalize"] = """
SELECT '+' || lpad(c_custkey::VARCHAR, 11, '5') AS phone, c_name AS name, NULL::VARCHAR AS email,
  '{"segment":"' || c_mktsegment || '"}' AS custom_fields FROM customer WHERE c_acctbal > 0"""
ORACLE_SQL["json_props_extract"] = """
SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS sum_k, max(json_extract_string(props, '$.k')::INT) AS max_k
FROM events GROUP BY event_type"""
ORACLE_SQL["html_pages"] = """
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'),
  '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) AS text_md5 FROM pages"""
ORACLE_SQL["file_types"] = """
SELECT page_id, ['pdf', 'txt', 'docx', 'image', 'unknown'][(page_id % 5 + 1)::INT] AS kind,
  ['application/pdf', 'text/markdown', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'image/png', 'application/octet-stream'][(page_id % 5 + 1)::INT] AS mime_type FROM pages"""
ORACLE_SQL["call_state_map"] = "SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'in_progress' ELSE 'cancelled' END AS state, count(*) AS n FROM orders GROUP BY 1"
ORACLE_SQL["yes_no_scores"] = """
WITH a AS (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations WHERE role = 'assistant'),
f AS (SELECT *, rtrim(string_split_regex(t, '[ \\t\\n\\r\\f\\v]+')[1], '.,!?;:') AS w FROM a)
SELECT conv_id, turn, (CASE WHEN starts_with(w, 'yes') OR w IN ('sim', 'y') THEN 0.9 WHEN starts_with(w, 'no') OR w IN ('não', 'n') THEN CASE WHEN contains(t, 'yes') THEN 0.6 ELSE 0.1 END
  WHEN contains(t, 'yes') THEN 0.7 WHEN contains(t, 'no') THEN 0.3 ELSE 0.5 END)::DOUBLE AS score FROM f"""

_POSTED = f"""p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format("text")}) AS term FROM documents) GROUP BY 1, 2),
w AS (SELECT DISTINCT item_id, unnest({TERMS.format("text")}) AS term FROM benchmark)"""
_MATCHED = f"""{_POSTED}, n AS (SELECT item_id, count(*) AS n FROM w GROUP BY 1),
m AS (SELECT w.item_id, p.doc_id, sum(tf)::BIGINT AS tf FROM w JOIN p USING (term) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) = any_value(n.n))"""
ORACLE_SQL["lexical_and_match"] = f"WITH {_MATCHED} SELECT item_id AS query_id, doc_id AS child_id, tf FROM m"
ORACLE_SQL["lexical_tf_rank"] = f"""
WITH {_MATCHED}, l AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY 1),
r AS (SELECT item_id, doc_id, tf / (1 + ln(l.n)) AS s, row_number() OVER (PARTITION BY item_id ORDER BY tf / (1 + ln(l.n)) DESC, doc_id) AS rank FROM m JOIN l USING (doc_id))
SELECT item_id AS query_id, doc_id AS child_id, round(s, 6) AS score, rank FROM r WHERE rank <= 50"""
_BM25 = f"""{_POSTED}, l AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT item_id AS query_id, doc_id AS child_id, round(sum(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.n / mean))), 6) AS score
  FROM w JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), c GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM b)"""
ORACLE_SQL["bm25_topk"] = f"WITH {_BM25} SELECT query_id, child_id, score, rank FROM br WHERE rank <= 20"
ORACLE_SQL["ilike_density_rank"] = """
SELECT doc_id AS child_id, round((length(t) - length(replace(t, 'rights', ''))) / 6::DOUBLE / greatest(length(t), 1) * 100, 6) AS score
FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE contains(t, 'rights') ORDER BY score DESC, child_id LIMIT 50"""
ORACLE_SQL["ilike_or_search"] = "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%machin%' OR c_mktsegment ILIKE '%machin%'"

_CHANNELS = f"""{_BM25}, lex AS (SELECT query_id, child_id, rank, score FROM br WHERE rank <= 50),
u AS {UNIT.format("embedding::DOUBLE[]")},
sp AS (SELECT q.vec_id AS query_id, v.vec_id AS child_id, list_inner_product(q.e, v.e) AS sim FROM u q JOIN benchmark ON item_id = q.vec_id, u v),
sr AS (SELECT query_id, child_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, child_id) AS rank, round(sim, 6) AS score FROM sp),
sem AS (SELECT * FROM sr WHERE rank <= 50),
kw AS (SELECT query_id, string_split(keywords, ' ') AS ks FROM ({ORACLE_SQL["keyword_extract"]}) WHERE keywords <> ''), k1 AS (SELECT query_id, len(ks) AS n, unnest(ks) AS word FROM kw),
te AS (SELECT term FROM p WHERE length(term) >= 12 GROUP BY term HAVING count(*) BETWEEN 2 AND 10),
kt AS (SELECT DISTINCT query_id, n, term FROM k1 JOIN te ON contains(term, lower(word))),
kr AS (SELECT query_id, doc_id AS child_id, count(*) AS m, any_value(n) AS n, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank FROM kt JOIN p USING (term) GROUP BY 1, 2),
kin AS (SELECT query_id, child_id, rank, round(m / n, 6) AS score FROM kr WHERE rank <= 20)"""
_FUSED = f"""{_CHANNELS}, fu AS (SELECT coalesce(a.query_id, b.query_id, c.query_id) AS query_id, coalesce(a.child_id, b.child_id, c.child_id) AS child_id,
  a.rank AS lr, b.rank AS sr, c.rank AS gr, a.score AS ls, b.score AS ss, c.score AS gs,
  coalesce(0.7::DOUBLE / (60 + a.rank), 0) + coalesce(0.8::DOUBLE / (60 + b.rank), 0) + coalesce(1.0::DOUBLE / (60 + c.rank), 0) AS rrf
  FROM lex a FULL JOIN sem b ON a.query_id = b.query_id AND a.child_id = b.child_id
  FULL JOIN kin c ON c.query_id = coalesce(a.query_id, b.query_id) AND c.child_id = coalesce(a.child_id, b.child_id))"""
ORACLE_SQL["rrf_two_channel"] = f"""
WITH {_CHANNELS} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.child_id, b.child_id) AS child_id,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS rrf_score, round(a.score, 6) AS lexical_score, round(b.score, 6) AS semantic_score
FROM lex a FULL JOIN sem b ON a.query_id = b.query_id AND a.child_id = b.child_id"""
ORACLE_SQL["rrf_weighted_three_channel"] = f"""
WITH {_FUSED} SELECT query_id, child_id, round(rrf, 6) AS rrf_score, lr AS lexical_rank, sr AS semantic_rank, gr AS graph_rank,
  concat_ws(',', CASE WHEN gr IS NOT NULL THEN 'graph' END, CASE WHEN lr IS NOT NULL THEN 'lexical' END, CASE WHEN sr IS NOT NULL THEN 'semantic' END) AS sources FROM fu"""
ORACLE_SQL["rrf_full_outer_sql"] = f"""
WITH {_CHANNELS} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.child_id, b.child_id) AS child_id, a.rank AS rank_a, b.rank AS rank_b,
  round(coalesce(0.7::DOUBLE / (60 + a.rank), 0) + coalesce(0.8::DOUBLE / (60 + b.rank), 0), 6) AS rrf_score
FROM lex a FULL JOIN sem b ON a.query_id = b.query_id AND a.child_id = b.child_id"""
ORACLE_SQL["safety_threshold"] = f"WITH {_FUSED} SELECT query_id, child_id, round(rrf, 6) AS rrf_score FROM fu WHERE greatest(coalesce(ls, -1), coalesce(ss, -1), coalesce(gs, -1)) >= 0.6"
ORACLE_SQL["conformal_denoise"] = f"""
WITH {_FUSED}, f9 AS (SELECT query_id, child_id, round(rrf, 9) AS r FROM fu), cut AS (SELECT query_id, quantile_cont(r, 0.4) AS c, count(*) AS n FROM f9 GROUP BY 1)
SELECT query_id, child_id, round(r, 6) AS rrf_score FROM f9 JOIN cut USING (query_id) WHERE n < 3 OR r >= c"""
ORACLE_SQL["minmax_normalize"] = f"""
WITH {_FUSED}, e AS (SELECT query_id, min(rrf) AS lo, max(rrf) AS hi FROM fu GROUP BY 1)
SELECT query_id, child_id, round(CASE WHEN hi > lo THEN (rrf - lo) / (hi - lo) ELSE 1.0 END, 6) AS normalized FROM fu JOIN e USING (query_id)"""
_RERANKED = f"""{_FUSED}, f9 AS (SELECT *, round(rrf, 9) AS r9 FROM fu),
t20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r9 DESC, child_id) AS n FROM f9) WHERE n <= 20),
tw AS (SELECT t20.*, d.text, d.lang, list_distinct({WORDS.format("q.text")}) AS qw, list_distinct({WORDS.format("d.text")}) AS dw
  FROM t20 JOIN documents d ON doc_id = child_id JOIN benchmark q ON item_id = query_id),
sc AS (SELECT *, r9 * 0.5::DOUBLE + coalesce(ss, 0) * 0.3::DOUBLE + len(list_intersect(qw, dw))::DOUBLE / greatest(len(qw), 1) * 0.2::DOUBLE AS s,
  regexp_matches(text, '\\|[^\\n]+\\|(\\n|$)') AND len(list_intersect(qw, {_list(fixed.DATA_WORDS)})) > 0 AS boost FROM tw),
rr AS (SELECT query_id, child_id, child_id // 5 AS parent_id, lang, text, round(CASE WHEN boost THEN s * 1.2::DOUBLE ELSE s END, 6) AS score FROM sc),
mx AS (SELECT query_id, max(score) AS m FROM rr GROUP BY 1),
rel AS (SELECT * FROM (SELECT rr.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM rr JOIN mx USING (query_id) WHERE m >= 0.2 AND score >= 0.6::DOUBLE * m) WHERE rank <= 5),
t5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM rr) WHERE rank <= 5),
par AS (SELECT doc_id // 5 AS parent_id, count(*) AS children, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY 1)"""
ORACLE_SQL["lightweight_rerank"] = f"WITH {_RERANKED} SELECT query_id, child_id, score, rank FROM t5"
ORACLE_SQL["relative_denoise"] = f"WITH {_RERANKED} SELECT query_id, child_id, score, rank FROM rel"
ORACLE_SQL["refusal_status"] = f"""
WITH {_RERANKED} SELECT item_id AS query_id, m AS max_score, CASE WHEN m IS NULL THEN 'no candidates' WHEN m < 0.3 THEN 'best score under threshold' END AS reason, (m IS NULL OR m < 0.3) AS refused
FROM benchmark LEFT JOIN mx ON query_id = item_id"""
ORACLE_SQL["parent_expansion"] = f"WITH {_RERANKED} SELECT query_id, child_id, t5.parent_id, rank, children, tokens FROM t5 LEFT JOIN par USING (parent_id)"
ORACLE_SQL["distinct_parents"] = f"""
WITH {_MATCHED} SELECT doc_id // 5 AS parent_id, count(*) AS children, sum(length(text) // 4)::BIGINT AS tokens FROM documents
WHERE doc_id // 5 IN (SELECT doc_id // 5 FROM m) GROUP BY 1"""
ORACLE_SQL["parent_with_children"] = """
SELECT o_orderkey, parts FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""
_PLANNED = f"""{_CHANNELS}, gq AS (SELECT item_id, {_any("lower(text)", fixed.GRAPH_HINTS)} AS g FROM benchmark),
gk AS (SELECT kin.* FROM kin JOIN gq ON item_id = query_id WHERE g),
fq AS (SELECT query_id, child_id, max(lr) AS lr, max(sr) AS sr, max(gr) AS gr, max(ss) AS ss FROM (
  SELECT query_id, child_id, rank AS lr, NULL AS sr, NULL AS gr, NULL AS ss FROM lex UNION ALL SELECT query_id, child_id, NULL, rank, NULL, score FROM sem
  UNION ALL SELECT query_id, child_id, NULL, NULL, rank, NULL FROM gk) GROUP BY 1, 2),
fw AS (SELECT fq.*, round(coalesce(0.7::DOUBLE / (60 + lr), 0) + coalesce(0.8::DOUBLE / (60 + sr), 0) + coalesce(CASE WHEN g THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / (60 + gr), 0), 9) AS r9
  FROM fq JOIN gq ON item_id = query_id),
t20 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r9 DESC, child_id) AS n FROM fw) WHERE n <= 20),
par AS (SELECT doc_id // 5 AS parent_id, string_agg(text, chr(10) ORDER BY doc_id) AS text, count(*) AS children, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY 1),
tw AS (SELECT t20.*, par.parent_id, par.text, children, tokens, list_distinct({WORDS.format("q.text")}) AS qw, list_distinct({WORDS.format("par.text")}) AS dw
  FROM t20 JOIN par ON child_id // 5 = par.parent_id JOIN benchmark q ON item_id = query_id),
sc AS (SELECT *, r9 * 0.5::DOUBLE + coalesce(ss, 0) * 0.3::DOUBLE + len(list_intersect(qw, dw))::DOUBLE / greatest(len(qw), 1) * 0.2::DOUBLE AS s,
  regexp_matches(text, '\\|[^\\n]+\\|(\\n|$)') AND len(list_intersect(qw, {_list(fixed.DATA_WORDS)})) > 0 AS boost FROM tw),
rr AS (SELECT *, round(CASE WHEN boost THEN s * 1.2::DOUBLE ELSE s END, 6) AS score FROM sc),
mx AS (SELECT query_id, max(score) AS m FROM rr GROUP BY 1),
rel AS (SELECT * FROM (SELECT rr.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, child_id) AS rank FROM rr JOIN mx USING (query_id) WHERE m >= 0.2 AND score >= 0.6::DOUBLE * m) WHERE rank <= 5)"""
ORACLE_SQL["hybrid_retrieve"] = f"""
WITH {_PLANNED} SELECT query_id, child_id, parent_id, rank, score, lr AS lexical_rank, sr AS semantic_rank, gr AS graph_rank, children, tokens FROM rel"""
ORACLE_SQL["retrieval_status"] = f"""
WITH {_PLANNED} SELECT item_id AS query_id, m AS max_score, CASE WHEN m IS NULL THEN 'no candidates' WHEN m < 0.2 THEN 'best score under threshold' END AS reason, (m IS NULL OR m < 0.2) AS refused
FROM benchmark LEFT JOIN mx ON query_id = item_id"""


def _hashed(key: str, name: str) -> str:
    return f"""(WITH t AS (SELECT {key} AS id, md5(unnest({TERMS.format("text")})) AS h FROM {name}),
v AS (SELECT id, ('0x' || left(h, 8))::BIGINT % 64 AS dim, sum(1 - 2 * (('0x' || substr(h, 9, 1))::BIGINT % 2))::DOUBLE AS x FROM t GROUP BY 1, 2)
, f AS (SELECT id, dim, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS x FROM v)
SELECT id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM f)"""


ORACLE_SQL["embedded_topk"] = f"""
WITH q AS {_hashed("item_id", "benchmark")}, v AS {_hashed("doc_id", "documents")},
s AS (SELECT q.id AS query_id, v.id AS child_id, round(sum(q.x * v.x), 5) AS similarity FROM q JOIN v USING (dim) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, child_id) AS rank FROM s)
SELECT query_id, child_id, similarity, rank FROM r WHERE rank <= 5"""
ORACLE_SQL["scored_candidates"] = f"""
WITH {_BM25}, cq AS (SELECT br.query_id, child_id, list_distinct({WORDS.format("q.text")}) AS qw, list_distinct({WORDS.format("d.text")}) AS dw
  FROM br JOIN documents d ON doc_id = child_id JOIN benchmark q ON item_id = query_id WHERE rank <= 10)
SELECT query_id, child_id, round(len(list_intersect(qw, dw))::DOUBLE / greatest(len(qw), 1), 6) AS rerank_score FROM cq"""
ORACLE_SQL["retrieval_context"] = f"""
WITH {_RERANKED}, x AS (SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS c FROM rel GROUP BY 1)
SELECT query_id, md5(c) AS context_md5, length(c) AS chars FROM x"""
ORACLE_SQL["ndcg_mrr_recall"] = f"""
WITH u AS {UNIT.format("embedding::DOUBLE[]")}, p AS (SELECT q.vec_id AS query_id, v.vec_id AS child_id, q.label = v.label AS hit,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, v.e) DESC, v.vec_id) AS rank FROM u q, u v WHERE q.vec_id % 50 = 0),
n AS (SELECT query_id, count(*) FILTER (hit) AS n FROM p GROUP BY 1), t AS (SELECT * FROM p WHERE rank <= 10)
SELECT query_id, round(sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, least(any_value(n), 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg,
  round(coalesce(1 / min(rank) FILTER (hit), 0), 6) AS mrr, round(count(*) FILTER (hit) / 10, 6) AS precision, round(count(*) FILTER (hit) / any_value(n), 6) AS recall
FROM t JOIN n USING (query_id) GROUP BY 1"""

_WINDOW_END = """CASE WHEN {at} + 1000 >= length(text) THEN length(text) ELSE coalesce(nullif(length(regexp_extract(substr(text, {at} + 801, 200), '(?s)^.*[.!?][ \\t\\n\\r\\f\\v]+')), 0) + 800, 1000) + {at} END"""
ORACLE_SQL["chunk_windows"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS b, {_WINDOW_END.format(at="0")} AS e FROM documents WHERE length(text) > 1000
  UNION ALL SELECT doc_id, text, e - 200, {_WINDOW_END.format(at="(e - 200)")} FROM w WHERE e < length(text)),
c AS (SELECT doc_id, b, regexp_replace(substr(text, b + 1, e - b), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') AS t FROM w),
k AS (SELECT doc_id, b, t FROM c WHERE length(t) >= 100 UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) BETWEEN 1 AND 1000)
SELECT doc_id AS document_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::INT AS chunk_index, {CONTENT_HASH.format("t")} AS content_hash FROM k"""

ORACLE_SQL["category_counts"] = "SELECT source, count(*) AS n FROM documents GROUP BY 1"
ORACLE_SQL["facts_by_type"] = """
SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'objection' WHEN '2-HIGH' THEN 'pain_point' WHEN '3-MEDIUM' THEN 'preference' ELSE 'other' END AS bucket,
  count(*) AS facts, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS contents FROM orders GROUP BY 1, 2"""
_HISTORY = f"(SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY started_at DESC, call_id DESC) AS rank FROM {CALLS})"
ORACLE_SQL["latest_per_key"] = f"SELECT customer_id, call_id, status FROM {_HISTORY} WHERE rank = 1"
ORACLE_SQL["call_history_topn"] = f"SELECT customer_id, call_id, rank FROM {_HISTORY} WHERE rank <= 3"
ORACLE_SQL["pending_tasks_join"] = "SELECT o_orderkey AS task_id, c_name AS name, o_orderpriority AS priority FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'"
ORACLE_SQL["overdue_tasks"] = "SELECT o_orderkey AS task_id, o_custkey AS customer_id FROM orders WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '2000-01-01'"
ORACLE_SQL["customers_by_fact"] = """
SELECT c_custkey AS customer_id, c_name AS name, count(*) AS facts FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority ILIKE '%urgent%' GROUP BY 1, 2"""
ORACLE_SQL["anti_join_unsummarised"] = "SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
ORACLE_SQL["enroll_leads_anti"] = """
SELECT c_custkey AS customer_id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""
ORACLE_SQL["next_leads_semi"] = """
SELECT c_custkey AS customer_id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')"""
ORACLE_SQL["calls_page_with_total"] = f"""
SELECT call_id, customer_id, count(*) OVER () AS total FROM {CALLS} WHERE status = 'completed' AND started_at >= TIMESTAMP '1998-01-01' ORDER BY started_at DESC, call_id DESC LIMIT 50 OFFSET 100"""
ORACLE_SQL["keyset_page"] = """
WITH m AS (SELECT event_id, event_type, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10', 0) ORDER BY ts, event_id LIMIT 51)
SELECT event_id, event_type, (SELECT count(*) > 50 FROM m) AS has_more FROM m ORDER BY ts, event_id LIMIT 50"""
ORACLE_SQL["kpi_dashboard"] = f"""
WITH k AS (SELECT direction, count(*) FILTER (started_at >= n - INTERVAL 90 DAY AND started_at <= n) AS calls,
  count(*) FILTER (started_at >= n - INTERVAL 180 DAY AND started_at < n - INTERVAL 90 DAY) AS previous_calls,
  round(avg(duration) FILTER (started_at >= n - INTERVAL 90 DAY AND started_at <= n), 4) AS avg_duration,
  count(*) FILTER (status IN ('queued', 'ringing', 'in_progress')) AS active_calls FROM (SELECT *, TIMESTAMP '2001-08-01' AS n FROM {CALLS}) GROUP BY 1),
c AS (SELECT *, CASE WHEN previous_calls > 0 THEN round((calls - previous_calls)::DOUBLE / previous_calls * 100, 6) ELSE 0 END::DOUBLE AS change FROM k)
SELECT *, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' ELSE 'stable' END AS trend FROM c"""
_AGENTS = f"(SELECT c_nationkey AS agent_id, count(*) AS calls, count(*) FILTER (status = 'completed') AS completed, avg(duration) AS avg_duration FROM {CALLS} JOIN customer ON c_custkey = customer_id GROUP BY 1)"
ORACLE_SQL["agent_performance"] = f"SELECT n_name, calls, completed, round(avg_duration, 4) AS avg_duration FROM {_AGENTS} JOIN nation ON agent_id = n_nationkey"
ORACLE_SQL["agent_totals"] = f"""
SELECT sum(calls)::BIGINT AS calls, sum(completed)::BIGINT AS completed, round(avg(avg_duration), 4) AS avg_duration, round(sum(avg_duration * calls) / sum(calls), 4) AS weighted_duration FROM {_AGENTS}"""
ORACLE_SQL["calls_report"] = f"""
SELECT count(*) AS total, count(*) FILTER (direction = 'inbound') AS inbound, count(*) FILTER (direction = 'outbound') AS outbound,
  count(*) FILTER (status = 'completed') AS answered, count(*) FILTER (status IN ('no_answer', 'busy', 'failed')) AS missed, round(avg(duration), 4) AS avg_duration FROM {CALLS}"""
ORACLE_SQL["status_breakdown"] = f"SELECT status, count(*) AS n FROM {CALLS} GROUP BY 1"
ORACLE_SQL["availability_slots"] = """
WITH u AS (SELECT DISTINCT user_id FROM events), h AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:00:00', INTERVAL 1 HOUR)) AS s),
b AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
t AS (SELECT DISTINCT u.user_id, s FROM b u, (SELECT 0 AS k UNION ALL SELECT 1) x, LATERAL (SELECT date_trunc('hour', u.ts) + k * INTERVAL 1 HOUR AS s) y
  WHERE s < u.ts + INTERVAL 30 MINUTE AND s + INTERVAL 1 HOUR > u.ts)
SELECT u.user_id, count(*) AS free FROM u, h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = u.user_id AND t.s = h.s) GROUP BY 1"""
ORACLE_SQL["schedule_gate"] = "SELECT event_id FROM events WHERE dayofweek(ts) BETWEEN 1 AND 5 AND strftime(ts, '%H:%M') BETWEEN '09:00' AND '18:00'"
ORACLE_SQL["tenant_scope"] = f"SELECT entity_id, count(*) AS mentions FROM {MENTIONS} WHERE entity_id IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_nationkey = 3) GROUP BY 1"
ORACLE_SQL["customer_prefetch"] = """
WITH f AS (SELECT o_custkey, least(count(*), 10) AS n FROM orders GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS r FROM orders WHERE o_orderstatus = 'P'),
g AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY r) AS tasks FROM t WHERE r <= 5 GROUP BY 1)
SELECT c_custkey AS customer_id, coalesce(f.n, 0)::INT AS facts, g.tasks FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN g ON g.o_custkey = c_custkey"""
ORACLE_SQL["routing_chain"] = """
SELECT s_suppkey, n_name, CASE WHEN r_regionkey = 1 THEN r_name END AS r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
ORACLE_SQL["upsert_customers"] = """
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_acctbal < 0 THEN -1 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer WHERE c_mktsegment <> 'FURNITURE'"""

ORACLE_SQL["graph_neighborhood"] = f"""
WITH e AS (SELECT src, dst FROM {RELATIONS} UNION SELECT dst, src FROM {RELATIONS}), st AS (SELECT 'N' || n_nationkey AS start FROM nation),
h1 AS (SELECT DISTINCT start, dst AS e1 FROM st JOIN e ON src = start), h2 AS (SELECT DISTINCT start, dst AS e2 FROM h1 JOIN e ON src = e1 WHERE dst <> start),
d AS (SELECT start, x, min(k) AS k FROM (SELECT start, e1 AS x, 1 AS k FROM h1 UNION ALL SELECT start, e2, 2 FROM h2) GROUP BY 1, 2),
c AS (SELECT start, child_id, min(k) AS k FROM d JOIN {MENTIONS} ON entity_id = x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY k, child_id) AS rank FROM c)
SELECT start, child_id, round(1 / (1 + k)::DOUBLE, 6) AS score, rank FROM r WHERE rank <= 50"""
_STARTS = "(SELECT 'S' || s_suppkey AS start FROM supplier WHERE s_suppkey % 50 = 0)"
ORACLE_SQL["graph_comention_neighborhood"] = f"""
WITH e AS (SELECT src, dst FROM {RELATIONS} UNION SELECT dst, src FROM {RELATIONS}),
h AS (SELECT start, dst AS x, 1 AS k FROM {_STARTS} JOIN e ON src = start),
t AS (SELECT start, e.dst AS x, 2 AS k FROM h JOIN e ON src = x UNION
  SELECT start, b.entity_id, 2 FROM {_STARTS} JOIN {MENTIONS} a ON a.entity_id = start JOIN {MENTIONS} b USING (child_id)),
d AS (SELECT start, x, min(k) AS k FROM (SELECT * FROM h UNION ALL SELECT * FROM t) WHERE x <> start GROUP BY 1, 2),
c AS (SELECT start, child_id, min(k) AS k FROM d JOIN {MENTIONS} ON entity_id = x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY k, child_id) AS rank FROM c)
SELECT start, child_id, round(1 / (1 + k)::DOUBLE, 6) AS score, rank FROM r WHERE rank <= 50"""
# one step of a walk keeps the least path to each node that no step before has reached
_STEP = "SELECT start, dst AS x, min(p || '>' || dst) AS p FROM {0} JOIN e ON src = x WHERE (start, dst) NOT IN ({1}) GROUP BY 1, 2"
_BACK = "SELECT start, dst AS x, min(dst || '>' || p) AS p FROM {0} JOIN e ON src = x WHERE (start, dst) NOT IN ({1}) GROUP BY 1, 2"
_SEEN = lambda *t: " UNION ALL ".join(f"SELECT start, x FROM {x}" for x in t)
_PATHS = f"""e AS (SELECT 'e:' || src AS src, 'e:' || dst AS dst FROM {RELATIONS} UNION SELECT 'e:' || dst, 'e:' || src FROM {RELATIONS}
  UNION SELECT 'e:' || entity_id, 'c:' || child_id FROM {MENTIONS} UNION SELECT 'c:' || child_id, 'e:' || entity_id FROM {MENTIONS}),
a0 AS (SELECT 'e:' || start AS start, 'e:' || start AS x, 'e:' || start AS p FROM {_STARTS}), a1 AS ({_STEP.format("a0", _SEEN("a0"))}), a2 AS ({_STEP.format("a1", _SEEN("a0", "a1"))}),
b0 AS (SELECT 'e:N' || n_nationkey AS start, 'e:N' || n_nationkey AS x, 'e:N' || n_nationkey AS p FROM nation), b1 AS ({_BACK.format("b0", _SEEN("b0"))}), b2 AS ({_BACK.format("b1", _SEEN("b0", "b1"))}),
m AS ({" UNION ALL ".join(f"SELECT a.start AS src, b.start AS dst, {i + j} AS distance, a.p || substr(b.p, length(b.x) + 1) AS path FROM a{i} a JOIN b{j} b USING (x)" for i in range(3) for j in range(3) if i == 2 or j == 0)}),
w AS (SELECT src, dst, distance, string_split(path, '>') AS path, row_number() OVER (PARTITION BY src, dst ORDER BY distance, string_split(path, '>')) AS n FROM m)"""
ORACLE_SQL["graph_path_nodes"] = f"WITH {_PATHS} SELECT src, dst, distance::INT AS distance, array_to_string(path, '>') AS path FROM w WHERE n = 1"
ORACLE_SQL["graph_path_chunks"] = f"""
WITH {_PATHS} SELECT DISTINCT src, dst, child_id FROM (SELECT src, dst, unnest(path) AS node FROM w WHERE n = 1) JOIN {MENTIONS} ON 'e:' || entity_id = node"""
ORACLE_SQL["graph_lookup"] = f"SELECT entity_id, child_id FROM {ENTITIES} JOIN {MENTIONS} USING (entity_id) WHERE lower(name) LIKE '%supplier#00000001%' AND entity_type = 'SUPPLIER'"
ORACLE_SQL["graph_related"] = f"""
WITH f AS (SELECT entity_id AS f FROM {ENTITIES} WHERE contains(lower(name), lower((SELECT min(n_name) FROM nation)))),
b AS (SELECT src, dst, relation_type FROM {RELATIONS} UNION ALL SELECT dst, src, relation_type FROM {RELATIONS})
SELECT DISTINCT e.entity_id, e.name, relation_type FROM b JOIN f ON src = f JOIN {ENTITIES} e ON e.entity_id = dst"""
_NAMED = """k AS (SELECT p_brand AS query_id, string_split(min(p_name), ' ') AS ks FROM part GROUP BY 1), kd AS (SELECT query_id, list_distinct(ks) AS ks FROM k),
a AS (SELECT query_id, len(ks) AS n, unnest(ks) AS word FROM kd), w AS (SELECT p_partkey::VARCHAR AS entity_id, word FROM (SELECT DISTINCT word FROM a) JOIN part ON contains(lower(p_name), lower(word))),
mm AS (SELECT DISTINCT l_partkey::VARCHAR AS entity_id, l_orderkey AS child_id FROM lineitem)"""
ORACLE_SQL["graph_keyword_search"] = f"""
WITH {_NAMED}, c AS (SELECT query_id, child_id, count(DISTINCT entity_id) AS matches, any_value(n) AS n FROM a JOIN w USING (word) JOIN mm USING (entity_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, child_id) AS rank FROM c)
SELECT query_id, child_id, matches, round(matches / n, 6) AS score, rank FROM r WHERE rank <= 20"""
ORACLE_SQL["graph_shortest_path"] = """
SELECT 'N' || min(n_nationkey) AS src, 'N' || max(n_nationkey) AS dst, CASE WHEN min(n_nationkey) = max(n_nationkey) THEN 0 ELSE 2 END::INT AS distance FROM nation GROUP BY n_regionkey"""
ORACLE_SQL["graph_fallback_search"] = f"""
WITH {_NAMED}, l AS (SELECT query_id, word, greatest(20 // n, 1) AS lim FROM a),
f AS (SELECT query_id, entity_id, lim, row_number() OVER (PARTITION BY query_id, word ORDER BY entity_id) AS r FROM l JOIN w USING (word)),
s AS (SELECT DISTINCT query_id, entity_id FROM f WHERE r <= lim),
t AS (SELECT * FROM s UNION SELECT query_id, (entity_id::BIGINT + 1)::VARCHAR FROM s UNION SELECT query_id, (entity_id::BIGINT - 1)::VARCHAR FROM s),
c AS (SELECT query_id, child_id, count(DISTINCT entity_id) AS matches FROM t JOIN mm USING (entity_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, child_id) AS rank FROM c)
SELECT query_id, child_id, matches, rank FROM r WHERE rank <= 20"""

_BOUNDS = "(SELECT * FROM (VALUES ('1', 1.0), ('5', 5.0), ('10', 10.0), ('25', 25.0), ('50', 50.0), ('+Inf', 'infinity'::DOUBLE)) t(le, b))"
ORACLE_SQL["histogram_buckets"] = f"""
SELECT event_type, le, count(*) FILTER (value <= b) AS bucket, count(*) AS count, round(sum(value), 4) AS sum FROM events, {_BOUNDS} WHERE value IS NOT NULL GROUP BY 1, 2"""
ORACLE_SQL["histogram_quantile"] = f"""
WITH h AS (SELECT b, count(*) FILTER (value <= b) AS n, count(*) AS c FROM events, {_BOUNDS} WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT b, n, c, coalesce(lag(b) OVER (ORDER BY b), 0) AS b0, coalesce(lag(n) OVER (ORDER BY b), 0) AS n0 FROM h WHERE b < 'infinity'::DOUBLE)
SELECT round(coalesce(min(b0 + (b - b0) * (c * 0.95::DOUBLE - n0) / (n - n0)) FILTER (n >= c * 0.95::DOUBLE AND n > n0), max(b)), 6) AS quantile FROM p"""
ORACLE_SQL["timing_stats"] = """
SELECT event_type, count(value) AS count, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1"""
ORACLE_SQL["stage_share"] = """
WITH s AS (SELECT user_id, event_type, sum(value) AS t FROM events GROUP BY 1, 2), w AS (SELECT *, sum(t) OVER (PARTITION BY user_id) AS a FROM s)
SELECT user_id, event_type, round(CASE WHEN a <> 0 THEN t / a * 100 ELSE 0 END, 4) AS share FROM w"""
ORACLE_SQL["rate_5m"] = """
SELECT (epoch(ts)::BIGINT // 300 * 300)::BIGINT AS start_s, event_type, count(*) AS n, round(count(*) / 5, 6) AS per_minute
FROM (SELECT date_trunc('second', ts) AS ts, event_type FROM events) GROUP BY 1, 2"""
ORACLE_SQL["metrics_exposition"] = """SELECT 'events_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type"""
ORACLE_SQL["event_dedup"] = "SELECT DISTINCT user_id, event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour_s FROM events"
ORACLE_SQL["event_states"] = "SELECT user_id, arg_max(event_type, ts) AS state, count(*) AS events, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY 1"
ORACLE_SQL["final_status"] = "SELECT user_id, arg_max(event_type, ts) AS state, arg_max(event_type, ts) NOT IN ('click', 'view') AS final FROM events GROUP BY 1"
ORACLE_SQL["fanout_bounded"] = """
WITH s AS (SELECT user_id AS subscriber, CASE WHEN user_id % 50 = 0 THEN 'all' ELSE min(event_type) END AS channel FROM events GROUP BY user_id),
g AS (SELECT subscriber, event_id FROM s JOIN events ON channel = 'all' OR channel = event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY subscriber ORDER BY event_id) AS place FROM g)
SELECT subscriber, event_id, place FROM r WHERE place <= 100"""
ORACLE_SQL["event_sessions"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS events FROM s GROUP BY user_id, n"""
ORACLE_SQL["stream_kpis"] = "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
ORACLE_SQL["committed_customers"] = ORACLE_SQL["upsert_customers"]
ORACLE_SQL["ingest_status_commits"] = """
SELECT source, CASE WHEN coalesce(length(trim(text)), 0) > 0 THEN 'completed' ELSE 'failed' END AS status, count(*) AS n FROM documents GROUP BY 1, 2"""
