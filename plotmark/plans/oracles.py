"""For each query, SQL over the given tables with the same result."""

from __future__ import annotations

from plotmark.operators.lexical import KINDS, STOP_WORDS
from plotmark.operators.status import RETRYABLE
from plotmark.plans.base_sql import CHUNKS, CONVERSATIONS, DOCS, EMBEDDED, INGEST, JOBS, LATER, SEGMENTS, SPACES, UPLOADS, chunk_sql

_DOTS = "'[0-9]+\\.[0-9]+|[\\p{L}\\p{N}]+'"
_QUERIES = "q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, 'src' || (item_id % 20) AS address_id, array_to_string(string_split(text, ' ')[1:{n}], ' ') AS query_text, 8 AS k FROM benchmark)"
_IN_FLIGHT = "('pending', 'extracting', 'chunking', 'embedding')"
_VECTORS = "e AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'addr-' || label AS address_id, embedding, vec_id, label FROM embeddings)"
_NEAR = f"""{_VECTORS},
near AS (SELECT 'q' || q.chunk_id AS query_id, e.chunk_id, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance FROM e q JOIN e USING (label) WHERE q.vec_id % 50 = 0),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS INT) AS vector_rank FROM near QUALIFY vector_rank <= 12)"""
_MODELS = """names AS (SELECT ['hash:feature-', 'openai:text-embedding-3-large', 'gemini:gemini-embedding-001', 'selfhosted:bge-', 'openai:text-embedding-', 'other:x-', 'hash'] AS listed),
m AS (SELECT listed[p_partkey % 7 + 1] || CASE WHEN listed[p_partkey % 7 + 1] LIKE '%-' THEN CAST(p_size AS VARCHAR) ELSE '' END AS model_id, p_partkey AS id FROM part, names)"""
_PARSED = f"""{_MODELS},
pm AS (SELECT DISTINCT model_id, split_part(model_id, ':', 1) AS provider, CASE WHEN contains(model_id, ':') THEN substr(model_id, strpos(model_id, ':') + 1) ELSE '' END AS name FROM m),
pd AS (SELECT model_id, provider, name, CAST(CASE provider WHEN 'hash' THEN CASE WHEN contains(name, '-') THEN TRY_CAST(regexp_extract(name, '([^-]*)$', 1) AS INT) ELSE 256 END
  WHEN 'openai' THEN CASE name WHEN 'text-embedding-3-large' THEN 3072 ELSE 1536 END WHEN 'gemini' THEN 1536 WHEN 'selfhosted' THEN 1024 END AS INT) AS dim,
  CASE WHEN provider NOT IN ('hash', 'openai', 'gemini', 'selfhosted', 'hf') THEN 'unknown provider' END AS error FROM pm)"""
#: Query vectors ``qv`` (query_id, idx, value), from the same hash as chunks'.
_ASKED = """qw AS (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS token FROM q),
qn AS (SELECT query_id, token, count(*) AS n FROM qw GROUP BY ALL),
qc AS (SELECT query_id, CAST(CAST('0x' || substr(md5('idx' || token), 1, 8) AS BIGINT) % 64 AS INT) AS idx, sum(CASE WHEN CAST('0x' || substr(md5('sgn' || token), 1, 8) AS BIGINT) % 2 = 1 THEN n ELSE -n END) AS n FROM qn GROUP BY ALL),
qv AS (SELECT query_id, idx, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS value FROM qc WHERE n <> 0),
f AS (SELECT chunk_id, idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM emb),
qd AS (SELECT query_id, sqrt(sum(value * value)) AS norm FROM qv GROUP BY query_id), fd AS (SELECT chunk_id, sqrt(sum(value * value)) AS norm FROM f GROUP BY chunk_id),
dots AS (SELECT q.query_id, k.chunk_id, coalesce(sum(qv.value * f.value), 0) AS dot FROM q JOIN k USING (address_id) LEFT JOIN qv ON qv.query_id = q.query_id LEFT JOIN f ON f.chunk_id = k.chunk_id AND f.idx = qv.idx GROUP BY ALL),
vdist AS (SELECT query_id, chunk_id, CASE WHEN qd.norm IS NULL OR fd.norm IS NULL THEN CAST('nan' AS DOUBLE) ELSE round(1 - dot / (qd.norm * fd.norm), 9) END AS distance FROM dots LEFT JOIN qd USING (query_id) LEFT JOIN fd USING (chunk_id)),
vtop AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS place FROM vdist QUALIFY place <= 32)"""
_TOKENS = f"""kt AS (SELECT chunk_id, address_id, unnest(ws) AS lexeme, unnest(range(1, len(ws) + 1)) AS at_word FROM (SELECT chunk_id, address_id, regexp_extract_all(lower(text), {_DOTS}) AS ws FROM k)),
ql AS (SELECT DISTINCT query_id, address_id, unnest(regexp_extract_all(lower(query_text), {_DOTS})) AS lexeme FROM q),
qneed AS (SELECT query_id, count(*) AS needed FROM ql GROUP BY query_id),
hit AS (SELECT ql.query_id, kt.chunk_id, ql.lexeme, kt.at_word FROM ql JOIN kt USING (address_id, lexeme)),
mt AS (SELECT query_id, chunk_id, needed, count(*) AS hits FROM hit JOIN qneed USING (query_id) GROUP BY ALL HAVING count(DISTINCT lexeme) = needed)"""
#: Cover density for up to two lexemes: each nearest pair of unlike neighbours is a shortest interval.
_COVERS = """seq AS (SELECT h.*, lead(lexeme) OVER w AS next_lexeme, lead(at_word) OVER w AS next_at FROM hit h JOIN mt USING (query_id, chunk_id) WINDOW w AS (PARTITION BY query_id, chunk_id ORDER BY at_word)),
trank AS (SELECT mt.query_id, mt.chunk_id, round(CASE WHEN needed = 1 THEN mt.hits * CAST(0.1 AS DOUBLE) ELSE c.covers END, 9) AS text_rank FROM mt
  LEFT JOIN (SELECT query_id, chunk_id, sum(CAST(0.1 AS DOUBLE) / (next_at - at_word)) AS covers FROM seq WHERE next_lexeme <> lexeme GROUP BY ALL) c USING (query_id, chunk_id)),
ttop AS (SELECT query_id, chunk_id, text_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY text_rank DESC, chunk_id) AS INT) AS rank FROM trank QUALIFY rank <= 32)"""
#: Cover density for any number of lexemes: where each was met last, for every hit; an interval ends at the first hit of each least.
_MANY_COVERS = """placed AS (SELECT h.*, needed, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY at_word) AS i FROM hit h JOIN mt USING (query_id, chunk_id)),
lasts AS (SELECT n.query_id, n.chunk_id, n.i, n.needed, max(CASE WHEN n.lexeme = l.lexeme THEN n.i END) OVER (PARTITION BY n.query_id, n.chunk_id, l.lexeme ORDER BY n.i) AS met FROM placed n JOIN ql l USING (query_id)),
starts AS (SELECT query_id, chunk_id, i, min(met) AS start FROM lasts GROUP BY ALL HAVING count(met) = any_value(needed)),
spans AS (SELECT query_id, chunk_id, start, min(i) AS i FROM starts GROUP BY ALL),
trank AS (SELECT query_id, chunk_id, round(sum(CAST(0.1 AS DOUBLE) / (1 + greatest(b.at_word - a.at_word - (s.i - s.start), 0))), 9) AS text_rank
  FROM spans s JOIN placed a USING (query_id, chunk_id) JOIN placed b USING (query_id, chunk_id) WHERE a.i = s.start AND b.i = s.i GROUP BY ALL),
ttop AS (SELECT query_id, chunk_id, text_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY text_rank DESC, chunk_id) AS INT) AS rank FROM trank QUALIFY rank <= 32)"""
_FUSED = """fused AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.chunk_id, t.chunk_id) AS chunk_id, coalesce(1.0 / (v.place + 60), 0) + coalesce(1.0 / (t.rank + 60), 0) AS score FROM vtop v FULL JOIN ttop t ON v.query_id = t.query_id AND v.chunk_id = t.chunk_id),
found AS (SELECT f.query_id, k.address_id, k.document_id, k.ordinal, k.page_number, f.chunk_id, f.score, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY round(f.score, 12) DESC, k.document_id, k.ordinal, f.chunk_id) AS INT) AS rank FROM fused f JOIN k USING (chunk_id) QUALIFY rank <= 8)"""
_HYBRID = f"{CHUNKS},\n{EMBEDDED},\n{_QUERIES.format(n=2)},\n{_ASKED},\n{_TOKENS},\n{_COVERS},\n{_FUSED}"
_STATUS = "SELECT task_id, address_id, document_id, model_id, job_type, state, chunk_count, embedding_count, tokens_embedded, cost_usd, attempts, failed_step, error_type, lease_until, created_at, finished_at FROM jobs"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_RETRY = ", ".join(f"'{w}'" for w in RETRYABLE)

_LEASES = f"WITH {JOBS} SELECT task_id, address_id, state, event_ts AS since FROM lastev WHERE state IN {_IN_FLIGHT} AND (SELECT max(ts) FROM events) > event_ts + INTERVAL 3600 SECOND"

ORACLES: dict[str, str] = {
    "content_hash": f"WITH {UPLOADS} SELECT address_id, upload_id, 'text/plain' AS content_type, address_id AS display_name, sha256(body) AS content_hash FROM u WHERE length(body) > 0",
    "address_upsert": "SELECT DISTINCT source AS address_id, CASE WHEN length(source) = 4 THEN 'Known ' || source ELSE source END AS display_name FROM documents",
    "upload_gate": f"WITH {LATER} SELECT document_id, address_id, upload_id, content_hash, doc_version, state FROM g",
    "document_versions": f"""WITH {LATER}, p AS (SELECT * FROM g WHERE state = 'pending' QUALIFY row_number() OVER (PARTITION BY address_id, upload_id ORDER BY doc_version DESC, upload_ts DESC) = 1)
SELECT coalesce(d.document_id, p.document_id) AS document_id, coalesce(d.address_id, p.address_id) AS address_id, coalesce(d.upload_id, p.upload_id) AS upload_id, coalesce(p.content_hash, d.content_hash) AS content_hash,
  'store/address=' || coalesce(d.address_id, p.address_id) || '/doc=' || coalesce(d.upload_id, p.upload_id) || '/original' AS storage_ref, coalesce(p.filename, d.filename) AS original_name, CASE WHEN d.document_id IS NULL THEN 0 ELSE 1 END AS live_version
FROM d FULL JOIN p ON d.document_id = p.document_id""",
    "ingest_job": f"""WITH {INGEST} SELECT address_id, upload_id, doc_version, CASE WHEN state = 'skipped' THEN 'skipped' WHEN pdf THEN 'failed' ELSE 'done' END AS state,
      CASE WHEN state = 'pending' AND NOT pdf THEN windows END AS chunk_count, CASE WHEN state = 'pending' AND NOT pdf THEN windows ELSE 0 END AS embedding_delta,
      CASE WHEN state = 'pending' AND pdf THEN 'extract' END AS failed_step, upload_ts AS ts FROM ingested""",
    "accepted_uploads": f"WITH {LATER} SELECT document_id, address_id, upload_id, content_hash, doc_version, state, 'hash:feature-64' AS model_id FROM g",
    "paragraphs": f"WITH {SEGMENTS} SELECT document_id, page_number, CAST(paragraph_index AS INT) AS paragraph_index, text FROM seg",
    "page_markers": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, CASE WHEN i = 0 THEN 1 ELSE 3 END AS page_number, 0 AS paragraph_index, trim(line, {SPACES}) AS text FROM l WHERE trim(line, {SPACES}) <> ''
UNION ALL SELECT doc_id, 9, i, ['tail one', 'tail two'][i + 1] FROM documents, (VALUES (0), (1)) t(i)""",
    "table_text": """WITH o AS (SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag || ' | ' || l_linestatus || ' x | ' || CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) ELSE '' END, chr(10) ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN n >= 2 THEN text ELSE '' END AS text FROM o""",
    "layout_exclude": """SELECT l_orderkey % 200 AS page_id, l_orderkey, l_linenumber, l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p_partkey % 2 = 0 AND p_partkey % 200 = l.l_orderkey % 200
  AND l.l_quantity * 10 + 10 BETWEEN p_size * 8 AND p_size * 8 + 60 AND l.l_linenumber * 6 + 5 BETWEEN p_partkey % 37 AND p_partkey % 37 + 30)""",
    "page_assembly": f"""WITH parts AS (SELECT conv_id, turn, 0 AS kind, i, trim(ls[i], {SPACES}) AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))
  UNION ALL SELECT conv_id, turn, 1, 0, role || ' | a' || chr(10) || turn || ' | b c' FROM conversations)
SELECT conv_id AS document_id, CAST(turn + 1 AS INT) AS page_number, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY kind, i) - 1 AS INT) AS paragraph_index, text FROM parts WHERE text <> ''""",
    "coverage": """SELECT 'conv-' || conv_id AS document_id, sum(length(text)) AS chars, sum(length(text)) / ((max(turn) // 4 + 1) * 12.0) < 100 AS sparse FROM conversations GROUP BY conv_id""",
    "choose_extraction": f"""WITH {SEGMENTS}, t AS (SELECT document_id, doc_id, count(*) AS n, sum(length(text)) AS chars, sum(CASE WHEN paragraph_index = 0 THEN length(text) END) AS first_chars FROM seg GROUP BY ALL),
c AS (SELECT *, greatest(doc_id % 30, 1) AS pages, doc_id % 2 = 0 AS pdf, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS np, CASE WHEN doc_id % 6 >= 2 THEN n ELSE 0 END AS no, CASE WHEN doc_id % 6 >= 4 THEN n ELSE 0 END AS nl FROM t),
m AS (SELECT *, CASE WHEN NOT pdf OR (np > 0 AND first_chars / (pages + 0.0) >= 100) THEN 'primary' WHEN no > 0 AND chars / (pages + 0.0) >= 50 THEN 'ocr' WHEN nl > 0 THEN 'llm' WHEN no > 0 THEN 'ocr' ELSE 'primary' END AS method FROM c)
SELECT document_id, method, CAST(CASE method WHEN 'primary' THEN np WHEN 'ocr' THEN no ELSE nl END AS INT) AS n FROM m""",
    "chunk_windows": f"WITH {CHUNKS} SELECT chunk_id, document_id, address_id, ordinal, page_number, paragraph_index, char_start, char_end, text, token_count FROM k",
    "chunk_provenance": f"WITH {CONVERSATIONS}, {chunk_sql('cv', 50, 10)} SELECT document_id, ordinal, char_start, char_end, page_number, paragraph_index, token_count FROM k",
    "provenance_rows": f"""WITH {CONVERSATIONS}, {chunk_sql('cv', 50, 10)} SELECT c.document_id, c.ordinal, c.char_end - 1 AS position, o.page_number, CAST(o.paragraph_index AS INT) AS paragraph_index
  FROM k0 c ASOF JOIN ord o ON c.document_id = o.document_id AND c.char_end - 1 >= o.seg_start""",
    "version_chunks": f"WITH {CHUNKS} SELECT document_id, ordinal, 'new ' || text AS text FROM k WHERE document_id < '4' AND ordinal < 2",
    "hash_embedding_md5": f"WITH {CHUNKS}, {EMBEDDED} SELECT chunk_id, idx, round(value, 6) AS value FROM emb",
    "model_parse": f"WITH {_PARSED} SELECT * FROM pd",
    "embedding_cost": f"""SELECT doc_id, ['openai:text-embedding-3-small', 'openai:text-embedding-3-large', 'gemini:text-embedding-004', 'hash:feature-64'][doc_id % 4 + 1] AS model_id, n * 1000 AS tokens,
  CAST(n * 1000 / 1000000 * [0.02, 0.13, 0.025, 0.0][doc_id % 4 + 1] AS DECIMAL(12,6)) AS cost_usd FROM (SELECT doc_id, len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '')) AS n FROM documents)""",
    "embedding_upsert": """SELECT CAST(vec_id AS VARCHAR) AS chunk_id, CASE WHEN vec_id % 2 = 0 THEN 'new' ELSE 'old' END AS model_id, 'update' AS how FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0
UNION ALL SELECT CAST(vec_id AS VARCHAR), CASE WHEN vec_id % 3 <> 0 THEN 'old' ELSE 'new' END, 'nothing' FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 <> 0""",
    "model_registry": f"WITH {_PARSED} SELECT model_id, CASE WHEN dim = 3072 THEN 9 ELSE dim END AS dim, CASE WHEN dim = 3072 THEN 'kept' ELSE 'embedding_' || trim(regexp_replace(lower(model_id), '[^a-z0-9]+', '_', 'g'), '_') END AS table_name FROM pd WHERE dim IS NOT NULL",
    "dataset_names": f"WITH {_MODELS} SELECT id, 'embedding_' || trim(regexp_replace(lower(model_id), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM m",
    "storage_refs": "SELECT page_id, 'store/address=' || regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') || '/doc=é_a_' || page_id || '/original' AS ref FROM pages",
    "vector_topk": f"WITH {_NEAR} SELECT query_id, chunk_id, distance, vector_rank FROM top",
    "live_chunks": f"WITH {CHUNKS} SELECT chunk_id FROM k WHERE document_id < '8'",
    "vector_search": f"""WITH {CHUNKS}, {EMBEDDED}, {_QUERIES.format(n=2)}, {_ASKED},
ranked AS (SELECT v.query_id, k.address_id, 1.0 / (v.place + 60) AS score, v.chunk_id, k.document_id, CAST(row_number() OVER (PARTITION BY v.query_id ORDER BY round(1.0 / (v.place + 60), 12) DESC, k.document_id, k.ordinal) AS INT) AS rank FROM vtop v JOIN k USING (chunk_id) QUALIFY rank <= 8)
SELECT r.query_id, r.address_id, r.rank, round(r.score, 6) AS score, r.chunk_id, d.filename AS original_name FROM ranked r JOIN d USING (document_id)""",
    "lexemes": f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), {_DOTS}) AS ws FROM documents), t AS (SELECT doc_id, unnest(ws) AS lexeme, unnest(range(1, len(ws) + 1)) AS i FROM w)
SELECT doc_id, lexeme, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM t WHERE lexeme NOT IN ({_STOPS}) GROUP BY ALL""",
    "lexeme_kinds": f"""WITH t AS (SELECT 'd' || doc_id AS id, text || ' well-known long-term-3 -12.5 +7 3e-4 1.2.3 3rd doc-' || doc_id AS text FROM documents
  UNION ALL SELECT 'p' || page_id, 'See ' || url || '. Or ask me@' || regexp_extract(url, '//([^/]+)', 1) || '!' FROM pages),
w AS (SELECT id, list_transform(regexp_extract_all(lower(text), '{KINDS}'), lambda x: [x, regexp_replace(x, '^[a-z]+://', '')]) AS ws FROM t),
p AS (SELECT id, flatten(list_transform(ws, lambda x: CASE WHEN contains(x[1], '@') THEN [x[1]] WHEN contains(x[2], '/') THEN [x[2], split_part(x[2], '/', 1), x[2][strpos(x[2], '/'):]]
  WHEN regexp_matches(x[1], '^\\p{{L}}') AND contains(x[1], '-') AND NOT contains(x[1], '.') THEN list_prepend(x[1], string_split(x[1], '-')) ELSE [x[2]] END)) AS ws FROM w),
u AS (SELECT id, unnest(ws) AS lexeme, unnest(range(1, len(ws) + 1)) AS i FROM p)
SELECT id, lexeme, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS positions FROM u WHERE lexeme NOT IN ({_STOPS}) GROUP BY ALL""",
    "text_match": f"WITH {CHUNKS}, {_QUERIES.format(n=2)}, {_TOKENS} SELECT query_id, chunk_id, needed, CAST(hits AS INT) AS hits FROM mt",
    "text_topk": f"WITH {CHUNKS}, {_QUERIES.format(n=1)}, {_TOKENS}, {_COVERS} SELECT query_id, chunk_id, text_rank, rank FROM ttop",
    "text_topk_three": f"WITH {CHUNKS}, {_QUERIES.format(n=3)}, {_TOKENS}, {_MANY_COVERS} SELECT query_id, chunk_id, text_rank, rank FROM ttop",
    "rrf": f"""WITH {_NEAR}, t AS (SELECT query_id, CASE WHEN vector_rank % 2 = 0 THEN chunk_id ELSE 't' || chunk_id END AS chunk_id, 13 - vector_rank AS rank FROM top)
SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM (SELECT query_id, chunk_id, CAST(1 AS DOUBLE) / (vector_rank + 60) AS s FROM top UNION ALL SELECT query_id, chunk_id, CAST(1 AS DOUBLE) / (rank + 60) FROM t) GROUP BY ALL""",
    "hybrid_search": f"WITH {_HYBRID} SELECT query_id, f.address_id, 'hash:feature-64' AS model_id, rank, round(score, 6) AS score, chunk_id, filename AS original_name, page_number, ordinal FROM found f JOIN d USING (document_id)",
    "examined": f"WITH {CHUNKS}, {_QUERIES.format(n=2)} SELECT query_id, CAST((SELECT count(*) FROM k WHERE k.address_id = q.address_id AND ordinal < 3) AS INT) AS candidates_examined FROM q",
    "query_job": f"""WITH {_HYBRID} SELECT q.query_id, CASE WHEN CAST(q.query_id AS INT) % 5 = 0 THEN 'nowhere' ELSE q.address_id END AS address_id, 'hash:feature-64' AS model_id,
  CASE WHEN CAST(q.query_id AS INT) % 5 = 0 THEN 0 ELSE CAST((SELECT count(*) FROM k WHERE k.address_id = q.address_id) AS INT) END AS candidates_examined,
  CASE WHEN CAST(q.query_id AS INT) % 5 = 0 THEN 0 ELSE CAST((SELECT count(*) FROM found f WHERE f.query_id = q.query_id) AS INT) END AS chunks_returned FROM q WHERE CAST(q.query_id AS INT) % 7 <> 0""",
    "publish": f"WITH {CHUNKS} SELECT CASE WHEN document_id < '8' THEN chunk_id || '-2' ELSE chunk_id END AS chunk_id, document_id, CASE WHEN document_id < '8' THEN 2 ELSE 1 END AS doc_version, CASE WHEN document_id < '8' THEN 2 ELSE 1 END AS live_version FROM k",
    "remove_cascade": f"""WITH {CHUNKS}, x AS (SELECT DISTINCT d.document_id, address_id, upload_id FROM d JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT chunk_id AS id, 'chunk' AS kind, CAST(NULL AS BOOLEAN) AS deleted, CAST(NULL AS VARCHAR) AS storage_ref FROM k WHERE document_id NOT IN (SELECT document_id FROM x)
UNION ALL SELECT document_id, 'document', true, 'store/address=' || address_id || '/doc=' || upload_id || '/original' FROM x UNION ALL SELECT document_id || '?', 'document', false, NULL FROM x""",
    "missing_embeddings": f"WITH {CHUNKS} SELECT chunk_id, address_id FROM k WHERE ordinal % 3 <> 0",
    "rebuild": f"WITH {CHUNKS} SELECT chunk_id, 'hash:feature-128' AS model_id, 128 AS dim, false AS active FROM k UNION ALL SELECT chunk_id, 'hash:feature-64', CASE WHEN chunk_id < '8' THEN -1 ELSE 64 END, true FROM k",
    "config_upsert": """WITH o AS (SELECT 'key-' || o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS value, CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey) AS t FROM orders) SELECT key, arg_max(value, t) AS value FROM o GROUP BY key""",
    "rebuild_active": f"WITH {JOBS} SELECT count(*) > 0 AS active FROM jobs WHERE job_type = 'rebuild' AND state IN {_IN_FLIGHT}",
    "job_status": f"WITH {JOBS} {_STATUS}",
    "failure_outcome": f"""WITH {JOBS} SELECT task_id, seq, error_type, substr(error_message, 1, 2000) AS error_message, attempts, error_type IN ({_RETRY}) AS retryable,
  CASE WHEN error_type IN ({_RETRY}) AND attempts < 5 THEN 'pending' ELSE 'failed' END AS state FROM ev WHERE state = 'failed'""",
    "missing_by_address": f"WITH {CHUNKS} SELECT address_id, count(*) AS missing FROM k WHERE ordinal % 3 <> 0 GROUP BY 1",
    "address_status": f"""WITH {JOBS}, {CHUNKS}, a AS (SELECT address_id FROM u UNION SELECT 'src' || (n_nationkey + 10) FROM nation),
s AS (SELECT address_id, (SELECT count(*) FROM d WHERE d.address_id = a.address_id) AS document_count, (SELECT count(*) FROM jobs j WHERE replace(j.address_id, 'addr-', 'src') = a.address_id AND state IN {_IN_FLIGHT}) AS in_flight,
  (SELECT count(*) FROM jobs j WHERE replace(j.address_id, 'addr-', 'src') = a.address_id AND state = 'failed') AS failed, (SELECT count(*) FROM k WHERE k.address_id = a.address_id AND ordinal % 3 <> 0) AS missing_embeddings FROM a)
SELECT *, document_count > 0 AS has_documents, in_flight = 0 AND failed = 0 AND missing_embeddings = 0 AS fully_indexed FROM s""",
    "address_jobs": f"""WITH {JOBS}, placed AS (SELECT address_id, CAST(row_number() OVER (PARTITION BY address_id ORDER BY created_at DESC, task_id) AS INT) AS place, task_id, state, created_at FROM jobs QUALIFY place <= 5)
SELECT p.*, (SELECT count(*) FROM jobs j WHERE j.address_id = p.address_id AND state = 'failed') AS failed FROM placed p""",
    "stuck_jobs": f"WITH {JOBS} SELECT task_id, state, lease_until FROM jobs WHERE state IN {_IN_FLIGHT} AND (lease_until IS NULL OR lease_until < TIMESTAMP '2024-01-31 17:00:00') AND created_at < TIMESTAMP '2024-01-31 16:50:00'",
    "query_metrics": """SELECT 'src' || (user_id % 20) AS address_id, 'm' || (event_id % 2) AS model_id, count(*) AS queries, round(avg(CAST(round(value * 10) AS INT)), 6) AS avg_latency_ms, quantile_disc(CAST(round(value * 10) AS INT), 0.95) AS p95_latency_ms,
  sum(event_id % 50) AS candidates_examined, sum(event_id % 9) AS chunks_returned, CAST(sum(event_id % 7) AS DECIMAL(12,6)) AS cost_usd FROM events GROUP BY 1, 2""",
    "ingest_cost": f"WITH {JOBS} SELECT address_id, model_id, sum(tokens_embedded) AS tokens_embedded, CAST(sum(cost_usd) AS DECIMAL(12,6)) AS cost_usd FROM jobs GROUP BY 1, 2",
    "audit_duplicates": f"""WITH {CHUNKS} SELECT 'document' AS table_name, address_id || '/' || upload_id AS key, 2 AS copies FROM d WHERE document_id < '1'
UNION ALL SELECT 'chunk', document_id || '/1/1', 2 FROM k WHERE ordinal = 1 UNION ALL SELECT 'embedding', chunk_id, 2 FROM k WHERE ordinal = 2""",
    "audit_orphans": f"""WITH {CHUNKS} SELECT 'chunk without document' AS rule, chunk_id AS key FROM k WHERE document_id < '1' AND ordinal <> 2 UNION ALL SELECT 'embedding without chunk', chunk_id FROM k WHERE ordinal = 2
UNION ALL SELECT 'document without address', document_id FROM d WHERE document_id >= '1' AND address_id = 'src3'""",
    "audit_address": f"""WITH {CHUNKS}, {_QUERIES.format(n=2)} SELECT 'chunk' AS rule, chunk_id AS key FROM k WHERE document_id < '1'
UNION ALL SELECT 'embedding', chunk_id FROM k WHERE ordinal = 1 AND (address_id <> 'src0' OR document_id < '1') UNION ALL SELECT 'result', query_id FROM q WHERE query_id < '1'""",
    "audit_domain": f"""WITH {JOBS}, {CHUNKS} SELECT 'unknown state' AS rule, task_id AS key FROM jobs WHERE length(task_id) = 2 UNION ALL SELECT 'wrong dimension', CAST(vec_id AS VARCHAR) FROM embeddings WHERE vec_id % 9 = 0
UNION ALL SELECT 'missing value', chunk_id FROM k WHERE ordinal = 4 UNION ALL SELECT 'gap in ordinals', document_id FROM k WHERE document_id < '8' GROUP BY document_id HAVING count(*) > 2""",
    "stream_gate": f"WITH {LATER} SELECT address_id, upload_id, content_hash, doc_version, state FROM g",
    "stream_status": f"WITH {JOBS} {_STATUS}",
    "stream_ingest": f"WITH {CHUNKS} SELECT chunk_id, document_id, address_id, ordinal, text, 1 AS live_version, 1 AS jobs FROM k",
    "publish_snapshot": f"""WITH {CHUNKS} SELECT seen, CASE seen WHEN 'after' THEN 2 ELSE 1 END AS version, CASE WHEN seen = 'after' AND document_id < '8' THEN chunk_id || '-2' ELSE chunk_id END AS chunk_id,
  CASE WHEN seen = 'after' AND document_id < '8' THEN 2 ELSE 1 END AS doc_version, CASE WHEN seen = 'after' AND document_id < '8' THEN 2 ELSE 1 END AS live_version FROM k, (VALUES ('before'), ('failed'), ('after')) t(seen)""",
    "table_roundtrip": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'addr-' || label AS address_id, 'hash:feature-64' AS model_id, CAST(len(embedding) AS INT) AS dim, round(CAST(CASE WHEN label = 3 THEN -embedding[1] ELSE embedding[1] END AS DOUBLE), 6) AS first FROM embeddings",
    "stream_lease": _LEASES,
    "lease_timeout": _LEASES,
}
