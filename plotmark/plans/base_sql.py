"""The fixtures in SQL, as common table expressions for the queries' oracles."""

SPACES = "' ' || chr(10) || chr(13) || chr(9)"



def key_sql(*parts: str) -> str:
    """The id of parts, as ``functions.text.key_id`` makes it."""
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({p} AS VARCHAR)) || ':' || CAST({p} AS VARCHAR), '-')" for p in parts) + ")"


UPLOADS = """u AS (SELECT source AS address_id, CAST(doc_id AS VARCHAR) AS upload_id, 'doc-' || doc_id || '.txt' AS filename, doc_id,
  replace(text, chr(10), chr(10) || chr(10)) AS body, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS upload_ts FROM documents)"""
DOCS = f"""{UPLOADS},
d AS (SELECT {key_sql('address_id', 'upload_id')} AS document_id, *, sha256(body) AS content_hash FROM u)"""
LATER = f"""{DOCS},
r AS (SELECT address_id, CASE WHEN doc_id % 10 = 2 THEN filename ELSE upload_id END AS upload_id, filename, doc_id, upload_ts,
    body || CASE WHEN doc_id % 10 = 0 THEN ' revised' ELSE '' END AS body FROM u
  UNION ALL SELECT address_id, CASE WHEN doc_id % 10 = 2 THEN filename ELSE upload_id END, filename, doc_id, upload_ts + INTERVAL 1 DAY,
    body || CASE WHEN doc_id % 20 = 0 THEN ' revised again' WHEN doc_id % 10 = 0 THEN ' revised' ELSE '' END FROM u),
h AS (SELECT r.*, sha256(r.body) AS content_hash, d.content_hash AS stored, CASE WHEN d.document_id IS NULL THEN 0 ELSE 1 END AS live
  FROM r LEFT JOIN d ON d.address_id = r.address_id AND d.upload_id = r.upload_id),
c AS (SELECT *, content_hash IS DISTINCT FROM coalesce(lag(content_hash) OVER w, stored) AS changed FROM h WINDOW w AS (PARTITION BY address_id, upload_id ORDER BY upload_ts)),
g AS (SELECT {key_sql('address_id', 'upload_id')} AS document_id, address_id, upload_id, filename, content_hash, upload_ts,
  CAST(live + sum(CAST(changed AS INT)) OVER (PARTITION BY address_id, upload_id ORDER BY upload_ts) AS INT) AS doc_version,
  CASE WHEN changed THEN 'pending' ELSE 'skipped' END AS state FROM c)"""

_PARAGRAPHS = """list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: trim(p, {s})), lambda p: p <> '')""".format(s=SPACES)
SEGMENTS = f"""{DOCS},
seg AS (SELECT document_id, address_id, doc_id, i - 1 AS paragraph_index, 1 AS page_number, ps[i] AS text
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT document_id, address_id, doc_id, {_PARAGRAPHS} AS ps FROM d)))"""

#: The later uploads, some of them unreadable, as jobs with the number of chunks that their texts have.
INGEST = LATER.replace("r AS (", "ub AS (SELECT * REPLACE (CASE WHEN doc_id % 30 = 11 THEN '%PDF-1.7 broken' ELSE body END AS body) FROM u),\nr AS (", 1).replace("FROM u\n  UNION", "FROM ub\n  UNION").replace("END FROM u)", "END FROM ub)") + f""",
texts AS (SELECT g.*, doc_id % 30 = 11 AS pdf, regexp_extract_all(array_to_string({_PARAGRAPHS}, chr(10) || chr(10)), '[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+') AS tokens FROM g JOIN c USING (address_id, upload_id, upload_ts)),
ingested AS (SELECT *, CAST(CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= 50 THEN 1 ELSE 1 + ceil((len(tokens) - 50) / 40.0) END AS INT) AS windows FROM texts)"""


def chunk_sql(source: str, size: int, overlap: int) -> str:
    """Chunks ``k`` of ``source`` (document_id, address_id, page_number, paragraph_index, text), in order of page and
    paragraph."""
    step = size - overlap
    return f"""ord AS (SELECT *, row_number() OVER o AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY page_number, paragraph_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg_start
  FROM {source} WINDOW o AS (PARTITION BY document_id ORDER BY page_number, paragraph_index)),
whole AS (SELECT document_id, any_value(address_id) AS address_id, string_agg(text, chr(10) || chr(10) ORDER BY n) AS full_text FROM ord GROUP BY document_id),
tok AS (SELECT document_id, address_id, full_text, regexp_extract_all(full_text, '[ \\t\\n\\r]*[^ \\t\\n\\r]+|[ \\t\\n\\r]+') AS tokens FROM whole),
num AS (SELECT *, CASE WHEN len(tokens) = 0 THEN 0 WHEN len(tokens) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(tokens) - {size}) / {step}.0) AS INT) END AS windows FROM tok),
win AS (SELECT document_id, address_id, ordinal, tokens[ordinal * {step} + 1 : ordinal * {step} + {size}] AS own, length(array_to_string(tokens[1 : ordinal * {step}], '')) AS char_start
  FROM (SELECT *, unnest(range(0, windows)) AS ordinal FROM num)),
k0 AS (SELECT {key_sql('document_id', '1', 'ordinal')} AS chunk_id, document_id, address_id, CAST(ordinal AS INT) AS ordinal, CAST(char_start AS INT) AS char_start,
  CAST(char_start + length(array_to_string(own, '')) AS INT) AS char_end, array_to_string(own, '') AS text, CAST(len(own) AS INT) AS token_count FROM win),
k AS (SELECT k0.*, o.page_number, CAST(o.paragraph_index AS INT) AS paragraph_index FROM k0 ASOF JOIN ord o ON k0.document_id = o.document_id AND k0.char_start >= o.seg_start)"""


CHUNKS = f"""{SEGMENTS},
{chunk_sql("seg", 50, 10)}"""

CONVERSATIONS = """cv AS (SELECT 'conv-' || conv_id AS document_id, 'addr-' || (conv_id % 5) AS address_id, CAST(turn // 4 + 1 AS INT) AS page_number, turn % 4 AS paragraph_index, text FROM conversations)"""

#: Components of the MD5 feature hash of ``k`` (chunk_id, text), as ``emb``.
EMBEDDED = """w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM k),
wn AS (SELECT chunk_id, token, count(*) AS n FROM w GROUP BY ALL),
comp AS (SELECT chunk_id, CAST(CAST('0x' || substr(md5('idx' || token), 1, 8) AS BIGINT) % 64 AS INT) AS idx, sum(CASE WHEN CAST('0x' || substr(md5('sgn' || token), 1, 8) AS BIGINT) % 2 = 1 THEN n ELSE -n END) AS n FROM wn GROUP BY ALL),
emb AS (SELECT chunk_id, idx, n / sqrt(sum(n * n) OVER (PARTITION BY chunk_id)) AS value FROM comp WHERE n <> 0)"""

JOBS = """ev AS (SELECT 't' || user_id AS task_id, event_id AS seq, 'd' || user_id AS document_id, 'addr-' || (user_id % 20) AS address_id, 'hash:feature-' || CASE WHEN user_id % 2 = 0 THEN 64 ELSE 128 END AS model_id,
  CASE WHEN user_id % 7 = 0 THEN 'rebuild' ELSE 'ingest' END AS job_type,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'extracting' WHEN 'click' THEN 'embedding' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS state,
  CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS INT) END AS chunk_count, CASE WHEN event_type = 'click' THEN CAST(json_extract(props, '$.k') AS INT) ELSE 0 END AS embedding_delta,
  CASE WHEN event_type = 'click' THEN CAST(value / 100 AS DECIMAL(12,6)) ELSE 0 END AS cost_delta, event_id % 6 AS attempts,
  CASE WHEN event_type = 'error' THEN 'embed' END AS failed_step, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'RateLimitError' ELSE 'ValueError' END END AS error_type,
  CASE WHEN event_type = 'error' THEN repeat('value ' || CAST(value AS DECIMAL(12,2)) || ' ', 200) END AS error_message,
  CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 300 SECOND END AS lease_until, ts AS event_ts FROM events),
lastev AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) = 1),
jobs AS (SELECT l.task_id, l.address_id, l.document_id, l.model_id, l.job_type, l.state, a.chunk_count, a.embedding_count, a.embedding_count * 10 AS tokens_embedded, a.cost_usd, a.attempts,
  CASE WHEN l.state IN ('done', 'skipped') THEN NULL ELSE l.failed_step END AS failed_step, CASE WHEN l.state IN ('done', 'skipped') THEN NULL ELSE l.error_type END AS error_type, l.lease_until, a.created_at,
  CASE WHEN l.state IN ('done', 'skipped', 'failed') THEN l.event_ts END AS finished_at
  FROM lastev l JOIN (SELECT task_id, arg_max(chunk_count, seq) FILTER (WHERE chunk_count IS NOT NULL) AS chunk_count, sum(embedding_delta) AS embedding_count, CAST(sum(cost_delta) AS DECIMAL(12,6)) AS cost_usd, max(attempts) AS attempts, min(event_ts) AS created_at FROM ev GROUP BY task_id) a USING (task_id))"""
