"""The same results in plain SQL, for an independent check on another engine.

The views are written from the given tables' own columns, not from the request
bodies, so that the reading of bodies is checked as well.
"""

from __future__ import annotations

VIEWS = r"""
WITH catalog AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
         split_part(text, chr(10), 1) AS title,
         'https://storage.googleapis.com/library/uploads/' || (1704067200000 + doc_id * 1000)
           || '-' || lang || '.' || source || '_' || doc_id || '.pdf' AS url,
         'uploads/' || (1704067200000 + doc_id * 1000) || '-' || lang || '.' || source || '_' || doc_id || '.pdf'
           AS gcs_path,
         lang || ', ' || source AS categories,
         CASE WHEN lang = 'es' THEN '' WHEN lang = 'de' THEN NULL ELSE source END AS writer,
         CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN '' ELSE source || ', ' || lang END AS tikakar,
         CASE WHEN source = 'src2' THEN NULL ELSE n_chars || ' characters' END AS description,
         CASE WHEN source = 'src13' THEN NULL
              ELSE TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_chars) END AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at
  FROM documents),
objects AS (
  SELECT gcs_path AS name FROM catalog
  UNION ALL
  SELECT CASE WHEN starts_with(url, 'https:') THEN 'uploads/' || (1704067200000 + page_id * 1000) || '-page.'
              ELSE 'uploads/page.' END || page_id || '.html.pdf' FROM pages
  UNION ALL
  SELECT CASE WHEN r_regionkey = 0 THEN 'uploads/' ELSE 'other/' || r_name || '.pdf' END FROM region
  UNION ALL
  SELECT 'uploads/' || CASE n_nationkey % 5 WHEN 0 THEN '_draft ' || n_name || '.pdf' WHEN 1 THEN '.' || n_name
           WHEN 2 THEN '_sub/2-' || n_name || '.pdf' WHEN 3 THEN '9223372036854775807-' || n_name || '.pdf'
           ELSE n_name || '._COPYING_' END FROM nation),
users AS (
  SELECT c_custkey AS uid, c_name AS display_name, lower(c_name) || '@example.com' AS email,
         c_mktsegment AS segment
  FROM customer),
calls AS (
  SELECT o.*, u.segment,
         CASE WHEN o_totalprice < 25000 THEN 401
              WHEN u.uid IS NULL THEN 500
              WHEN u.segment <> 'MACHINERY' THEN 403 ELSE 200 END AS call_status,
         CASE WHEN o_totalprice < 25000 THEN 'no bearer header'
              WHEN u.uid IS NULL THEN 'invalid token'
              WHEN u.segment <> 'MACHINERY' THEN 'maintainers only' ELSE 'ok' END AS call_reason
  FROM orders o LEFT JOIN users u ON o.o_custkey = u.uid),
upload_gate AS (
  SELECT o_orderkey AS request_id, o_orderdate AS issued_at, o_orderpriority, o_totalprice,
         CASE WHEN call_status <> 200 THEN call_status
              WHEN o_totalprice < 35000 THEN 500 WHEN o_totalprice < 45000 THEN 400 ELSE 200 END AS status,
         CASE WHEN call_status <> 200 THEN call_reason
              WHEN o_totalprice < 30000 THEN 'malformed body' WHEN o_totalprice < 35000 THEN 'body is null'
              WHEN o_totalprice < 45000 THEN 'files is not an array' ELSE 'ok' END AS reason
  FROM calls),
files AS (
  SELECT request_id, issued_at, CAST(i - 1 AS INTEGER) AS pos,
         request_id || '.part' || ((i + 1) // 2) || '.pdf' AS file_name,
         CASE WHEN i = 3 THEN 'image/png' ELSE 'application/pdf' END AS file_type
  FROM upload_gate, range(1, 6) AS n(i)
  WHERE status = 200 AND o_totalprice >= 60000 AND i <= CAST(left(o_orderpriority, 1) AS INTEGER)
  UNION ALL
  SELECT request_id, issued_at, 1, 'ok.pdf', 'application/pdf'
  FROM upload_gate WHERE status = 200 AND o_totalprice >= 55000 AND o_totalprice < 60000),
targets AS (
  SELECT *, 'uploads/' || epoch_ms(issued_at) || '-' || file_name AS storage_path,
         issued_at + INTERVAL 15 MINUTE AS expires_at
  FROM files),
staged AS (
  SELECT l_orderkey AS request_id, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-'
           || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS file_key,
         l_orderkey || '.part' || l_linenumber || '.pdf' AS file_name,
         CASE WHEN l_returnflag = 'A' THEN 'image/png' ELSE 'application/pdf' END AS file_type,
         CAST(l_quantity * 30 AS INTEGER) AS delay_seconds,
         l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || l_linestatus AS content
  FROM lineitem),
matches AS (
  SELECT s.*, t.pos, t.storage_path, t.expires_at, t.issued_at + to_seconds(s.delay_seconds) AS put_at,
         s.file_type = t.file_type AS type_ok
  FROM staged s JOIN targets t ON s.request_id = t.request_id AND s.file_name = t.file_name
  WHERE NOT EXISTS (SELECT 1 FROM targets e
                    WHERE e.request_id = t.request_id AND e.file_name = t.file_name AND e.pos < t.pos)),
grant_gate AS (
  SELECT o_orderkey AS request_id, t.email, t.uid,
         CASE WHEN call_status <> 200 THEN call_status
              WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 400
              WHEN o_orderpriority = '3-MEDIUM' OR t.uid IS NULL THEN 500 ELSE 200 END AS status,
         CASE WHEN call_status <> 200 THEN call_reason
              WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'email is required'
              WHEN o_orderpriority = '3-MEDIUM' OR t.uid IS NULL THEN 'no user with this email'
              ELSE 'ok' END AS reason
  FROM calls c LEFT JOIN users t ON t.email = 'customer#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '@example.com'),
steps AS (
  SELECT user_id, regexp_extract(props, '"k": (\d+)', 1) AS id, ts, event_id AS seq, event_type, value FROM events),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY ts, seq) AS n FROM steps WHERE event_type <> 'view'),
last_sets AS (
  SELECT *, max(n) FILTER (WHERE event_type <> 'click') OVER (PARTITION BY user_id, id) AS set_n FROM ranked),
fold AS (
  SELECT user_id, id,
         coalesce(bool_or(event_type <> 'error') FILTER (WHERE n = set_n), false)
           <> (count(*) FILTER (WHERE event_type = 'click' AND n > coalesce(set_n, 0)) % 2 = 1) AS saved
  FROM last_sets GROUP BY user_id, id),
opens AS (
  SELECT user_id, id, seq, ts FROM steps WHERE event_type = 'view'),
bytes AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, lang,
         strlen(text) AS content_bytes, md5(text) AS content_md5, strlen(text) AS size
  FROM documents),
saved AS (
  SELECT f.user_id, f.id, b.title, CASE WHEN lang <> 'de' THEN content_bytes END AS content_bytes,
         CASE WHEN lang <> 'de' THEN content_md5 END AS content_md5, CASE WHEN lang <> 'de' THEN size END AS size
  FROM fold f JOIN bytes b ON f.id = b.id WHERE f.saved),
edit_calls AS (
  SELECT s.seq AS request_id, s.ts, s.user_id, s.event_type, s.value,
         CASE WHEN value > 150 THEN 'missing-' ELSE '' END || s.id AS target_id, u.segment
  FROM steps s LEFT JOIN users u ON s.user_id = u.uid AND s.value <= 300),
edit_gate AS (
  SELECT *, CASE reason WHEN 'ok' THEN 200 WHEN 'no bearer header' THEN 401 WHEN 'maintainers only' THEN 403
                        WHEN 'no such document' THEN 404 WHEN 'invalid token' THEN 500 WHEN 'malformed body' THEN 500
                        WHEN 'body is null' THEN 500 ELSE 422 END AS status
  FROM (SELECT e.*,
          CASE WHEN value < 3 THEN 'no bearer header'
               WHEN segment IS NULL THEN 'invalid token'
               WHEN segment <> 'MACHINERY' THEN 'maintainers only'
               WHEN event_type = 'error' AND value < 10 THEN 'malformed body'
               WHEN event_type = 'error' AND value >= 20 AND value < 30 THEN 'body is null'
               WHEN c.id IS NULL THEN 'no such document'
               WHEN event_type = 'error' AND value < 20 THEN 'wrong type for title'
               WHEN event_type = 'error' AND value < 40 THEN 'wrong type for categories'
               ELSE 'ok' END AS reason
        FROM edit_calls e LEFT JOIN catalog c ON e.target_id = c.id)),
good_edits AS (SELECT * FROM edit_gate WHERE status = 200),
last_edits AS (
  SELECT * FROM (
    SELECT target_id, event_type, request_id, user_id, value,
           row_number() OVER (PARTITION BY target_id, event_type ORDER BY ts DESC, request_id DESC) AS back
    FROM good_edits)
  WHERE back = 1),
edited AS (
  SELECT c.id,
         CASE WHEN t.request_id IS NULL THEN c.title ELSE 'Edited ' || t.request_id END AS title,
         c.url, c.gcs_path,
         CASE WHEN w.request_id IS NULL THEN c.categories WHEN w.value < 30 THEN '' ELSE 'c' || w.request_id END
           AS categories,
         CASE WHEN w.request_id IS NULL THEN c.writer END AS writer,
         CASE WHEN d.request_id IS NULL THEN c.tikakar ELSE 'u' || d.user_id || ', ' END AS tikakar,
         CASE WHEN d.request_id IS NULL THEN c.description ELSE 'by ' || d.user_id END AS description,
         c.created_at, (SELECT max(ts) FROM good_edits g WHERE g.target_id = c.id) AS updated_at
  FROM catalog c
  LEFT JOIN last_edits t ON t.target_id = c.id AND t.event_type = 'click'
  LEFT JOIN last_edits w ON w.target_id = c.id AND w.event_type = 'purchase'
  LEFT JOIN last_edits d ON d.target_id = c.id AND d.event_type = 'signup'),
new_objects AS (
  SELECT name FROM objects
  WHERE starts_with(name, 'uploads/') AND name <> 'uploads/' AND name NOT IN (SELECT gcs_path FROM catalog)),
new_rows AS (
  SELECT sha256(name) AS id,
         regexp_replace(regexp_replace(substr(name, 9), '^\d+-', ''), '\.[^/.]+$', '') AS title,
         'https://storage.googleapis.com/library/' || name AS url, name AS gcs_path,
         '' AS categories, '' AS writer, CAST(NULL AS VARCHAR) AS tikakar, '' AS description,
         CASE WHEN regexp_matches(name, '^uploads/\d{1,14}-')
              THEN CAST(make_timestamp(CAST(regexp_extract(name, '^uploads/(\d{1,14})-', 1) AS BIGINT) * 1000) AS TIMESTAMP)
              ELSE TIMESTAMP '2024-06-01 00:00:00' END AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at
  FROM new_objects)
"""

_VIEWER = (
    "'https://docs.google.com/gview?embedded=true&url=' || replace(replace(replace(replace(replace("
    "url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
)

_LISTED = "SELECT * FROM catalog WHERE created_at IS NOT NULL"

SELECTS: dict[str, str] = {
    "catalog_recent": _LISTED,
    "catalog_search": _LISTED + " AND contains(lower(title), lower('É'))",
    "catalog_search_indexed": _LISTED + " AND contains(lower(title), 'the')",
    "catalog_page": _LISTED + " ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100",
    "lookup_few": "SELECT * FROM catalog WHERE id IN (SELECT CAST(r_regionkey AS VARCHAR) FROM region)",
    "snapshot_split": "SELECT id, title, created_at, CAST(1 AS BIGINT) AS damaged FROM catalog",
    "catalog_search_flagged": """
        SELECT id, title, url, created_at, id IN (SELECT id FROM saved WHERE user_id = 7) AS is_saved
        FROM catalog WHERE created_at IS NOT NULL AND contains(lower(title), 'the')""",
    "catalog_display": """
        SELECT id, title, CASE WHEN writer IS NULL OR writer = '' THEN '-' ELSE writer END AS writer, categories
        FROM catalog""",
    "object_listing": r"""
        SELECT name AS id, regexp_replace(substr(name, 9), '^\d+-', '') AS title,
               'https://storage.googleapis.com/library/' || name AS url
        FROM objects WHERE starts_with(name, 'uploads/') AND name <> 'uploads/'""",
    "edit_form": """
        SELECT id, title, coalesce(writer, '') AS writer, coalesce(description, '') AS description,
               categories, coalesce(tikakar, '') AS tikakar FROM catalog""",
    "edit_normalize": """
        SELECT id, title, coalesce(writer, '') AS writer, coalesce(description, '') AS description,
               categories, coalesce(tikakar, '') AS tikakar FROM catalog""",
    "download_export": f"SELECT id, title || '.pdf' AS file_name, {_VIEWER} AS viewer_url FROM catalog",
    "viewer_links": f"SELECT page_id, {_VIEWER} AS viewer_url FROM pages",
    "point_lookup": "SELECT * FROM catalog WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
    "is_empty": """
        SELECT 'library' AS list, count(*) = 0 AS is_empty FROM catalog
        UNION ALL SELECT 'found', count(*) = 0 FROM catalog WHERE contains(lower(title), 'the')
        UNION ALL SELECT 'not found', count(*) = 0 FROM catalog WHERE contains(title, '%')""",
    "snapshot_json": _LISTED,
    "request_gate": """
        SELECT 'upload' AS kind, request_id, status, reason FROM upload_gate
        UNION ALL SELECT 'edit', request_id, status, reason FROM edit_gate
        UNION ALL SELECT 'grant', request_id, status, reason FROM grant_gate""",
    "upload_register": """
        SELECT sha256(request_id || '/' || pos) AS id, regexp_replace(file_name, '\\.[^/.]+$', '') AS title,
               'https://storage.googleapis.com/library/' || storage_path AS url, storage_path AS gcs_path,
               '' AS categories, '' AS writer, CAST(NULL AS VARCHAR) AS tikakar, '' AS description,
               issued_at AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
        FROM targets""".replace("\\\\", "\\"),
    "request_outcomes": "SELECT request_id, status, reason FROM upload_gate WHERE status <> 200",
    "upload_files_rejected": """
        SELECT request_id, 0 AS pos, 500 AS file_status
        FROM upload_gate WHERE status = 200 AND o_totalprice >= 50000 AND o_totalprice < 60000""",
    "upload_targets_only": """
        SELECT request_id, pos, file_name, file_type, storage_path, issued_at, expires_at FROM targets""",
    "pdf_only": "SELECT request_id, pos, file_name FROM files WHERE file_type = 'application/pdf'",
    "upload_match_first": "SELECT request_id, file_key, file_name, pos, storage_path FROM matches",
    "upload_window": """
        SELECT request_id, file_key, put_at, expires_at, put_at < expires_at AS in_time, type_ok FROM matches""",
    "upload_content": """
        SELECT storage_path, file_type AS content_type, strlen(content) AS content_bytes,
               md5(content) AS content_md5, put_at, file_key
        FROM matches WHERE put_at < expires_at AND type_ok
        QUALIFY row_number() OVER (PARTITION BY storage_path ORDER BY put_at DESC, request_id DESC, file_key DESC) = 1""",
    "edits_apply": "SELECT * FROM edited",
    "edit_overlay": """
        SELECT * REPLACE (CAST(NULL AS TIMESTAMP) AS updated_at) FROM edited WHERE created_at IS NOT NULL""",
    "edits_rejected": "SELECT request_id, target_id FROM edit_gate WHERE status = 404",
    "saved_ids": "SELECT user_id, id FROM fold WHERE saved",
    "saved_flag": """
        SELECT DISTINCT o.user_id, o.id, coalesce(f.saved, false) AS is_saved
        FROM opens o LEFT JOIN fold f ON f.user_id = o.user_id AND f.id = o.id""",
    "saved_fold": "SELECT * FROM fold",
    "saved_upsert": """
        SELECT DISTINCT o.user_id, o.id, 'Copy of ' || title AS title, content_bytes, content_md5, size
        FROM opens o JOIN bytes b ON o.id = b.id
        UNION ALL
        SELECT * FROM saved s WHERE NOT EXISTS (SELECT 1 FROM opens o WHERE o.user_id = s.user_id AND o.id = s.id)""",
    "saved_delete": """
        SELECT * FROM saved s WHERE NOT EXISTS (SELECT 1 FROM opens o WHERE o.user_id = s.user_id AND o.id = s.id)""",
    "saved_set_add": "SELECT user_id, id FROM saved UNION SELECT user_id, id FROM opens",
    "saved_set_remove": "SELECT user_id, id FROM saved EXCEPT SELECT user_id, id FROM opens",
    "saved_set_toggle": """
        (SELECT user_id, id FROM saved EXCEPT SELECT user_id, id FROM opens)
        UNION ALL (SELECT user_id, id FROM opens EXCEPT SELECT user_id, id FROM saved)""",
    "content_fetch": """
        SELECT DISTINCT c.url, true AS fetched, content_bytes, content_md5
        FROM opens o JOIN catalog c ON o.id = c.id JOIN bytes b ON o.id = b.id
        UNION ALL
        SELECT DISTINCT 'https://storage.googleapis.com/library/' || name, false, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR)
        FROM objects WHERE contains(name, 'page.')""",
    "content_store": """
        SELECT DISTINCT user_id, o.id, title, content_bytes, content_md5, size FROM opens o JOIN bytes b ON o.id = b.id""",
    "content_resolve": """
        SELECT o.user_id, o.id, o.seq, c.title,
               CASE WHEN s.content_md5 IS NULL THEN c.url ELSE 'blob:/' || o.user_id || '/' || o.id END AS read_url,
               'Reading ' || c.title || CASE WHEN s.content_md5 IS NULL THEN ' (Online)' ELSE ' (Offline)' END AS status
        FROM opens o JOIN catalog c ON o.id = c.id LEFT JOIN saved s ON s.user_id = o.user_id AND s.id = o.id""",
    "role_label": """
        SELECT uid, display_name, email,
               CASE WHEN segment IN ('MACHINERY', 'FURNITURE') THEN 'Maintainer' ELSE 'Reader' END AS role FROM users""",
    "user_by_email": """
        SELECT o_orderkey AS request_id, r.email, u.uid
        FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
                     WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
                     THEN 'customer#' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '@example.com' END AS email
              FROM orders) r LEFT JOIN users u ON r.email = u.email""",
    "role_grant": """
        SELECT uid, display_name, email,
               CASE WHEN uid IN (SELECT uid FROM grant_gate WHERE status = 200) OR segment = 'MACHINERY'
                    THEN '{"maintainer":true}'
                    WHEN segment = 'FURNITURE' THEN '{"maintainer":"true"}'
                    WHEN segment = 'HOUSEHOLD' THEN '{"maintainer":false}' ELSE '{}' END AS claims FROM users""",
    "grant_messages": """
        SELECT request_id, 'Successfully made ' || email || ' a maintainer.' AS message
        FROM grant_gate WHERE status = 200""",
    "backfill": "SELECT * FROM new_rows",
    "backfill_count": "SELECT count(*) AS processed FROM new_objects",
    "backfill_stream": "SELECT * FROM new_rows",
    "saved_state_stream": "SELECT user_id, id FROM fold WHERE saved",
}

SELECTS["upload_append"] = SELECTS["upload_register"]
SELECTS["sql_search"] = SELECTS["catalog_search_indexed"]
SELECTS["sql_object_listing"] = SELECTS["object_listing"]
SELECTS["sql_upload_register"] = SELECTS["upload_register"]
SELECTS["sql_upload_gate"] = "SELECT 'upload' AS kind, request_id, status, reason FROM upload_gate"

ORACLE_SQL = {name: VIEWS + select for name, select in SELECTS.items()}
