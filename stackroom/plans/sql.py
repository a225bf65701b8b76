"""The library for SQL users: functions whose bodies come from the same expressions.

Scalar functions are the column expressions of the library, written out as SQL; Spark puts the body of such a
function in place of a call, so a query that uses them plans like one made of the expressions.
Table functions are queries over the views that :func:`create_functions` is told of.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

from stackroom.functions import naming as N
from stackroom.functions import payload as P
from stackroom.functions import text as X
from stackroom.operators import gate
from stackroom.operators.browse import MISSING

# arguments, type of the result, expression
SCALARS: dict[str, tuple[str, str, Callable[..., Column]]] = {
    "trim_space": ("value STRING", "STRING", X.trim_space),
    "parse_list": ("value STRING", "ARRAY<STRING>", X.parse_list),
    "format_list": ("items ARRAY<STRING>", "STRING", X.format_list),
    "encode_uri_component": ("value STRING", "STRING", X.encode_uri_component),
    "title_has": ("title STRING, term STRING", "BOOLEAN", lambda title, term: F.contains(F.lower(title), F.lower(term))),
    "or_dash": ("value STRING", "STRING", lambda value: X.or_default(value, MISSING)),
    "title_of_file": ("file_name STRING", "STRING", N.title_of_file),
    "title_of_object": ("name STRING", "STRING", N.title_of_object),
    "upload_time": ("name STRING", "TIMESTAMP", N.upload_time),
    "storage_path": ("issued_at TIMESTAMP, file_name STRING", "STRING", N.storage_path),
    "expires_at": ("issued_at TIMESTAMP", "TIMESTAMP", N.expires_at),
    "public_url": ("path STRING", "STRING", N.Bucket().url),
    "viewer_link": ("url STRING", "STRING", N.viewer_link),
    "download_name": ("title STRING", "STRING", N.download_name),
    "document_key": ("request STRING, pos STRING", "STRING", N.row_key),
    "request_payload": ("body STRING", "VARIANT", P.payload_of),
    "text_field": ("value VARIANT", "STRING", P.string_value),
    "holds_role": ("claims VARIANT", "BOOLEAN", lambda claims: P.is_true(P.field(claims, gate.ROLE))),
    "shows_role": ("claims VARIANT", "BOOLEAN", lambda claims: P.is_truthy(P.field(claims, gate.ROLE))),
    "upload_outcome": (
        "auth_header STRING, maintainer BOOLEAN, payload VARIANT",
        "STRUCT<status: INT, reason: STRING>",
        lambda header, maintainer, payload: gate.outcome(header, maintainer, payload, gate.upload_checks(payload)),
    ),
}

CATALOG_ROW = (
    "id STRING, title STRING, url STRING, gcs_path STRING, categories ARRAY<STRING>, writer STRING, tikakar ARRAY<STRING>,"
    " description STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)

# arguments, columns of the result, query; names in braces are views
TABLES: dict[str, tuple[str, str, str]] = {
    "find_titles": ("term STRING", CATALOG_ROW, "SELECT * FROM {catalog} WHERE created_at IS NOT NULL AND title_has(title, find_titles.term)"),
    "uploaded_objects": (
        "",
        "id STRING, title STRING, url STRING",
        "SELECT name, title_of_object(name), public_url(name) FROM {objects} WHERE startswith(name, '%s') AND name <> '%s'"
        % (N.UPLOAD_PREFIX, N.UPLOAD_PREFIX),
    ),
    "gated_uploads": (
        "",
        "request_id BIGINT, issued_at TIMESTAMP, payload VARIANT, status INT, reason STRING",
        """SELECT request_id, issued_at, payload, outcome.status, outcome.reason
           FROM (SELECT r.request_id, r.issued_at, r.payload, upload_outcome(r.auth_header, c.maintainer, r.payload) AS outcome
                 FROM (SELECT *, request_payload(body) AS payload FROM {requests}) r
                 LEFT JOIN (SELECT uid, bool_and(holds_role(claims)) AS maintainer FROM {users} WHERE uid IS NOT NULL GROUP BY uid) c
                 ON r.caller_uid = c.uid)""",
    ),
    "registered_uploads": (
        "",
        CATALOG_ROW,
        """SELECT document_key(CAST(request_id AS STRING), CAST(pos AS STRING)), title_of_file(file_name),
                  public_url(storage_path(issued_at, file_name)), storage_path(issued_at, file_name),
                  CAST(array() AS ARRAY<STRING>), '', CAST(NULL AS ARRAY<STRING>), '', issued_at, CAST(NULL AS TIMESTAMP)
           FROM (SELECT u.request_id, u.issued_at, f.pos, text_field(try_variant_get(f.value, '$.fileName', 'variant')) AS file_name
                 FROM gated_uploads() u, LATERAL variant_explode_outer(try_variant_get(u.payload, '$[0].files', 'variant')) f
                 WHERE u.status = 200)
           WHERE file_name IS NOT NULL""",
    ),
}

# Operators print as calls; called by their quoted names they are functions that SQL knows.
_CALLS = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(<=>|<=|>=|==|=|<|>|!|\+|-|\*|/|%|&|\||\^|~|and|or|not)\(")


def sql_of(expression: Column) -> str:
    """The expression as SQL text."""
    return _CALLS.sub(lambda m: f"`{m[1]}`(" if m[1] else m[0], expression._jc.node().sql())


def _arguments(declared: str) -> list[str]:
    return [part.split()[0] for part in re.split(r", (?=\w+ [A-Z])", declared)] if declared else []


def create_functions(spark: SparkSession, **views: str) -> None:
    """Create all scalar functions, and the table functions whose views are given: catalog, objects, requests, users.

    They are temporary: they belong to the session.
    """
    for name, (declared, result, build) in SCALARS.items():
        body = sql_of(build(*[F.col(a) for a in _arguments(declared)]))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {result} RETURN {body}")
    for name, (declared, result, query) in TABLES.items():
        # a table function may call those before it
        wanted = set(re.findall(r"\{(\w+)\}", query)) | ({"requests", "users"} if "gated_uploads()" in query else set())
        if wanted <= views.keys():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS TABLE ({result}) RETURN {query.format(**views)}")
