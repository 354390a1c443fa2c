"""Views that let the test tables play the roles of the operators' inputs.

A binding is one SQL text that Spark and DuckDB both read, with table names in braces.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_GROUPS = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag || l_linestatus) AS f FROM {lineitem} GROUP BY l_orderkey, l_linenumber) g"
BINDINGS = {
    "b_listing": """
SELECT 'R' || CAST(r_regionkey AS STRING) AS id, r_name AS name, '' AS parent, 'CollectionType' AS doc_type, '' AS hash, CAST(NULL AS STRING) AS file_type, CAST(r_regionkey AS BIGINT) AS ord FROM {region}
UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), n_name, CASE WHEN n_nationkey % 8 = 7 THEN 'trash' ELSE 'R' || CAST(n_regionkey AS STRING) END, 'CollectionType', '', CAST(NULL AS STRING), CAST(100 + n_nationkey AS BIGINT) FROM {nation}
UNION ALL SELECT 'C' || CAST(c_custkey AS STRING), c_name, CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 97 = 0 THEN 'trash' WHEN c_custkey % 101 = 0 THEN 'missing' ELSE 'N' || CAST(c_nationkey AS STRING) END,
  'DocumentType', CAST(c_custkey * 7 % 1000 AS STRING), CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'pdf' WHEN c_mktsegment = 'BUILDING' THEN 'epub' END, CAST(1000 + c_custkey AS BIGINT) FROM {customer}""",
    "b_listing_live": "SELECT * FROM {b_listing} WHERE NOT (doc_type = 'DocumentType' AND (ord - 1000) % 13 = 0)",
    "b_destinations": "SELECT DISTINCT o_orderpriority AS destination, o_orderpriority IN ('1-URGENT', '2-HIGH') AS enabled FROM {orders}",
    "b_recipes": "SELECT t.source, d.destination, 'r1' AS recipe FROM {b_destinations} d CROSS JOIN (SELECT 'pdf' AS source UNION ALL SELECT 'epub' UNION ALL SELECT 'notebook') t",
    "b_publications": """
SELECT 'C' || CAST(o_custkey AS STRING) AS doc_id, o_orderpriority AS destination, 'default' AS profile,
  CASE WHEN o_orderkey % 10 = 0 THEN 'old' ELSE CAST(o_custkey * 7 % 1000 AS STRING) END AS version, CASE WHEN o_orderkey % 5 > 0 THEN 'r1' ELSE 'r0' END AS recipe,
  CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS pages_failed, CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS STRING) ELSE 'x' || CAST(o_orderkey AS STRING) END AS external_id,
  'n' || CAST(o_orderkey % 7 AS STRING) AS target, first_at AS first_published_at, o_orderdate AS last_published_at, o_orderkey AS run_id
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn, min(o_orderdate) OVER (PARTITION BY o_custkey, o_orderpriority) AS first_at FROM {orders}) x WHERE rn = 1""",
    "b_documents": """
SELECT 'C' || CAST(c_custkey AS STRING) AS id, c_name AS name, c_mktsegment AS folder, 'notebook' AS doc_type, CAST(c_custkey * 7 % 1000 AS STRING) AS version, c_custkey AS seen_run_id,
  CASE WHEN c_custkey % 37 = 0 THEN 'HTTP 429' END AS last_error FROM {customer}""",
    "b_tags": """
SELECT 'C' || CAST(c_custkey AS STRING) AS doc_id, 'en' AS kind, c_custkey % 29 = 0 AS unreadable, c_mktsegment AS t1, lower(n_name) AS t2, lower(c_mktsegment) AS t3 FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "b_pages": """
SELECT conv_id AS doc_id, turn AS idx, CASE WHEN conv_id % 7 = 0 OR role = 'system' OR conv_id % 11 = 0 THEN '' ELSE text END AS text, CASE WHEN conv_id % 7 = 0 OR role = 'system' THEN 'HTTP 429' END AS error FROM {conversations}""",
    "b_page_hashes": f"SELECT l_orderkey AS doc_id, l_linenumber AS page_index, 's' || CAST(p AS STRING) AS source_hash, 'r' || f AS render_hash FROM {_GROUPS}",
    "b_page_hashes_prev": f"SELECT l_orderkey AS doc_id, l_linenumber AS page_index, CASE WHEN s % 15 = 0 THEN 'other' ELSE 's' || CAST(p AS STRING) END AS source_hash, CASE WHEN s % 10 = 0 THEN 'moved' ELSE 'r' || f END AS render_hash FROM {_GROUPS}",
    "b_content_pages": f"""
SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN '"p' || CAST(l_linenumber AS STRING) || '"' WHEN l_linenumber = 1 THEN '{{{{"id":"p1","deleted":false}}}}'
  WHEN l_linenumber = 3 THEN '{{{{"id":"p3","deleted":{{{{"timestamp":"1:1","value":1}}}},"redir":{{{{"value":9}}}}}}}}' ELSE '{{{{"id":"p' || CAST(l_linenumber AS STRING) || '","redir":{{{{"value":' || CAST(l_linenumber + 1 AS STRING) || '}}}}}}}}' END AS page FROM {_GROUPS}""",
    "b_cache": "SELECT doc_id, 'fp1' AS fingerprint, n_chars AS size, CAST(doc_id % 365 AS INTEGER) AS last_used_day FROM {documents} WHERE doc_id % 3 = 0",
    "b_outcomes": """
SELECT o_custkey % 50 AS run_id, o_orderkey AS ord, 'doc' || CAST(o_orderkey AS STRING) AS name, 'C' || CAST(o_custkey AS STRING) AS doc_id,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'published' WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'skipped' WHEN o_orderstatus = 'O' THEN 'would_publish' ELSE 'deferred' END AS status,
  CAST(o_orderkey % 9 AS INTEGER) AS pages, CAST(o_orderkey % 5 AS INTEGER) AS transcribed, CAST(o_orderkey % 4 AS INTEGER) AS cached, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS INTEGER) AS pages_failed,
  o_orderpriority AS destination, CASE WHEN o_orderkey % 7 = 0 THEN 'HTTP 429' END AS reason FROM {orders}""",
    "b_runs": """
SELECT event_id AS id, user_id AS device, ts AS started_at, CASE WHEN event_type = 'signup' THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE ts END AS finished_at, value AS seconds,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'nothing_to_do' WHEN 'click' THEN 'partial' END AS outcome,
  CASE WHEN user_id % 2 = 0 THEN 'scheduled' ELSE 'manual' END AS trigger_kind, CAST(event_id % 4 AS INTEGER) AS published, CAST(event_id % 3 AS INTEGER) AS failed FROM {events}""",
    "b_toc": "SELECT conv_id AS doc_id, turn AS ord, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, substr(text, 1, 20) AS title, turn + 1 AS page FROM {conversations}",
    "b_names": "SELECT n_name AS dir, substr(c_name, 1, 14) AS base, 'C' || CAST(c_custkey AS STRING) AS doc_id, c_custkey AS ord FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey",
    "b_machines": "SELECT p_partkey AS id, p_name AS machine FROM {part}",
    "b_hints": "SELECT DISTINCT split_part(p_name, ' ', 1) AS hint, split_part(p_name, ' ', 1) AS model FROM {part} UNION SELECT DISTINCT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM {part} UNION SELECT DISTINCT p_name, p_name FROM {part} WHERE p_name LIKE 'red%'",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


class Tables:
    """The base tables and bindings of one folder, each as a lazy DataFrame attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    @cached_property
    def spark(self) -> SparkSession:
        return self._spark

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BINDINGS:
                text = BINDINGS[name]
                self._made[name] = self._spark.sql(text, **{n: getattr(self, n) for n in _names(text)})
            elif name in BASE:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def duckdb_text(name: str) -> str:
    text = re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", BINDINGS[name])
    return text.replace("{{", "{").replace("}}", "}").replace("TIMESTAMP_NTZ", "TIMESTAMP")


def with_bindings(sql: str) -> str:
    """sql for DuckDB, with the bindings it names in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        for inner in _names(BINDINGS[name]):
            if inner in BINDINGS:
                need(inner)
        if name not in needed:
            needed.append(name)

    for name in dict.fromkeys(re.findall(r"\bb_\w+", sql)):
        if name in BINDINGS:
            need(name)
    ctes = ",\n".join(f"{n} AS ({duckdb_text(n)})" for n in needed)
    if not ctes:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
