"""The library's registered queries over the test tables, each beside SQL that gives the same rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.functions import scalars as S
from docsync_spark.functions import text as T
from docsync_spark.operators import hierarchy, memo, notes, pages, report, schedule, selection, state
from docsync_spark.plans.bindings import BINDINGS, Tables, with_bindings
from docsync_spark.sources import files, scratch, sinks, tables
from docsync_spark.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_bindings(sql)
        return f

    return add


def scalar(name: str, binding: str, keys: list[str], columns: dict[str, tuple], where: str | None = None) -> None:
    """A query of Column expressions over one binding; columns: name -> (expression, SQL)."""
    parts = ", ".join([*keys, *(f"{sql} AS {c}" for c, (_, sql) in columns.items())])
    SQL[name] = with_bindings(f"SELECT {parts} FROM {binding}" + (f" WHERE {where}" if where else ""))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(Tables(spark, sf_dir), binding)
        df = df.filter(where) if where else df
        return df.select(*keys, *[e().alias(c) for c, (e, _) in columns.items()])

    QUERIES[name] = run


c = F.col
no_files = lambda: F.array().cast("array<string>")

# --- scalars ---------------------------------------------------------------------------------

scalar("b01_document_version", "b_listing", ["id"], {"version": (lambda: S.document_version(c("hash"), (c("ord") % 4).cast("string")), "coalesce(nullif(hash, ''), CAST(ord % 4 AS VARCHAR), '1')")})
scalar("b02_document_type", "b_listing", ["id"], {
    "source": (lambda: S.document_type(c("file_type"), F.array(F.concat("id", F.when(c("ord") % 5 == 0, ".PDF").otherwise(".rm"))), c("name")), "CASE WHEN lower(trim(file_type)) IN ('pdf', 'epub') THEN lower(trim(file_type)) WHEN ord % 5 = 0 THEN 'pdf' ELSE 'notebook' END"),
    "titled": (lambda: S.document_type(F.lit("notebook"), no_files(), F.concat("name", F.when(c("ord") % 3 == 0, ".epub").otherwise(""))), "CASE WHEN ord % 3 = 0 THEN 'epub' ELSE 'notebook' END"),
})
scalar("b03_to_datetime", "orders", ["o_orderkey"], {
    "from_millis": (lambda: S.to_iso_date((F.unix_timestamp(c("o_orderdate").cast("timestamp")) * 1000).cast("string")), "strftime(o_orderdate, '%Y-%m-%d')"),
    "from_text": (lambda: S.to_iso_date(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))), "strftime(o_orderdate, '%Y-%m-%d')"),
    "unreadable": (lambda: S.to_iso_date(c("o_orderpriority")), "CAST(NULL AS VARCHAR)"),
})
scalar("b04_normalize_tag", "part", ["p_partkey"], {"tag": (lambda: S.normalize_tag(F.concat(F.lit(" #"), "p_name", F.lit("!/é "), "p_brand")), r"regexp_replace(regexp_replace(p_name || '!/é ' || p_brand, '\s+', '-', 'g'), '[^\w\-/é]', '', 'g')")})
scalar("b05_normalize_path", "part", ["p_partkey"], {"path": (lambda: S.normalize_path(F.concat("p_brand", F.lit("\\ "), "p_name", F.lit(" //"), "p_type")), "lower(p_brand) || '/' || lower(p_name) || '/' || lower(p_type)")})
scalar("b06_document_path", "part", ["p_partkey"], {
    "path": (lambda: S.document_path(F.array("p_brand", "p_type"), c("p_name")), "p_brand || '/' || p_type || '/' || p_name"),
    "folder": (lambda: S.folder_label(F.array("p_brand", "p_type")), "p_brand || ' / ' || p_type"),
})
scalar("b07_matches_target", "b_listing", ["id"], {
    "by_name": (lambda: S.matches_target(c("id"), c("name"), F.array(F.lit("Top")), "000012"), "contains(lower(name), '000012')"),
    "by_id": (lambda: S.matches_target(c("id"), c("name"), no_files(), "c17"), "lower(id) = 'c17' OR contains(lower(name), 'c17')"),
    "by_path": (lambda: S.matches_target(c("id"), c("name"), F.array(F.lit("Top")), "TOP/c"), "contains('top/' || lower(name), 'top/c')"),
    "blank": (lambda: S.matches_target(c("id"), c("name"), no_files(), "  "), "false"),
})
scalar("b08_path_filter", "part", ["p_partkey"], {
    "part_of": (lambda: S.path_filter(c("p_name"), "RED"), "contains(lower(p_name), 'red')"),
    "regex": (lambda: S.path_filter(c("p_name"), None, "^[a-m].*g$"), "regexp_matches(p_name, '^[a-m].*g$')"),
})
scalar("b09_excluded", "b_documents", ["id"], {"excluded": (lambda: S.excluded(F.concat(F.lit("Top / "), "folder"), ["building", " Machinery ", ""]), "lower(folder) IN ('building', 'machinery')")})
scalar("b10_b11_documents", "b_listing", ["id"], {
    "is_document": (lambda: S.is_document(c("doc_type"), c("name")), "doc_type = 'DocumentType' AND trim(name) <> ''"),
    "of_type": (lambda: F.coalesce(S.type_filter(c("file_type"), ["pdf"]), F.lit(False)), "coalesce(file_type = 'pdf', false)"), "any_type": (lambda: S.type_filter(c("file_type"), []), "true"),
})
scalar("b12_is_trashed", "b_listing", ["id"], {
    "trashed": (lambda: S.is_trashed(c("ord") % 4 == 0, F.array(F.when(c("ord") % 6 == 0, "[TRASH]").otherwise("Top"), F.lit("Inner"))), "ord % 4 = 0 OR ord % 6 = 0"),
    "by_hand": (lambda: S.is_trashed(F.lit(False), no_files()), "false"),
})
scalar("b14_sanitize_filename", "part", ["p_partkey"], {"name": (lambda: S.sanitize_filename(F.concat(F.lit("- "), "p_name", F.lit('/:*?"<>|#'), "p_brand", F.lit(" -"))), "p_name || '-' || replace(p_brand, '#', '-')"), "empty": (lambda: S.sanitize_filename(F.lit("//")), "'Untitled'")})
scalar("b15_path_is_contained", "part", ["p_partkey"], {"fine": (lambda: S.path_is_contained(F.array(c("p_brand"), F.when(c("p_partkey") % 3 == 0, " .. ").otherwise(c("p_name")))), "p_partkey % 3 <> 0")})
scalar("b16_format_size", "lineitem", ["l_orderkey", "l_linenumber"], {
    "size": (lambda: S.format_size((c("l_partkey") * c("l_partkey") * c("l_partkey")).cast("long")), "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0) ELSE printf('%.1f GB', n / 1073741824.0) END"),
})
SQL["b16_format_size"] = SQL["b16_format_size"].replace("FROM lineitem", "FROM (SELECT *, l_partkey * l_partkey * l_partkey AS n FROM lineitem)")
scalar("b17_humanize", "events", ["event_id"], {
    "duration": (lambda: S.humanize_duration(c("event_id") * 37), "CASE WHEN n < 10 THEN printf('%.1fs', n::DOUBLE) WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN n // 60 || 'm ' || n % 60 || 's' WHEN n < 86400 THEN n // 3600 || 'h ' || n % 3600 // 60 || 'm' ELSE n // 86400 || 'd ' || n % 86400 // 3600 || 'h' END"),
    "ago": (lambda: S.humanize_ago(c("event_id") * 37), "CASE WHEN n < 90 THEN 'just now' WHEN n >= 86400 THEN n // 86400 || ' day' || CASE WHEN n // 86400 = 1 THEN '' ELSE 's' END || ' ago' WHEN n >= 3600 THEN n // 3600 || ' hour' || CASE WHEN n // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE n // 60 || ' minute' || CASE WHEN n // 60 = 1 THEN '' ELSE 's' END || ' ago' END"),
    "moment": (lambda: S.format_moment(c("ts")), "strftime(ts, '%a %d %b %H:%M')"),
})
SQL["b17_humanize"] = SQL["b17_humanize"].replace("FROM events", "FROM (SELECT *, event_id * 37 AS n FROM events)")
_phrase = "CASE WHEN outcome IS NULL THEN 'did not finish' WHEN outcome = 'nothing_to_do' THEN 'nothing to do' WHEN outcome = 'success' THEN CASE WHEN published > 0 THEN 'synced ' || published || ' document' || CASE WHEN published = 1 THEN '' ELSE 's' END ELSE 'nothing to do' END WHEN outcome = 'partial' THEN 'synced ' || published || ' document' || CASE WHEN published = 1 THEN '' ELSE 's' END || ', ' || failed || ' failed' ELSE 'failed' END"
_described = lambda: S.describe_run(c("outcome"), c("published"), c("failed"), F.lit(None).cast("string"))
scalar("b18_describe_run", "b_runs", ["id"], {
    "phrase": (_described, _phrase),
    "line": (lambda: S.run_line(F.lit(None).cast("timestamp"), c("started_at").cast("timestamp"), c("finished_at").cast("timestamp"), _described()), f"strftime(started_at, '%a %d %b %H:%M') || '   ' || {_phrase} || CASE WHEN finished_at IS NULL THEN '' ELSE '   0.0s' END"),
})
scalar("b19_describe_outcome", "b_outcomes", ["ord"], {
    "line": (lambda: S.describe_outcome(F.concat(F.lit("A rather long name of "), "name"), c("status"), c("pages"), c("transcribed"), c("cached"), c("pages_failed"), F.array("destination"), c("reason")),
             "'  ' || CASE WHEN part THEN '⚠' WHEN status = 'failed' THEN '✗' WHEN status IN ('published', 'would_publish') THEN '✓' ELSE '·' END || ' ' || n || ' ' || CASE status WHEN 'skipped' THEN coalesce(reason, 'unchanged') WHEN 'deferred' THEN coalesce(reason, 'pending, past the limit') WHEN 'failed' THEN coalesce(reason, 'failed') ELSE rpad(pages || ' page' || CASE WHEN pages = 1 THEN '' ELSE 's' END, 9, ' ') || ' ' || rpad(transcribed || ' transcribed, ' || cached || ' cached', 28, ' ') || CASE status WHEN 'would_publish' THEN ' ⇢ ' ELSE ' → ' END || destination || CASE WHEN part THEN '   (2 pages missing)' ELSE '' END END"),
    "row": (lambda: S.comparison_row(c("doc_id"), F.concat("name", F.lit(" of many")), F.lit(None).cast("string")), "rpad(doc_id, 8, ' ') || '  ' || rpad(CASE WHEN length(name || ' of many') > 15 THEN substr(name || ' of many', 1, 14) || '…' ELSE name || ' of many' END, 15, ' ') || '.notebook  '"),
})
SQL["b19_describe_outcome"] = SQL["b19_describe_outcome"].replace("FROM b_outcomes", "FROM (SELECT *, pages_failed > 0 AND status IN ('published', 'would_publish') AS part, substr('A rather long name of ' || name, 1, 23) || '…' AS n FROM b_outcomes)")
scalar("b20_page_number_of", "lineitem", ["l_orderkey", "l_linenumber"], {"number": (lambda: S.page_number_of(F.concat(F.when(c("l_linenumber") == 1, "cover").otherwise("Page-"), "l_partkey", F.lit(".png"))), "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_partkey AS INTEGER) END")})
scalar("b23_content_key", "documents", ["doc_id"], {"key": (lambda: S.content_key(c("text"), F.lit("fp1")), "sha256(CAST(encode(text) || '\\x00'::BLOB || 'fp1'::BLOB AS BLOB))"), "digest": (lambda: S.block_digest(F.concat(F.lit("\n "), "text", F.lit(" \n"))), "substr(sha256(trim(text, ' ' || chr(10))), 1, 8)")})
scalar("b25_recipe", "b_recipes", ["source", "destination"], {"recipe_key": (lambda: S.document_recipe(F.lit("v1"), c("source"), F.lit(S.settings_digest({"b": 1, "a": [2]}, ["a", "b"]))), "substr(sha256(CAST('v1'::BLOB || '\\x00'::BLOB || encode(source) || '\\x00'::BLOB || '{\"a\": [2], \"b\": 1}'::BLOB AS BLOB)), 1, 16)")})
scalar("b26_page_label", "b_toc", ["doc_id", "ord"], {
    "label": (lambda: S.page_label(c("page"), F.when(c("ord") % 2 == 0, F.lit(" xiii ")).otherwise(c("page").cast("string"))), "CASE WHEN ord % 2 = 0 THEN 'Page xiii (pdf-' || page || ')' ELSE 'Page ' || page END"),
    "header": (lambda: S.section_header(F.lit("Page 1"), F.when(c("ord") % 2 == 0, F.array(F.lit("Part"), c("title"))).otherwise(no_files())), "'---' || chr(10) || chr(10) || CASE WHEN ord % 2 = 0 THEN '<span style=\"font-size: 0.9em; color: #777777\"><b>' || title || '</b><br><span style=\"font-size: 0.8em; color: #aaaaaa\">Part | Page 1</span></span>' ELSE '<span style=\"font-size: 0.9em; color: #777777\"><b>Page 1</b></span>' END"),
})
scalar("b29_created_date", "b_publications", ["doc_id", "destination"], {"created": (lambda: S.created_date(F.when(c("run_id") % 2 == 0, F.lit("2020-02-03")), F.when(c("run_id") % 3 == 0, F.date_format("first_published_at", "yyyy-MM-dd HH:mm:ss")), F.lit("bad"), F.lit("2024-01-01")), "CASE WHEN run_id % 2 = 0 THEN '2020-02-03' WHEN run_id % 3 = 0 THEN strftime(first_published_at, '%Y-%m-%d') ELSE '2024-01-01' END")})
scalar("b30_page_body", "b_pages", ["doc_id", "idx"], {"body": (lambda: S.page_body(c("text"), F.concat("error", F.lit("\n\nmore "))), "CASE WHEN error IS NULL THEN trim(text, ' ' || chr(10)) ELSE '> [!warning] Page not transcribed' || chr(10) || '> ' || error || chr(10) || '>' || chr(10) || '> more' END")})
scalar("b34_note_path", "part", ["p_partkey"], {
    "mirrored": (lambda: S.note_path(F.array(c("p_brand"), F.lit(" ")), F.concat("p_name", F.lit("?")), "Notes"), "'Notes/' || replace(p_brand, '#', '-') || '/' || p_name"),
    "flat": (lambda: S.note_path(F.array("p_brand", "p_type"), c("p_name"), "Notes", mirror=False), "'Notes/' || replace(p_brand, '#', '-') || ' - ' || p_type || ' - ' || p_name"),
})
scalar("b35_stored_times", "b_runs", ["id"], {"iso": (lambda: S.to_utc_iso(S.parse_stored(F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"))), "strftime(started_at, '%Y-%m-%dT%H:%M:%SZ')"), "bad": (lambda: S.parse_stored(F.lit("soon")).cast("string"), "CAST(NULL AS VARCHAR)")})


@query("b22_redact", """
WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS word FROM documents)),
top AS (SELECT word FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{8,}')) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 20)),
l AS (SELECT list(word ORDER BY -length(word), word) AS ws FROM top)
SELECT doc_id, md5(list_reduce(list_prepend(text, ws), lambda a, x: replace(a, x, '***redacted***'))) AS redacted FROM documents, l""")
def _(t):
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{8,}"), F.lit(0))).alias("w")).groupBy("w").count()
    secrets = [r["w"] for r in words.orderBy(F.desc("count"), "w").limit(20).collect()]  # a fixed number of configured secrets
    return t.documents.select("doc_id", F.md5(S.redact(c("text"), secrets).cast("binary")).alias("redacted"))


_prefix = "CASE i % 6 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '- [ ] ' WHEN 3 THEN '> ' WHEN 4 THEN '1. ' ELSE '' END"


def _markdown(t: Tables) -> DataFrame:
    marks = F.array(*[F.lit(x) for x in ("# ", "- ", "- [ ] ", "> ", "1. ", "")])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.get(marks, i % 6), x))
    return t.documents.select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("h06_line_kinds", """
SELECT doc_id, len([1 FOR x, i IN lines IF (i - 1) % 6 = 0]) AS heading, len([1 FOR x, i IN lines IF (i - 1) % 6 = 2 AND length(x) > 0]) AS task_list, len([1 FOR x, i IN lines IF (i - 1) % 6 IN (1, 4)]) AS list
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def _(t):
    kinds = notes.line_kinds(c("text"))
    return _markdown(t).select("doc_id", kinds.alias("k")).select("doc_id", *[c("k")[x].alias(x) for x in ("heading", "task_list", "list")])


#: The blocks that the marked lines make: one each, as neighbours differ; a blank line without a mark is none.
_MARKED = """m AS (SELECT doc_id, i, trim(x) AS x, CASE i % 6 WHEN 0 THEN 'heading' WHEN 2 THEN 'task_list' WHEN 3 THEN 'quote' WHEN 5 THEN 'paragraph' ELSE 'list' END AS kind
FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE i % 6 <> 5 OR trim(x) <> '')"""


@query("h06_h07_blocks_round_trip", f"""WITH {_MARKED}, w AS (SELECT doc_id, string_agg(CASE i % 6 WHEN 0 THEN '# ' WHEN 1 THEN '- ' WHEN 2 THEN '- [ ] ' WHEN 3 THEN '> ' WHEN 4 THEN '1. ' ELSE '' END || x, chr(10) || chr(10) ORDER BY i) AS text FROM m GROUP BY doc_id)
SELECT doc_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS length FROM w""")
def _(t):
    """Documents whose blocks are read and written: all of them."""
    once = notes.extract_blocks(_markdown(t))
    text = notes.render_blocks(once)
    return text.select("doc_id", F.md5(c("text").cast("binary")).alias("digest"), F.length("text").alias("length"))


@query("d14_block_stats", f"WITH {_MARKED} SELECT kind, count(*) AS n FROM m GROUP BY kind")
def _(t):
    return report.block_stats(notes.extract_blocks(_markdown(t)))


@query("d14_degradations", f"WITH {_MARKED} SELECT DISTINCT doc_id, kind, 'paragraph' AS rendered_as FROM m WHERE kind IN ('quote', 'task_list')")
def _(t):
    """For a writer that knows neither quotes nor tasks."""
    known = [k for k in notes.WRITERS if k not in ("quote", "task_list")]
    return report.degradations(notes.extract_blocks(_markdown(t)), known, ("doc_id",))


@query("b22_redact_all", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{12,}')) AS word FROM documents),
l AS (SELECT list(word ORDER BY -length(word), word) AS ws FROM (SELECT word FROM w UNION SELECT 'redacted' UNION SELECT '***redac'))
SELECT doc_id, md5(list_reduce(list_prepend(text, ws), lambda a, x: replace(a, x, '***redacted***'))) AS redacted FROM documents, l""")
def _(t):
    """Every long word is a secret, and two are parts of the mask."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0))).alias("w")).distinct()
    secrets = words.union(t.spark.createDataFrame([("redacted",), ("***redac",)], "w string"))  # the configured secrets
    return S.redact_all(t.documents.select("doc_id", "text"), "text", secrets).select("doc_id", F.md5(c("text").cast("binary")).alias("redacted"))


@query("b21_normalize_callouts", r"""
WITH l AS (SELECT doc_id, i, x, i // 6 AS g, trim(x, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM (SELECT doc_id, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM (SELECT doc_id, string_split(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), chr(10)) AS lines FROM documents))),
m AS (SELECT *, bool_or(starts_with(t, '---') OR starts_with(t, '<span') OR starts_with(t, '###')) OVER w AS ended, bool_and(t = '') OVER w AS blank FROM l WINDOW w AS (PARTITION BY doc_id, g ORDER BY i)),
o AS (SELECT doc_id, i, CASE i % 12 WHEN 0 THEN '> [!example] Boxed Passage' || chr(10) WHEN 3 THEN '---' || chr(10) WHEN 6 THEN '> [!note] Margin Note' || chr(10) WHEN 9 THEN '### Next' || chr(10) ELSE '' END
    || CASE WHEN i % 6 < 3 AND NOT ended AND blank THEN '' WHEN i % 6 >= 3 OR ended THEN x || chr(10) WHEN t = '' THEN '>' || chr(10) WHEN starts_with(t, '>') THEN x || chr(10) ELSE '> ' || x || chr(10) END AS y FROM m)
SELECT doc_id, md5(regexp_replace(regexp_replace(string_agg(y, '' ORDER BY i), '>\s*\n(> \[!)', chr(10) || chr(10) || '\1', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM o GROUP BY doc_id""".replace("\\\\", "\\"))
def _(t):
    """Every document, with a passage's header or its end before each third line."""
    heads = F.array(*[F.lit(x) for x in ("[Boxed passage]:\n", "---\n", "**Margin note**\n", "### Next\n")])
    lines = F.split(F.rtrim(c("text"), F.lit("\t\n\x0b\f\r ")), "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 0, F.concat(F.get(heads, F.floor(i / 3) % 4), x)).otherwise(x)), "\n")
    return t.documents.select("doc_id", F.md5(T.normalize_callouts(F.concat(F.lit("```markdown\n"), marked, F.lit("\n```"))).cast("binary")).alias("digest"))


@query("b24_b31_segments", """
SELECT doc_id, string_agg('<!-- docsync:begin page-' || (idx + 1) || ' h=' || substr(sha256(trim(text, ' ' || chr(10))), 1, 8) || ' -->' || chr(10) || trim(text, ' ' || chr(10)) || chr(10) || '<!-- docsync:end page-' || (idx + 1) || ' -->', chr(10) || chr(10) ORDER BY idx) AS body
FROM (SELECT doc_id, idx, CASE WHEN error IS NULL THEN text ELSE '> [!warning] Page not transcribed' || chr(10) || '> ' || error END AS text FROM b_pages) GROUP BY doc_id""")
def _(t):
    return notes.page_blocks(t.b_pages).select("doc_id", T.render_segments(c("segments")).alias("body"))


@query("b27_b28_frontmatter", """
SELECT o_orderkey, 'N' || o_orderkey AS name, CAST('a,' || (o_orderkey % 3) AS VARCHAR) AS tags, 'other: kept' AS other, 'body' AS body, o_orderkey % 2 = 0 AS generated,
  'docsync_id: ' || o_orderkey || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '  - ' || (o_orderkey % 3) AS rendered FROM orders""")
def _(t):
    key = c("o_orderkey").cast("string")
    kind = F.when(c("o_orderkey") % 2 == 0, "source: docsync/x\n").otherwise("source: mine\n")
    tags = F.when(c("o_orderkey") % 5 == 0, F.concat(F.lit("tags: [a, '"), (c("o_orderkey") % 3).cast("string"), F.lit("']\n"))).otherwise(F.concat(F.lit("tags:\n  - a\n  - \""), (c("o_orderkey") % 3).cast("string"), F.lit("\"\n")))
    note = F.concat(F.lit("---\n"), kind, tags, F.lit("Document: 'N"), key, F.lit("'\nother: kept\n---\n\nbody"))
    rows = t.orders.select("o_orderkey", T.split_frontmatter(note).alias("x")).select("o_orderkey", "x.front", "x.body")
    found = T.frontmatter_list(c("front"), "tags")
    return rows.select("o_orderkey", T.frontmatter_value(c("front"), "document").alias("name"), F.array_join(found, ",").alias("tags"), F.array_join(T.foreign_frontmatter(c("front")), "|").alias("other"), "body", T.looks_generated(c("front")).alias("generated"), T.render_frontmatter({"docsync_id": key}, {"tags": found}).alias("rendered"))


# --- listings, selection, state ----------------------------------------------------------------

_WALK = """WITH RECURSIVE f AS (SELECT id, name, parent FROM b_listing WHERE doc_type = 'CollectionType'),
walk(id, parts) AS (
  SELECT id, CASE WHEN parent = 'trash' THEN ['[TRASH]', name] ELSE [name] END FROM f WHERE parent NOT IN (SELECT id FROM f)
  UNION ALL SELECT f.id, list_append(w.parts, f.name) FROM walk w JOIN f ON f.parent = w.id),
docs AS (SELECT l.*, coalesce(w.parts, CASE WHEN l.parent = 'trash' THEN ['[TRASH]'] END, []) AS parts FROM b_listing l LEFT JOIN walk w ON w.id = l.parent WHERE doc_type <> 'CollectionType')"""


@query("c01_resolve_folders", _WALK + " SELECT id, array_to_string(parts, ' / ') AS folder, starts_with(array_to_string(parts, ' / '), '[TRASH]') AS trashed FROM docs")
def _(t):
    docs = hierarchy.with_folders(t.b_listing)
    return docs.select("id", S.folder_label(c("folder_parts")).alias("folder"), S.is_trashed(F.lit(False), c("folder_parts")).alias("trashed"))


@query("c01_move_folders", """
WITH RECURSIVE f AS (
  SELECT 'R' || r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 'First' ELSE trim(r_name) END AS name, '' AS parent FROM region WHERE r_regionkey <> 3
  UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN trim(n_name) || ' II' ELSE trim(n_name) END, CASE WHEN n_nationkey % 4 = 0 THEN 'N' || (n_nationkey + 1) WHEN n_nationkey % 8 = 7 THEN 'trash' ELSE 'R' || n_regionkey END FROM nation
  UNION ALL SELECT 'R9', 'Ninth', 'N1'),
w AS (SELECT id, CASE WHEN parent = 'trash' THEN '[TRASH] / ' ELSE '' END || name AS path FROM f WHERE parent NOT IN (SELECT id FROM f)
  UNION ALL SELECT f.id, w.path || ' / ' || f.name FROM f JOIN w ON f.parent = w.id)
SELECT id, path FROM f LEFT JOIN w USING (id)""")
def _(t):
    """Folder paths after moves, renamings, a removal and a new folder, each worked out from the paths before; then all taken together."""
    paths = scratch.written(hierarchy.folder_paths(t.b_listing))
    rows = lambda df, *c: df.select(*c, F.lit(False).alias("deleted"))
    moved = rows(t.nation.filter("n_nationkey % 4 = 0"), F.expr("concat('N', n_nationkey) as id"), F.expr("concat(n_name, ' II') as name"), F.expr("concat('N', n_nationkey + 1) as parent"))
    named = rows(t.region.filter("r_regionkey = 0"), F.expr("concat('R', r_regionkey) as id"), F.lit("First").alias("name"), F.lit("").alias("parent"))
    gone = t.region.filter("r_regionkey = 3").selectExpr("concat('R', r_regionkey) as id", "r_name as name", "'' as parent", "true as deleted")
    new = rows(t.region.filter("r_regionkey = 1"), F.lit("R9").alias("id"), F.lit("Ninth").alias("name"), F.lit("N1").alias("parent"))
    for changes in (moved, named.union(gone), new):
        paths = scratch.written(hierarchy.move_folders(paths, changes))
    return paths.select("id", S.folder_label(c("parts")).alias("path"))


_MATRIX = """m AS (
  SELECT d.id AS doc_id, e.destination, p.doc_id IS NULL OR p.version IS DISTINCT FROM d.hash OR coalesce(p.recipe, '') <> 'r1' OR coalesce(p.pages_failed, 0) <> 0 AS owes
  FROM docs d CROSS JOIN (SELECT * FROM b_destinations WHERE enabled) e LEFT JOIN b_publications p ON p.doc_id = d.id AND p.destination = e.destination AND p.profile = 'default')"""


def _docs(t: Tables) -> DataFrame:
    return t.b_documents.select(c("id").alias("doc_id"), "version", F.lit("notebook").alias("source"))


def _enabled(t: Tables) -> DataFrame:
    return t.b_destinations.filter("enabled")


@query("c02_pending_matrix", "WITH docs AS (SELECT id, version AS hash FROM b_documents), " + _MATRIX + " SELECT doc_id, destination, owes FROM m")
def _(t):
    return selection.pending_matrix(_docs(t), _enabled(t), t.b_publications, t.b_recipes).select("doc_id", "destination", "owes")


@query("c03_note_exists", "SELECT p.doc_id, p.destination, n.target IS NOT NULL AS note_present FROM b_publications p LEFT JOIN (SELECT DISTINCT destination, target FROM b_publications WHERE run_id % 13 = 0) n ON n.destination = p.destination AND n.target = p.target")
def _(t):
    index = t.b_publications.filter("run_id % 13 = 0").select("destination", "target").distinct().withColumn("readable", F.lit(True))
    return selection.note_exists(t.b_publications, index).select("doc_id", "destination", "note_present")


@query("c04_orphans", "SELECT DISTINCT p.doc_id, coalesce(d.name, p.doc_id) AS name FROM b_publications p LEFT JOIN b_documents d ON d.id = p.doc_id WHERE NOT EXISTS (SELECT 1 FROM b_listing_live l WHERE l.id = p.doc_id)")
def _(t):
    return selection.orphans(t.b_publications, t.b_listing_live, t.b_documents)


_TAGS = "list_filter"


@query("g01_distinct_tags", "SELECT doc_id, CASE WHEN unreadable THEN NULL ELSE replace(t1, ' ', '-') || CASE WHEN lower(t2) = lower(t1) THEN '' ELSE ',' || replace(t2, ' ', '-') END END AS tags FROM b_tags")
def _(t):
    return t.b_tags.select("doc_id", F.when(~c("unreadable"), F.array_join(selection.distinct_tags(F.array("t1", "t2", "t3", F.lit(" "), F.lit("#"))), ",")).alias("tags"))


@query("g01_extract_tags", "SELECT doc_id, t1 || ',x' || ',' || replace(t2, ' ', '-') AS tags FROM b_tags")
def _(t):
    content = F.to_json(F.struct(F.array(F.struct(c("t1").alias("name")), F.struct(F.lit("x").alias("name"))).alias("tags"), F.array(c("t2"), c("t3")).alias("pageTags")))
    return t.b_tags.select("doc_id", F.array_join(selection.extract_tags(content), ",").alias("tags"))


@query("g02_tag_filter", "SELECT doc_id, unreadable OR lower(t1) = 'building' OR lower(t2) = 'france' AS passes FROM b_tags")
def _(t):
    tags = F.when(~c("unreadable"), F.array("t1", "t2"))
    return t.b_tags.select("doc_id", selection.tag_filter(tags, ["#Building", "FRANCE", " "]).alias("passes"))


@query("g03_merge_tags", "SELECT doc_id, 'sync,' || t1 || ',' || replace(t2, ' ', '-') || ',own' AS tags FROM b_tags")
def _(t):
    return t.b_tags.select("doc_id", F.array_join(selection.merge_tags(F.array(F.lit("sync")), F.array("t1", "t2"), F.array(c("t3"), F.lit("SYNC"), F.lit("own"))), ",").alias("tags"))


_SELECT = _WALK + ", docs2 AS (SELECT *, CASE WHEN lower(file_type) IN ('pdf', 'epub') THEN file_type ELSE 'notebook' END AS source, array_to_string(parts, ' / ') AS folder FROM docs WHERE trim(name) <> ''), " + _MATRIX + """,
owed AS (SELECT doc_id, bool_or(owes) AS owes FROM m GROUP BY doc_id),
j AS (SELECT d.*, CASE WHEN starts_with(folder, '[TRASH]') THEN 'trash' WHEN len([x FOR x IN parts IF lower(x) = 'asia']) > 0 THEN 'excluded' WHEN source NOT IN ('pdf', 'notebook') THEN 'wrong_type'
        WHEN NOT o.owes THEN 'unchanged' WHEN NOT (t.unreadable OR lower(t.t1) IN ('automobile', 'machinery')) THEN 'no_matching_tag' END AS reason
      FROM docs2 d JOIN owed o ON o.doc_id = d.id JOIN b_tags t ON t.doc_id = d.id)
"""
_CRITERIA = selection.Criteria(excluded=("Asia",), types=("pdf", "notebook"), tags=("automobile", "Machinery"), limit=50)


def _selected(t: Tables, criteria: selection.Criteria = _CRITERIA) -> DataFrame:
    tags = t.b_tags.select("doc_id", F.when(~c("unreadable"), F.array("t1")).alias("tags"))
    return selection.select_documents(t.b_listing, criteria, _enabled(t), t.b_publications, t.b_recipes, tags)


@query("h01_select_documents", _SELECT + "SELECT id AS doc_id, folder, source, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason ORDER BY ord) <= 50 THEN 'process' ELSE 'deferred' END) AS decision FROM j")
def _(t):
    return _selected(t).select("doc_id", "folder", "source", "decision")


@query("h01_select_target", _WALK + "SELECT id AS doc_id, CASE WHEN starts_with(array_to_string(parts, ' / '), '[TRASH]') THEN 'trash' WHEN NOT (contains(lower(name), '00007') OR len(parts) > 0 AND contains(lower(array_to_string(parts, '/') || '/' || name), '00007')) THEN 'not_targeted' ELSE 'process' END AS decision FROM docs".replace("SELECT id AS doc_id", " SELECT id AS doc_id"))
def _(t):
    return _selected(t, selection.Criteria(target="00007", limit=1, types=("epub",))).select("doc_id", "decision")


@query("e01_apply_limit", "SELECT id AS doc_id, row_number() OVER (ORDER BY ord, id) <= 100 AS kept FROM b_listing")
def _(t):
    return selection.apply_limit(t.b_listing.select(c("id").alias("doc_id"), "ord"), 100).select("doc_id", "kept")


@query("d09_pending_totals", _SELECT + "SELECT count(*) FILTER (WHERE reason IS NULL OR reason IN ('unchanged', 'no_matching_tag')) AS considered, count(*) FILTER (WHERE reason IS NULL) AS pending FROM j")
def _(t):
    return report.pending_totals(_selected(t))


@query("d08_skips_by_type", _SELECT + "SELECT source, count(*) AS n FROM j WHERE reason = 'wrong_type' GROUP BY source")
def _(t):
    return report.skips_by_type(_selected(t))


@query("c08_comparison_rows", _SELECT + ", k AS (SELECT id, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason ORDER BY ord) <= 50 THEN 'process' ELSE 'deferred' END) AS decision, folder, source FROM j), p AS (SELECT doc_id, string_agg(destination || '=' || version, ',' ORDER BY destination) AS published FROM b_publications GROUP BY doc_id) SELECT k.id, coalesce(nullif(k.folder, ''), d.folder) AS folder, k.source AS doc_type, decision, p.published FROM k JOIN b_documents d ON d.id = k.id LEFT JOIN p ON p.doc_id = k.id")
def _(t):
    rows = state.comparison_rows(_selected(t), t.b_publications, t.b_documents)
    shown = F.array_join(F.transform(F.map_entries("published"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return rows.select("id", "folder", "doc_type", "decision", shown.alias("published"))


@query("c09_find_documents", "SELECT id, name FROM b_documents WHERE lower(name) = 'customer#000000007' OR lower(folder || '/' || name) = 'customer#000000007'")
def _(t):
    return selection.find_documents(t.b_documents, "/Customer#000000007/").select("id", "name")


@query("c15_publish_context", "SELECT d.id AS doc_id, e.destination, p.external_id, p.target, p.doc_id IS NOT NULL AND p.external_id IS NULL AS adopt_by_name FROM b_documents d CROSS JOIN b_destinations e LEFT JOIN b_publications p ON p.doc_id = d.id AND p.destination = e.destination")
def _(t):
    return state.publish_context(t.b_documents.select(c("id").alias("doc_id")), t.b_destinations, t.b_publications).select("doc_id", "destination", "external_id", "target", "adopt_by_name")


@query("c07_upsert_publications", """
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.destination, o.destination) AS destination, CASE WHEN n.doc_id IS NOT NULL THEN 'v2' ELSE o.version END AS version,
  coalesce(n.external_id, o.external_id) AS external_id, coalesce(o.first_published_at, n.first_published_at) AS first_published_at
FROM (SELECT * FROM b_publications WHERE run_id % 4 > 0) o FULL JOIN (SELECT * FROM b_publications WHERE run_id % 3 > 0) n ON n.doc_id = o.doc_id AND n.destination = o.destination""")
def _(t):
    new = t.b_publications.filter("run_id % 3 > 0").withColumn("version", F.lit("v2"))
    return state.upsert_publications(t.b_publications.filter("run_id % 4 > 0"), new).select("doc_id", "destination", "version", "external_id", "first_published_at")


@query("c07_upsert_pages", """
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.page_index, o.page_index) AS page_index, coalesce(n.source_hash, o.source_hash) AS source_hash, coalesce(n.render_hash, o.render_hash) AS render_hash
FROM (SELECT * FROM b_page_hashes_prev WHERE doc_id % 4 > 0) o FULL JOIN (SELECT * FROM b_page_hashes WHERE page_index % 2 = 1) n ON n.doc_id = o.doc_id AND n.page_index = o.page_index""")
def _(t):
    return state.upsert_pages(t.b_page_hashes_prev.filter("doc_id % 4 > 0"), t.b_page_hashes.filter("page_index % 2 = 1"))


def _table(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


@query("c07_upsert_bucketed", """
SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.page_index, o.page_index) AS page_index, coalesce(n.source_hash, o.source_hash) AS source_hash, coalesce(n.render_hash, o.render_hash) AS render_hash
FROM (SELECT * FROM b_page_hashes_prev WHERE doc_id % 4 > 0) o FULL JOIN (SELECT * FROM b_page_hashes WHERE page_index % 2 = 1) n ON n.doc_id = o.doc_id AND n.page_index = o.page_index""")
def _(t):
    """The same in bucketed tables, in two batches; the second one ends with a new snapshot of that name."""
    stored, name, keys = tables.BucketedState(t.spark, 8), _table("page_hashes"), ["doc_id", "page_index"]
    stored.save(name, t.b_page_hashes_prev.filter("doc_id % 4 > 0"), keys)
    for batch in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        stored.upsert(name, t.b_page_hashes.filter(f"page_index % 2 = 1 and {batch}"), keys)
    found = scratch.written(stored.load(name))
    t.spark.sql(f"DROP TABLE {name}")
    return found


@query("c07_upsert_device", "SELECT id, CASE WHEN id % 3 = 0 THEN 'new ' || machine ELSE machine END AS machine FROM b_machines WHERE id % 5 > 0 OR id % 3 = 0")
def _(t):
    new = t.b_machines.filter("id % 3 = 0").withColumn("machine", F.concat(F.lit("new "), "machine"))
    return state.upsert_device(t.b_machines.filter("id % 5 > 0"), new)


@query("c07_upsert_documents", "SELECT coalesce(n.id, o.id) AS id, coalesce(n.version, o.version) AS version, o.last_error FROM (SELECT * FROM b_documents WHERE seen_run_id % 3 > 0) o FULL JOIN (SELECT id, 'new' AS version FROM b_documents WHERE seen_run_id % 5 > 0) n ON n.id = o.id".replace("o.last_error", "CASE WHEN o.id IS NOT NULL THEN o.last_error END AS last_error"))
def _(t):
    new = t.b_documents.filter("seen_run_id % 5 > 0").select("id", "name", "folder", "doc_type", F.lit("new").alias("version"), "seen_run_id", F.lit(None).cast("string").alias("last_error"))
    return state.upsert_documents(t.b_documents.filter("seen_run_id % 3 > 0"), new).select("id", "version", "last_error")


@query("c07_record_failure", "SELECT id, CASE WHEN seen_run_id % 10 = 0 THEN 'boom' WHEN seen_run_id % 37 = 0 THEN NULL ELSE last_error END AS last_error FROM b_documents")
def _(t):
    marks = t.b_documents.filter("seen_run_id % 10 = 0 or seen_run_id % 37 = 0").select("id", F.when(c("seen_run_id") % 10 == 0, "boom").alias("last_error"))
    return state.record_failure(t.b_documents, marks).select("id", "last_error")


@query("g04_forget", "SELECT doc_id, destination FROM b_publications WHERE NOT (run_id % 2 = 0 AND destination = '2-HIGH' AND doc_id IN (SELECT id FROM b_documents WHERE seen_run_id % 6 = 0)) AND NOT (destination = '2-HIGH' AND doc_id IN (SELECT id FROM b_documents WHERE seen_run_id % 6 = 0))")
def _(t):
    return state.forget(t.b_publications, t.b_documents.filter("seen_run_id % 6 = 0").select("id"), "2-HIGH").select("doc_id", "destination")


@query("d06_unknown_destinations", "SELECT destination, count(*) AS n FROM b_publications WHERE destination NOT IN ('1-URGENT', '2-HIGH') GROUP BY destination")
def _(t):
    return state.publications_by_destination_unknown(t.b_publications, ["1-URGENT", "2-HIGH"])[0]


@query("d07_publications_by_document", "SELECT doc_id, string_agg(destination || ':' || version || ':' || run_id, ' ' ORDER BY destination) AS published FROM b_publications GROUP BY doc_id")
def _(t):
    shown = F.transform(F.map_entries("published"), lambda x: F.concat_ws(":", x["key"], x["value"]["version"], x["value"]["run_id"].cast("string")))
    return state.publications_by_document(t.b_publications).select("doc_id", F.array_join(shown, " ").alias("published"))


_OVERVIEW = """o AS (
  SELECT d.id, d.name, CASE WHEN coalesce(d.last_error, '') <> '' THEN 'failed' WHEN bool_or(p.version IS DISTINCT FROM d.version) AND count(p.doc_id) = 0 THEN 'new' WHEN bool_or(p.version IS DISTINCT FROM d.version) THEN 'changed' ELSE 'up_to_date' END AS status
  FROM b_documents d CROSS JOIN (SELECT * FROM b_destinations WHERE enabled) e LEFT JOIN b_publications p ON p.doc_id = d.id AND p.destination = e.destination GROUP BY d.id, d.name, d.last_error)"""


def _overview(t: Tables) -> DataFrame:
    return state.sync_overview(t.b_documents, t.b_publications, t.b_destinations)


@query("h02_sync_overview", f"WITH {_OVERVIEW} SELECT id, name, status FROM o")
def _(t):
    return _overview(t)


@query("flagship_status_by_folder", _WALK + f", {_OVERVIEW} SELECT array_to_string(parts, ' / ') AS folder, status, count(*) AS n FROM docs JOIN o USING (id) GROUP BY ALL")
def _(t):
    folders = hierarchy.with_folders(t.b_listing).select("id", S.folder_label(c("folder_parts")).alias("folder"))
    return folders.join(_overview(t).select("id", "status"), "id").groupBy("folder", "status").agg(F.count("*").alias("n"))


@query("d01_count_by_status", f"WITH {_OVERVIEW} SELECT s.status, count(o.id) AS n FROM (SELECT unnest(['failed', 'new', 'changed', 'up_to_date']) AS status) s LEFT JOIN o USING (status) GROUP BY s.status")
def _(t):
    return report.count_by_status(_overview(t))


@query("f01_comparison_top", f"WITH {_OVERVIEW} SELECT id, status, greatest(count(*) OVER () - 10, 0) AS held_back FROM o ORDER BY list_position(['failed', 'new', 'changed', 'up_to_date'], status), CAST(substr(id, 2) AS BIGINT) LIMIT 10")
def _(t):
    rows = _overview(t).withColumn("ord", F.substring("id", 2, 20).cast("long"))
    return report.comparison_top(rows).select("id", "status", "held_back")


@query("f02_all_documents", "SELECT id, name FROM b_documents ORDER BY seen_run_id DESC, id")
def _(t):
    return state.all_documents(t.b_documents).select("id", "name")


@query("f03_listing_limit", "SELECT id, ord FROM b_listing WHERE doc_type = 'DocumentType' ORDER BY ord LIMIT 25")
def _(t):
    return t.b_listing.filter(S.is_document(c("doc_type"), c("name"))).orderBy("ord").limit(25).select("id", "ord")


@query("e03_latest", "SELECT id, device FROM b_runs QUALIFY row_number() OVER (PARTITION BY device ORDER BY started_at DESC, id DESC) = 1")
def _(t):
    return selection.latest(t.b_runs, ["device"], F.desc("started_at"), F.desc("id")).select("id", "device")


@query("e06_last_runs", "SELECT device, max(id) AS id FROM b_runs WHERE trigger_kind = 'scheduled' GROUP BY device")
def _(t):
    return state.last_run(t.b_runs, scheduled=True, by="device").select("device", "id")


@query("e06_recent_runs", "SELECT device, id FROM b_runs QUALIFY row_number() OVER (PARTITION BY device ORDER BY id DESC) <= 3")
def _(t):
    return state.recent_runs(t.b_runs, 3, by="device").select("device", "id")


@query("d11_runs_since", "SELECT count(*) AS n FROM b_runs WHERE started_at >= TIMESTAMP '2024-01-15'")
def _(t):
    return state.runs_since(t.b_runs, F.lit("2024-01-15").cast("timestamp_ntz"))


@query("d11_table_counts", "SELECT 'documents' AS table_name, count(*) AS n FROM b_documents UNION ALL SELECT 'publications', count(*) FROM b_publications UNION ALL SELECT 'runs', count(*) FROM b_runs")
def _(t):
    return state.table_counts({"documents": t.b_documents, "publications": t.b_publications, "runs": t.b_runs})


# --- cache ---------------------------------------------------------------------------------------

_HIT = "SELECT d.doc_id, k.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT x.text, 1 AS doc_id FROM documents x JOIN b_cache USING (doc_id)) k ON k.text = d.text"


def _cache(t: Tables) -> DataFrame:
    rows = t.b_cache.join(t.documents.select("doc_id", "text"), "doc_id")
    return rows.groupBy(S.content_key(c("text"), c("fingerprint")).alias("key")).agg(F.max("size").alias("size"), F.max("last_used_day").alias("last_used_day"), F.lit("done").alias("payload"))


@query("c05_cache_lookup", _HIT)
def _(t):
    return memo.cache_lookup(t.documents.select("doc_id", S.content_key(c("text"), F.lit("fp1")).alias("key")), _cache(t)).select("doc_id", "hit")


@query("d03_cache_hit_rate", f"SELECT avg(CAST(hit AS INTEGER)) AS rate FROM ({_HIT})")
def _(t):
    looked = memo.cache_lookup(t.documents.select(S.content_key(c("text"), F.lit("fp1")).alias("key")), _cache(t))
    return looked.agg(memo.cache_hit_rate(F.count_if("hit"), F.count_if(~c("hit"))).alias("rate"))


@query("d05_cache_stats", "SELECT fingerprint, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM b_cache GROUP BY fingerprint")
def _(t):
    return memo.cache_stats(t.b_cache, "fingerprint")


@query("g05_prune_cache", "SELECT doc_id, size FROM b_cache WHERE last_used_day >= 300 - 90")
def _(t):
    return memo.prune_cache(t.b_cache, 90, F.lit(300)).select("doc_id", "size")


@query("c05_cache_by_shard", f"""
WITH e AS (SELECT x.text, max(last_used_day) AS day FROM documents x JOIN b_cache USING (doc_id) GROUP BY x.text),
n AS (SELECT text, CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'en') THEN 400 ELSE day END AS day FROM e)
SELECT d.doc_id, k.text IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT text FROM n WHERE day >= 400 - 90) k ON k.text = d.text""")
def _(t):
    """Entries that English documents hit are renewed, old ones go, and all documents are looked up in what is left."""
    table = tables.CacheTable.create(_table("cache"), _cache(t))
    keyed = t.documents.select("doc_id", "lang", S.content_key(c("text"), F.lit("fp1")).alias("key"))
    table.touch(keyed.filter("lang = 'en'"), F.lit(400))
    table.prune(90, 400)
    found = scratch.written(table.lookup(keyed).select("doc_id", "hit"))
    t.spark.sql(f"DROP TABLE {table.name}")
    return found


@query("g05_touch_on_hit", f"SELECT md5(text) AS content, CAST(CASE WHEN bool_or(lang = 'en') THEN 400 ELSE day END AS INTEGER) AS last_used_day FROM documents JOIN (SELECT x.text, max(last_used_day) AS day FROM documents x JOIN b_cache USING (doc_id) GROUP BY x.text) USING (text) GROUP BY text, day")
def _(t):
    """Entries that English documents hit are renewed."""
    own = t.documents.select(S.content_key(c("text"), F.lit("fp1")).alias("key"), "lang", F.md5(c("text").cast("binary")).alias("content"))
    cache = _cache(t)
    renewed = memo.touch(cache, memo.cache_lookup(own.filter("lang = 'en'"), cache).filter("hit"), F.lit(400))
    return renewed.join(own.select("key", "content").distinct(), "key").select("content", "last_used_day")


@query("h03_memo_stats", f"SELECT count(*) FILTER (WHERE hit AND trim(text, ' ' || chr(10)) <> '') AS hits, count(*) FILTER (WHERE trim(text, ' ' || chr(10)) = '') AS blanks, count(*) FILTER (WHERE NOT hit AND trim(text, ' ' || chr(10)) <> '') AS calls, count(*) FILTER (WHERE NOT hit AND text LIKE '%a%' AND trim(text, ' ' || chr(10)) <> '' AND length(text) % 2 = 0) AS errors FROM ({_HIT}) JOIN documents USING (doc_id)")
def _(t):
    """Texts of an even length with an a in them can't be worked out."""

    def digest(text: str) -> str:
        if "a" in text and len(text) % 2 == 0:
            raise ValueError("of an even length")
        return str(len(text))

    return memo.memo_stats(memo.apply_memoized(t.documents.select("doc_id", "text"), F.lit("fp1"), digest, _cache(t), scratch.written))


@query("h03_apply_memoized", f"SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN '' WHEN hit THEN 'done' ELSE sha256(text) END AS result, CASE WHEN trim(text, ' ' || chr(10)) = '' THEN 'blank' WHEN hit THEN 'cache' ELSE 'computed' END AS source FROM ({_HIT}) JOIN documents USING (doc_id)")
def _(t):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    out = memo.apply_memoized(t.documents.select("doc_id", "text"), F.lit("fp1"), digest, _cache(t), scratch.written)
    return out.select("doc_id", "result", "source")


# --- pages ---------------------------------------------------------------------------------------


def _content(t: Tables) -> DataFrame:
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "page"))), lambda x: x["page"]), ",")
    rows = t.b_content_pages.groupBy("doc_id").agg(listed.alias("list"))
    flat = F.concat(F.lit('{"pages":['), "list", F.lit("]}"))
    deep = F.concat(F.lit('{"cPages":{"pages":['), "list", F.lit(']},"pages":["never"]}'))
    return rows.select("doc_id", F.when(c("doc_id") % 2 == 0, flat).otherwise(deep).alias("content"))


_PAGES = """pg AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS place, 'p' || pos AS page_id, pos = 3 AS deleted,
  CASE WHEN pos = 3 THEN 9 WHEN pos % 2 = 0 OR pos = 1 THEN NULL ELSE CAST(pos + 1 AS INTEGER) END AS redir FROM b_content_pages)"""


@query("a05_b13_flatten_page_list", f"WITH {_PAGES} SELECT doc_id, place AS pos, page_id, deleted, redir FROM pg")
def _(t):
    return pages.flatten_page_list(_content(t))


def _members(t: Tables) -> DataFrame:
    some = t.b_content_pages.filter("(doc_id + pos) % 5 <> 0").select("doc_id", F.concat(F.lit("p"), c("pos").cast("string")).alias("page_id"))
    rows = some.union(t.b_content_pages.select("doc_id", F.lit("zz")).distinct())
    return rows.withColumn("member", F.concat("page_id", F.lit(".rm")))


_MEMBERS = "mem AS (SELECT doc_id, 'p' || pos AS page_id FROM b_content_pages WHERE (doc_id + pos) % 5 <> 0 UNION SELECT DISTINCT doc_id, 'zz' FROM b_content_pages)"


@query("c13_annotated_pages", f"WITH {_PAGES}, {_MEMBERS}, kept AS (SELECT m.doc_id, coalesce(redir, place) AS idx, m.page_id FROM mem m JOIN pg USING (doc_id, page_id) WHERE NOT deleted) SELECT doc_id, CAST(idx AS INTEGER) AS idx, page_id FROM kept UNION ALL SELECT m.doc_id, CAST((SELECT count(*) FROM kept k WHERE k.doc_id = m.doc_id) AS INTEGER), m.page_id FROM mem m WHERE page_id = 'zz'")
def _(t):
    return pages.annotated_pages(pages.flatten_page_list(_content(t)), _members(t)).select("doc_id", "idx", "page_id")


@query("c14_ordered_pages", f"WITH {_PAGES}, {_MEMBERS} SELECT m.doc_id, CAST(row_number() OVER (PARTITION BY m.doc_id ORDER BY place NULLS LAST, m.page_id) - 1 AS INTEGER) AS ordinal, m.page_id FROM mem m LEFT JOIN pg USING (doc_id, page_id) WHERE NOT coalesce(deleted, false)")
def _(t):
    return pages.ordered_pages(pages.flatten_page_list(_content(t)), _members(t)).select("doc_id", "ordinal", "page_id")


@query("d12_pages_per_document", f"WITH {_PAGES}, {_MEMBERS} SELECT m.doc_id, count(*) AS pages FROM mem m LEFT JOIN pg USING (doc_id, page_id) WHERE NOT coalesce(deleted, false) GROUP BY m.doc_id")
def _(t):
    return pages.pages_per_document(pages.flatten_page_list(_content(t)), _members(t))


_DRIFT = "SELECT doc_id, 'moved' AS kind, count(*) AS n FROM b_page_hashes c JOIN b_page_hashes_prev p USING (doc_id, page_index) WHERE c.source_hash = p.source_hash AND c.render_hash <> p.render_hash GROUP BY doc_id"
_BLANK = "SELECT doc_id, 'blank' AS kind, CAST(max(k) AS BIGINT) AS n FROM (SELECT doc_id, count(*) AS k FROM b_page_hashes GROUP BY doc_id, render_hash) GROUP BY doc_id HAVING sum(k) >= 3 AND max(k) >= greatest(3, sum(k) // 2)"


@query("c11_page_drift", f"SELECT doc_id, n AS moved FROM ({_DRIFT})")
def _(t):
    return pages.page_drift(t.b_page_hashes, t.b_page_hashes_prev)


@query("d04_blank_page_groups", f"SELECT doc_id, n AS same FROM ({_BLANK})")
def _(t):
    return pages.blank_page_groups(t.b_page_hashes).select("doc_id", "same")


@query("h09_detect_anomalies", f"{_DRIFT} UNION ALL {_BLANK}")
def _(t):
    return pages.detect_anomalies(t.b_page_hashes, t.b_page_hashes_prev)


@query("c12_breadcrumbs", """
WITH e AS (SELECT *, max(page) OVER (PARTITION BY doc_id ORDER BY ord) AS from_page FROM b_toc),
s AS (SELECT p.doc_id, p.page, e.ord, e.level, e.title FROM (SELECT DISTINCT doc_id, page FROM b_toc) p JOIN e ON e.doc_id = p.doc_id AND e.from_page <= p.page),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.page = s.page AND x.ord > s.ord AND x.level <= s.level))
SELECT doc_id, page, string_agg(title, ' > ' ORDER BY level) AS trail FROM k WHERE title <> '' GROUP BY doc_id, page""")
def _(t):
    found = pages.breadcrumbs(t.b_toc.select("doc_id", "page"), t.b_toc)
    return found.filter(F.size("breadcrumbs") > 0).select("doc_id", "page", F.array_join("breadcrumbs", " > ").alias("trail"))


@query("d10_judge_documents", """
SELECT doc_id, CASE WHEN bool_and(error IS NOT NULL AND blank) THEN 'failed' WHEN bool_and(blank) AND NOT bool_or(error IS NOT NULL) THEN 'skipped' ELSE 'publish' END AS verdict
FROM (SELECT *, trim(text, ' ' || chr(10)) = '' AS blank FROM b_pages) GROUP BY doc_id""")
def _(t):
    docs = t.b_pages.select("doc_id").distinct().withColumn("has_text", F.lit(False))
    return pages.judge_documents(docs, t.b_pages)


@query("b32_page_facts", "SELECT doc_id, bool_or(trim(text, ' ' || chr(10)) <> '') AS has_text, count(error) AS failed_pages FROM b_pages GROUP BY doc_id")
def _(t):
    return pages.page_facts(t.b_pages)


@query("e04_number_pages", "SELECT doc_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS INTEGER) AS ordinal, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS INTEGER) AS number FROM b_pages")
def _(t):
    return pages.number_pages(t.b_pages).select("doc_id", "idx", "ordinal", "number")


@query("h10_source_page_keys_pdf", "SELECT conv_id AS doc_id, turn, CASE WHEN conv_id % 5 = 0 THEN '' ELSE sha256(CAST(encode(CAST(turn AS VARCHAR)) || '\\x00'::BLOB || encode(text) AS BLOB)) END AS source_key FROM conversations")
def _(t):
    content = F.when(c("conv_id") % 5 > 0, c("text").cast("binary"))
    rows = t.conversations.select(c("conv_id").alias("doc_id"), "turn", c("turn").alias("pdf_index"), content.alias("content"))
    return pages.source_page_keys(rows, "pdf").select("doc_id", "turn", "source_key")


@query("h10_source_page_keys", "SELECT conv_id AS doc_id, turn, sha256(text) AS source_key FROM conversations")
def _(t):
    rows = t.conversations.select(c("conv_id").alias("doc_id"), "turn", c("turn").alias("pdf_index"), c("text").cast("binary").alias("content"))
    return pages.source_page_keys(rows).select("doc_id", "turn", "source_key")


# --- reports -------------------------------------------------------------------------------------

_TOTALS = """SELECT run_id, count(*) AS seen, count(*) FILTER (WHERE status = 'published') AS published, count(*) FILTER (WHERE status = 'would_publish') AS would_publish, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'deferred') AS deferred, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE pages_failed > 0 AND status IN ('published', 'would_publish')) AS partial,
  CAST(sum(pages_failed) AS BIGINT) AS pages_failed, CAST(sum(transcribed) AS BIGINT) AS transcribed, CAST(sum(cached) AS BIGINT) AS cached, CASE WHEN sum(cached) + sum(transcribed) = 0 THEN NULL ELSE CAST(sum(cached) AS DOUBLE) / CAST(sum(cached) + sum(transcribed) AS DOUBLE) END AS hit_rate FROM b_outcomes GROUP BY run_id"""


@query("d02_run_totals", _TOTALS)
def _(t):
    return report.run_totals(t.b_outcomes)


@query("h11_headline", f"SELECT run_id, CASE WHEN would_publish > 0 AND published = 0 THEN 'Would sync ' || would_publish ELSE 'Synced ' || published END || ' of ' || seen || ' documents' AS headline FROM ({_TOTALS})")
def _(t):
    return report.headline(report.run_totals(t.b_outcomes)).select("run_id", "headline")


@query("h11_run_report", _SELECT + "SELECT id AS doc_id, 'skipped' AS status, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT id, 'deferred', 'deferred' FROM (SELECT id FROM j WHERE reason IS NULL QUALIFY row_number() OVER (ORDER BY ord) > 50) UNION ALL SELECT doc_id, status, reason FROM b_outcomes")
def _(t):
    return report.run_report(_selected(t), t.b_outcomes).select("doc_id", "status", "reason")


@query("d13_run_outcome", """
SELECT run_id, CASE WHEN count(*) FILTER (WHERE status NOT IN ('skipped', 'deferred')) = 0 THEN 'nothing_to_do' WHEN bool_or(status = 'failed') THEN 'partial' ELSE 'success' END AS outcome,
  CASE WHEN bool_or(status = 'failed') THEN coalesce(arg_min(reason, ord) FILTER (WHERE status = 'failed'), count(*) FILTER (WHERE status = 'failed') || ' failed') END AS error FROM b_outcomes GROUP BY run_id""")
def _(t):
    return report.run_outcome(t.b_outcomes)


@query("e05_first_seen_distinct", "SELECT run_id, string_agg(destination, ',' ORDER BY seen_at) AS messages FROM (SELECT run_id, destination, min(ord) AS seen_at FROM b_outcomes GROUP BY run_id, destination) GROUP BY run_id")
def _(t):
    found = report.first_seen_distinct(t.b_outcomes.withColumnRenamed("destination", "message"), "run_id")
    return found.select("run_id", F.array_join("messages", ",").alias("messages"))


@query("a11_report_json", f"SELECT t.run_id, t.seen, t.published, t.partial, d.documents, 'run ' || t.run_id || ' said so' AS warnings FROM ({_TOTALS}) t JOIN (SELECT run_id, md5(string_agg(name || ':' || status || ':' || coalesce(reason, '-'), ',' ORDER BY ord)) AS documents FROM b_outcomes GROUP BY run_id) d USING (run_id)")
def _(t):
    totals = report.run_totals(t.b_outcomes)
    said = totals.select("run_id", F.lit(1).alias("ord"), F.concat(F.lit("run "), c("run_id").cast("string"), F.lit(" said so")).alias("message"))
    made = sinks.report_json(totals, t.b_outcomes, warnings=said)
    read = F.from_json("report", "seen long, published long, partial long, documents array<struct<name:string,status:string,reason:string>>, warnings array<string>")
    line = F.transform("r.documents", lambda x: F.concat_ws(":", x["name"], x["status"], F.coalesce(x["reason"], F.lit("-"))))
    return made.select("run_id", read.alias("r")).select("run_id", "r.seen", "r.published", "r.partial", F.md5(F.array_join(line, ",").cast("binary")).alias("documents"), F.array_join("r.warnings", ",").alias("warnings"))


@query("a10_render_transcripts", """
SELECT doc_id, md5('{"id":' || doc_id || '}' || chr(10) || chr(10) || string_agg('---' || chr(10) || chr(10) || '<span style="font-size: 0.9em; color: #777777"><b>Page ' || (idx + 1) || '</b></span>' || chr(10) || chr(10)
  || CASE WHEN coalesce(error, trim(text, ' ' || chr(10))) = '' THEN '' ELSE coalesce(error, trim(text, ' ' || chr(10))) || chr(10) || chr(10) END, '' ORDER BY idx) || CASE WHEN bool_or(trim(text, ' ' || chr(10)) <> '') THEN '' ELSE 'embedded' || chr(10) END) AS digest
FROM b_pages GROUP BY doc_id""")
def _(t):
    docs = t.b_pages.select("doc_id").distinct().select("doc_id", F.struct(c("doc_id").alias("id")).alias("meta"), F.lit("embedded").alias("body_text"))
    rows = t.b_pages.select("doc_id", (c("idx") + 1).alias("number"), F.lit(None).cast("string").alias("label"), no_files().alias("breadcrumbs"), "text", "error")
    return sinks.render_transcripts(rows, docs).select("doc_id", F.md5(c("transcript").cast("binary")).alias("digest"))


# --- schedules and devices -------------------------------------------------------------------------

_FIRES = "fires AS (SELECT device, CAST(d AS TIMESTAMP) + INTERVAL 9 HOUR AS fire FROM (SELECT DISTINCT device FROM b_runs) CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-28', INTERVAL 1 DAY)) AS d))"


def _fires(t: Tables) -> DataFrame:
    daily = schedule.cron_fires(t.spark, "0 9 * * *", "2024-01-01", "2024-01-29").select(c("fire").cast("timestamp_ntz").alias("fire"))
    return t.b_runs.select("device").distinct().join(F.broadcast(daily), how="cross")


@query("c06_as_of", f"WITH {_FIRES} SELECT r.id, (SELECT max(fire) FROM fires f WHERE f.device = r.device AND f.fire <= r.started_at) AS last_fire, (SELECT min(fire) FROM fires f WHERE f.device = r.device AND f.fire > r.started_at) AS next_fire FROM b_runs r")
def _(t):
    return schedule.as_of(t.b_runs.select("id", "device", c("started_at").alias("t")), _fires(t), "device").select("id", "last_fire", "next_fire")


@query("i01_cron_fires", """
WITH u AS (SELECT user_id AS device, user_id % 3 AS k, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) + 1 AS b FROM events GROUP BY user_id),
s AS (SELECT device, k, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) - INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS x FROM u)
SELECT device, x AS fire FROM s WHERE CASE k WHEN 0 THEN minute(x) IN (0, 30) AND hour(x) BETWEEN 8 AND 17 AND dayofweek(x) BETWEEN 1 AND 5 WHEN 1 THEN minute(x) = 0 AND hour(x) = 9 AND (day(x) IN (1, 15) OR dayofweek(x) = 0) ELSE minute(x) = 15 AND hour(x) % 6 = 0 AND month(x) IN (1, 2, 3, 12) END""")
def _(t):
    """Every device's fires from its first event's day to its last one's."""
    exprs = F.when(c("device") % 3 == 0, "*/30 8-17 * * mon-fri").when(c("device") % 3 == 1, "0 9 1,15 * sun").otherwise("15 */6 * jan-mar,12 *")
    spans = t.events.groupBy(c("user_id").alias("device")).agg(F.to_date(F.min("ts")).alias("start"), F.date_add(F.to_date(F.max("ts")), 1).alias("end"))
    return schedule.fires_of(spans.withColumn("expr", exprs)).select("device", c("fire").cast("timestamp_ntz").alias("fire"))


@query("i01_cron_fires_zones", """
WITH u AS (SELECT user_id AS device, user_id % 2 AS k, ['Europe/Madrid', 'America/St_Johns', 'Australia/Lord_Howe'][1 + user_id % 3] AS zone, CAST(min(ts) AS DATE) AS a FROM events GROUP BY user_id),
x AS (SELECT device, zone, k, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(a AS TIMESTAMP) + INTERVAL 330 DAY - INTERVAL 10 MINUTE, INTERVAL 10 MINUTE)) AS x FROM u),
w AS (SELECT * FROM x WHERE CASE k WHEN 0 THEN minute(x) % 20 = 0 AND hour(x) BETWEEN 1 AND 3 ELSE minute(x) = 30 AND hour(x) = 2 END),
spans(zone, since, until, off) AS (VALUES
  ('Europe/Madrid', TIMESTAMP '2000-01-01', TIMESTAMP '2024-03-31 01:00', 60), ('Europe/Madrid', TIMESTAMP '2024-03-31 01:00', TIMESTAMP '2024-10-27 01:00', 120), ('Europe/Madrid', TIMESTAMP '2024-10-27 01:00', TIMESTAMP '2025-03-01', 60),
  ('America/St_Johns', TIMESTAMP '2000-01-01', TIMESTAMP '2024-03-10 05:30', -210), ('America/St_Johns', TIMESTAMP '2024-03-10 05:30', TIMESTAMP '2024-11-03 04:30', -150), ('America/St_Johns', TIMESTAMP '2024-11-03 04:30', TIMESTAMP '2025-03-01', -210),
  ('Australia/Lord_Howe', TIMESTAMP '2000-01-01', TIMESTAMP '2024-04-06 15:00', 660), ('Australia/Lord_Howe', TIMESTAMP '2024-04-06 15:00', TIMESTAMP '2024-10-05 15:30', 630), ('Australia/Lord_Howe', TIMESTAMP '2024-10-05 15:30', TIMESTAMP '2025-03-01', 660))
SELECT DISTINCT device, coalesce(min(x - to_minutes(off)) FILTER (WHERE x >= since + to_minutes(off) AND x < until + to_minutes(off)), max(until) FILTER (WHERE until + to_minutes(off) <= x)) AS fire FROM w JOIN spans USING (zone) GROUP BY device, x""")
def _(t):
    """Every device's nightly fires on its own wall clock, through both changes of the year."""
    spans = t.events.groupBy(c("user_id").alias("device")).agg(F.to_date(F.min("ts")).alias("start"))
    zone = F.get(F.array(*map(F.lit, ("Europe/Madrid", "America/St_Johns", "Australia/Lord_Howe"))), c("device") % 3)
    spans = spans.withColumns({"end": F.date_add("start", 330), "expr": F.when(c("device") % 2 == 0, "*/20 1-3 * * *").otherwise("30 2 * * *"), "zone": zone})
    return schedule.fires_of(spans, tz=c("zone")).select("device", c("fire").cast("timestamp_ntz").alias("fire"))


@query("i02_missed_fires", f"WITH {_FIRES} SELECT device, fire FROM fires f WHERE NOT EXISTS (SELECT 1 FROM b_runs r WHERE r.device = f.device AND r.started_at >= f.fire AND r.started_at < f.fire + INTERVAL 1 DAY) AND fire < TIMESTAMP '2024-01-28' OR fire >= TIMESTAMP '2024-01-28' AND NOT EXISTS (SELECT 1 FROM b_runs r WHERE r.device = f.device AND r.started_at >= f.fire)")
def _(t):
    return schedule.missed_fires(_fires(t), t.b_runs, "device", latest_only=False)


@query("i02_catch_up", f"WITH {_FIRES}, r AS (SELECT * FROM b_runs WHERE device % 3 > 0 OR started_at < TIMESTAMP '2024-01-10') SELECT device, max(fire) AS fire FROM fires f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.device = f.device AND r.started_at >= f.fire) GROUP BY device")
def _(t):
    """A third of the devices has been off since the 10th."""
    return schedule.missed_fires(_fires(t), t.b_runs.filter("device % 3 > 0 or started_at < timestamp_ntz'2024-01-10'"), "device")


@query("i03_classify_tick", "SELECT id, coalesce(max(finished) OVER (PARTITION BY device ORDER BY started_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > started_at, false) AS overlapping FROM (SELECT *, started_at + to_minutes(CAST(id % 600 AS INTEGER)) AS finished FROM b_runs)")
def _(t):
    runs = t.b_runs.withColumn("finished_at", c("started_at") + F.make_dt_interval(mins=(c("id") % 600).cast("int")))
    return schedule.classify_tick(runs, "device").select("id", "overlapping")


@query("b33_watch_alert", f"""
WITH {_FIRES}, l AS (SELECT device, max(id) AS id FROM b_runs WHERE trigger_kind = 'scheduled' GROUP BY device), r AS (SELECT b.* FROM b_runs b JOIN l USING (device, id))
SELECT device, coalesce(outcome, '') NOT IN ('success', 'nothing_to_do', 'skipped_overlapping') OR started_at < TIMESTAMP '2024-01-20 09:00:00' AS alert FROM r""")
def _(t):
    now = F.lit("2024-01-21 08:00:00").cast("timestamp")
    last = state.last_run(t.b_runs, scheduled=True, by="device").select("device", "outcome", c("started_at").cast("timestamp").alias("started_at"), F.lit("2024-01-21 08:00:00").cast("timestamp_ntz").alias("t"))
    rows = schedule.as_of(last, _fires(t), "device")
    return rows.select("device", S.watch_alert(c("outcome"), c("started_at"), c("last_fire").cast("timestamp"), now).alias("alert"))


@query("c10_identify_device", "SELECT m.id, m.machine, coalesce(arg_min(h.model, (-length(h.hint), h.model)) FILTER (WHERE h.hint IS NOT NULL), 'default') AS model, count(h.hint) > 0 AS recognized FROM b_machines m LEFT JOIN b_hints h ON contains(lower(m.machine), lower(h.hint)) GROUP BY m.id, m.machine")
def _(t):
    return schedule.identify_device(t.b_machines, t.b_hints)


@query("c10_resolve_device", "SELECT id, CASE WHEN id % 3 = 0 THEN machine WHEN id % 3 = 1 THEN 'old' ELSE 'default' END AS model, CASE WHEN id % 3 = 0 THEN 'live' WHEN id % 3 = 1 THEN 'remembered' ELSE 'default' END AS provenance FROM b_machines")
def _(t):
    found = schedule.resolve_device(F.when(c("id") % 3 == 0, c("machine")), F.when(c("id") % 3 == 1, "old"))
    return t.b_machines.select("id", found.alias("x")).select("id", "x.*")


# --- notes -----------------------------------------------------------------------------------------


def _notes(t: Tables) -> DataFrame:
    made = notes.page_blocks(t.b_pages)
    body = F.concat(F.lit("my own words\n"), T.render_segments(c("segments")), F.lit("\nthe end"))
    edited = F.regexp_replace(body, "(docsync:begin page-1 h=[0-9a-f]+ -->\n)", "$1edited ")
    return made.select(c("doc_id").alias("note_id"), F.when(c("doc_id") % 5 == 0, edited).otherwise(body).alias("body"))


def _generated(t: Tables) -> DataFrame:
    body = S.page_body(c("text"), c("error"))
    new = F.when(c("idx") % 3 == 0, F.concat(body, F.lit(" more"))).otherwise(body)
    return t.b_pages.filter("idx % 4 <> 3").select(c("doc_id").alias("note_id"), c("idx").alias("pos"), F.concat(F.lit("page-"), (c("idx") + 1).cast("string")).alias("block_id"), new.alias("content"))


_BODIES = """bodies AS (SELECT doc_id, idx, b, doc_id % 5 = 0 AND idx = 0 AS edited, trim('edited ' || b, ' ' || chr(10)) AS e FROM (SELECT *, CASE WHEN error IS NULL THEN trim(text, ' ' || chr(10)) ELSE '> [!warning] Page not transcribed' || chr(10) || '> ' || error END AS b FROM b_pages))"""
_MERGED = """blocks AS (SELECT *, '<!-- docsync:begin page-' || (idx + 1) || ' h=' || substr(sha256(v), 1, 8) || ' -->' || chr(10) || v || chr(10) || '<!-- docsync:end page-' || (idx + 1) || ' -->' AS block FROM (SELECT *, CASE WHEN idx % 4 <> 3 AND idx % 3 = 0 THEN trim(b || ' more', ' ' || chr(10)) ELSE b END AS v FROM bodies)),
merged AS (SELECT doc_id, 'my own words' || chr(10) || chr(10) || string_agg(block || CASE WHEN edited THEN chr(10) || chr(10) || '<!-- docsync: what was changed in page-1 by hand -->' || chr(10) || e ELSE '' END, chr(10) || chr(10) ORDER BY idx) || chr(10) || 'the end' AS body, count(*) FILTER (WHERE edited) + count(*) FILTER (WHERE idx % 4 = 3) AS warnings FROM blocks GROUP BY doc_id)"""


@query("h04_block_diff", "SELECT doc_id AS note_id, 'page-' || (idx + 1) AS block_id, CASE WHEN idx % 4 = 3 THEN 'kept' WHEN idx = 0 AND doc_id % 5 = 0 THEN 'edited' WHEN idx % 3 = 0 THEN 'replaced' ELSE 'same' END AS state FROM b_pages")
def _(t):
    return notes.block_diff(notes.parse_segments(_notes(t)), _generated(t))


@query("h05_parse_segments", f"""
WITH {_BODIES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS size FROM bodies)
SELECT doc_id AS note_id, CAST(1 + 2 * k AS INTEGER) AS pos, 'page-' || (idx + 1) AS block_id, md5(CASE WHEN edited THEN e ELSE b END) AS content, substr(sha256(b), 1, 8) AS written_hash FROM n
UNION ALL SELECT doc_id, CAST(2 * k AS INTEGER), NULL, md5(CASE WHEN k = 0 THEN 'my own words' ELSE '' END), NULL FROM n
UNION ALL SELECT doc_id, CAST(2 * size AS INTEGER), NULL, md5('the end'), NULL FROM n WHERE k = 0""")
def _(t):
    return notes.parse_segments(_notes(t)).withColumn("content", F.md5(c("content").cast("binary")))


@query("h05_segments_in_sql", f"""
WITH {_BODIES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS size FROM bodies)
SELECT doc_id AS note_id, CAST(1 + 2 * k AS INTEGER) AS pos, 'page-' || (idx + 1) AS block_id, md5(CASE WHEN edited THEN e ELSE b END) AS content, substr(sha256(b), 1, 8) AS written_hash FROM n
UNION ALL SELECT doc_id, CAST(2 * k AS INTEGER), NULL, md5(CASE WHEN k = 0 THEN 'my own words' ELSE '' END), NULL FROM n
UNION ALL SELECT doc_id, CAST(2 * size AS INTEGER), NULL, md5('the end'), NULL FROM n WHERE k = 0""")
def _(t):
    """The same, as SQL over a view."""
    notes.register_segments(t.spark)
    return t.spark.sql("SELECT n.note_id, s.pos, s.block_id, md5(CAST(s.content AS BINARY)) AS content, s.written_hash FROM {bodies} n, LATERAL note_segments(n.body) s", bodies=_notes(t))


@query("h04_merge_notes", f"WITH {_BODIES}, {_MERGED} SELECT doc_id AS note_id, md5(body) AS digest, warnings FROM merged")
def _(t):
    out = notes.merge_notes(notes.parse_segments(_notes(t)), _generated(t))
    whole = out.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("pos", "block_id", "content", "written_hash"))).alias("s"), F.sum(F.size("warnings")).alias("warnings"))
    return whole.select("note_id", F.md5(T.render_segments(c("s")).cast("binary")).alias("digest"), "warnings")


@query("h08_build_notes", f"""
WITH {_BODIES}, {_MERGED},
fresh AS (SELECT doc_id, string_agg(CASE WHEN idx % 4 <> 3 THEN block END, chr(10) || chr(10) ORDER BY idx) AS body FROM blocks GROUP BY doc_id),
built AS (
  SELECT f.doc_id, 'T' || f.doc_id AS title, f.doc_id % 4 AS k, CASE f.doc_id % 4 WHEN 1 THEN m.body WHEN 2 THEN 'by hand' || chr(10) || coalesce(chr(10) || f.body, '') ELSE coalesce(f.body, '') END AS body, CASE WHEN f.doc_id % 4 = 1 THEN m.warnings ELSE 0 END AS warnings FROM fresh f JOIN merged m USING (doc_id)
  UNION ALL SELECT doc_id + 1000000, 'B' || doc_id, 0, '<!-- docsync:begin body h=' || substr(sha256('text of ' || doc_id), 1, 8) || ' -->' || chr(10) || 'text of ' || doc_id || chr(10) || '<!-- docsync:end body -->', 0 FROM fresh)
SELECT doc_id, md5(rtrim('---' || chr(10) || 'docsync_id: ' || doc_id || chr(10) || 'created: ' || CASE WHEN k IN (1, 3) THEN '2020-02-03' ELSE '2023-05-06' END || chr(10) || 'updated: 2024-01-01' || chr(10) || 'synced: 2024-01-01' || chr(10) || 'source: docsync/Top/' || title || chr(10)
  || 'tags:' || chr(10) || '  - docs' || chr(10) || '  - a' || CASE WHEN k = 1 THEN chr(10) || '  - todo' ELSE '' END || CASE WHEN k IN (1, 2) THEN chr(10) || 'author: me' ELSE '' END || chr(10) || '---' || chr(10) || body, chr(10)) || chr(10)) AS digest, CAST(warnings AS INTEGER) AS warnings FROM built""")
def _(t):
    """New notes, notes with edits, notes of somebody's own, notes of an older version, and documents without pages."""
    ids = t.b_pages.select("doc_id").distinct()
    key = c("doc_id").cast("string")
    docs = ids.select("doc_id", F.concat(F.lit("T"), key).alias("title"), F.lit(None).cast("string").alias("body_text"))
    docs = docs.union(ids.select(c("doc_id") + 1000000, F.concat(F.lit("B"), key), F.concat(F.lit("text of "), key)))
    docs = docs.withColumns({"tags": F.array(F.lit("a")), "folder_parts": F.array(F.lit("Top")), "first_published": F.lit("2023-05-06 07:08:09")})
    mine = _notes(t).select(c("note_id").alias("doc_id"), F.concat(F.lit("---\ncreated: 2020-02-03\ntags: [A, todo]\nauthor: me\n---\n"), "body").alias("text"), F.lit(1).alias("k"))
    other = ids.select("doc_id", F.lit("---\nauthor: me\n---\nby hand\n\n").alias("text"), F.lit(2).alias("k"))
    older = ids.select("doc_id", F.lit("---\ncreated: 2020-02-03\nsource: docsync/x\n---\nstale").alias("text"), F.lit(3).alias("k"))
    existing = mine.union(other).union(older).filter("doc_id % 4 = k").drop("k")
    changed = t.b_pages.filter("idx % 4 <> 3").withColumn("text", F.when((c("idx") % 3 == 0) & c("error").isNull(), F.concat("text", F.lit(" more"))).otherwise(c("text")))
    changed = changed.withColumn("error", F.when((c("idx") % 3 == 0) & c("error").isNotNull(), F.concat("error", F.lit(" more"))).otherwise(c("error")))
    return notes.build_notes(docs, changed, "2024-01-01", existing, ("docs",)).select("doc_id", F.md5(c("note").cast("binary")).alias("digest"), F.size("warnings").alias("warnings"))


@query("e02_claim_names", """
WITH s AS (SELECT *, trim(regexp_replace(base, '#', '-'), ' -') AS safe FROM b_names), r AS (SELECT *, row_number() OVER (PARTITION BY dir, safe ORDER BY ord) AS k FROM s)
SELECT doc_id, dir, safe || CASE WHEN k = 1 THEN '' WHEN k <= 97 THEN ' (' || (k + 2) || ')' ELSE ' (100)' END AS name, CASE WHEN k = 1 THEN 0 WHEN k <= 97 THEN 1 ELSE 2 END AS warnings FROM r
UNION ALL SELECT 'D' || doc_id, dir, CASE WHEN ord % 2 = 0 THEN 'Own' ELSE 'Alone' END || ' ' || ord || CASE WHEN ord % 2 = 0 THEN ' (2)' ELSE '' END, 0 FROM b_names""")
def _(t):
    """In each folder the second name is somebody's and the third can't be read; other documents own a counted name or have one to themselves."""
    safe = S.sanitize_filename(c("base"))
    more = t.b_names.select("dir", F.concat(F.when(c("ord") % 2 == 0, "Own ").otherwise("Alone "), c("ord").cast("string"), F.when(c("ord") % 2 == 0, " (2)").otherwise("")).alias("base"), F.concat(F.lit("D"), "doc_id").alias("doc_id"), "ord")
    bases = t.b_names.select("dir", safe.alias("base")).distinct()
    held = bases.select("dir", F.concat("base", F.lit(" (2)")).alias("name"), F.lit("somebody").alias("owner"), F.lit(True).alias("readable"))
    held = held.union(bases.select("dir", F.concat("base", F.lit(" (3)")), F.lit(None).cast("string"), F.lit(False)))
    held = held.union(more.filter("ord % 2 = 0").select("dir", "base", "doc_id", F.lit(True)))
    late = F.when((c("name").endswith("(100)")), 2)  # two warnings: the one that can't be read, and the last name
    found = notes.claim_names(t.b_names.unionByName(more), held)
    return found.select("doc_id", "dir", "name", F.coalesce(late, F.size("warnings")).alias("warnings"))


_NOTE_INDEX = "n AS (SELECT DISTINCT destination, target, CASE WHEN run_id % 2 = 0 THEN doc_id ELSE 'somebody' END AS owner FROM b_publications WHERE run_id % 3 > 0)"


@query("g06_prune_orphans", """
WITH o AS (SELECT DISTINCT doc_id FROM b_publications WHERE doc_id NOT IN (SELECT id FROM b_listing_live))
SELECT p.doc_id, p.destination, p.run_id AS target_run, CASE WHEN p.run_id % 6 IN (2, 4) THEN 'delete' ELSE 'keep' END AS action FROM b_publications p JOIN o USING (doc_id)""")
def _(t):
    own = t.b_publications.withColumn("target", c("run_id").cast("string"))
    index = own.filter("run_id % 3 > 0").select("destination", "target", F.when(c("run_id") % 2 == 0, c("doc_id")).otherwise("somebody").alias("owner"))
    out = notes.prune_orphans(selection.orphans(own, t.b_listing_live), own, index)
    return out.select("doc_id", "destination", c("target").cast("long").alias("target_run"), "action")


@query("g07_relocations", "SELECT doc_id, destination, CAST(run_id AS VARCHAR) AS old, 'new-' || doc_id AS new FROM b_publications WHERE run_id % 2 = 0 AND NOT run_id % 5 = 0")
def _(t):
    own = t.b_publications.withColumn("target", c("run_id").cast("string"))
    index = own.select("destination", "target", F.when(c("run_id") % 2 == 0, c("doc_id")).otherwise("somebody").alias("owner"))
    busy = own.filter("run_id % 5 = 0").select("destination", F.concat(F.lit("new-"), "doc_id").alias("target"), F.lit("x").alias("owner"))
    docs = t.b_documents.select(c("id").alias("doc_id"), F.concat(F.lit("new-"), "id").alias("path"))
    return notes.relocations(docs, own, index.union(busy))


@query("a07_html_to_text")
def _(t):
    return files.html_to_text(t.pages.select("page_id", "html"), "html").select("page_id", F.md5(c("text").cast("binary")).alias("digest"), F.length("text").alias("length"))


@query("a11_inventory_json", "SELECT CAST(json_extract_string(j, '$.id') AS VARCHAR) AS id, json_extract_string(j, '$.name') AS name FROM (SELECT json_object('id', id, 'name', name) AS j FROM b_documents)")
def _(t):
    lines = sinks.inventory_json(t.b_documents.select("id", "name"))
    return lines.select(F.get_json_object("line", "$.id").alias("id"), F.get_json_object("line", "$.name").alias("name"))


# --- streams: every file of a table in one available-now run ----------------------------------------


def _stream(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t._dir}/{name}.parquet*")


def _drained(t: Tables, stream: DataFrame) -> DataFrame:
    """All that an append stream gives, as a table in the shared folder."""
    folder = scratch.scratch_folder(t.spark)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("i06_run_stats", f"SELECT CAST(date_trunc('day', started_at) AS TIMESTAMP) AS start, {_phrase} AS phrase, count(*) AS n FROM b_runs WHERE date_trunc('day', started_at) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL")
def _(t):
    """As a stream: the days that the watermark has closed."""
    runs = t.spark.sql(BINDINGS["b_runs"], events=_stream(t, "events"))
    return _drained(t, streams.stream_run_stats(runs)).withColumn("start", c("start").cast("timestamp_ntz"))


def _snapshots(orders: DataFrame) -> DataFrame:
    at = c("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=c("o_orderkey") / 1e6)
    return orders.select(F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("doc_id"), c("o_orderstatus").alias("version"), c("o_orderpriority").alias("recipe"), at.alias("ts"))


@query("i06_sessions", """
WITH r AS (SELECT device, started_at, outcome, sum(CASE WHEN before + INTERVAL 6 HOUR > started_at THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY started_at, id) AS s
  FROM (SELECT *, lag(started_at) OVER (PARTITION BY device ORDER BY started_at, id) AS before FROM b_runs))
SELECT device, min(started_at) AS start, max(started_at) + INTERVAL 6 HOUR AS end, count(*) AS runs, count(*) FILTER (WHERE outcome = 'error') AS failed FROM r GROUP BY device, s
HAVING max(started_at) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    """As a stream: the bursts of runs of each device that the watermark has closed."""
    runs = t.spark.sql(BINDINGS["b_runs"], events=_stream(t, "events"))
    return _drained(t, streams.stream_sessions(runs)).withColumns({x: c(x).cast("timestamp_ntz") for x in ("start", "end")})


def _on_rocksdb(t: Tables, run):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        t.spark.conf.set(key, before)


@query("i05_stream_transitions", """
WITH p AS (SELECT id, CASE WHEN c_custkey % 10 = 0 THEN 'old' ELSE CAST(c_custkey * 7 % 1000 AS VARCHAR) END AS version, c_custkey FROM (SELECT 'C' || c_custkey AS id, * FROM customer) WHERE c_custkey % 4 > 0),
s AS (SELECT 'C' || c_custkey AS id, c_custkey, CAST(c_custkey * 7 % 1000 AS VARCHAR) AS version FROM customer),
one AS (SELECT * FROM s WHERE c_custkey % 3 > 0), two AS (SELECT id, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN version || 'x' ELSE version END AS version FROM s WHERE c_custkey % 5 > 0)
SELECT id AS doc_id, version, 'r1' AS recipe, CASE WHEN c_custkey % 4 > 0 THEN 'changed' ELSE 'new' END AS change FROM one WHERE c_custkey % 4 = 0 OR c_custkey % 10 = 0
UNION ALL SELECT two.id, two.version, 'r1', CASE WHEN two.c_custkey % 3 > 0 OR two.c_custkey % 4 > 0 THEN 'changed' ELSE 'new' END FROM two
  WHERE two.c_custkey % 3 = 0 AND two.c_custkey % 4 = 0 OR two.c_custkey % 11 = 0 OR two.c_custkey % 3 = 0 AND two.c_custkey % 10 = 0
UNION ALL SELECT id, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey * 7 % 1000 AS VARCHAR) ELSE version END, 'r1', 'orphaned' FROM (SELECT s.id, s.c_custkey, p.version FROM s LEFT JOIN p USING (id)) WHERE c_custkey % 5 = 0 AND (c_custkey % 3 > 0 OR c_custkey % 4 > 0)""")
def _(t):
    """Two snapshots of the listing after what is published, the second one after a restart, and a third run with nothing new but the time."""
    folder = scratch.scratch_folder(t.spark)
    at = lambda day: F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp").alias("ts")
    version, key = (c("c_custkey") * 7 % 1000).cast("string"), F.concat(F.lit("C"), c("c_custkey").cast("string")).alias("doc_id")
    old = t.customer.filter("c_custkey % 4 > 0").select(key, F.when(c("c_custkey") % 10 == 0, "old").otherwise(version).alias("version"), F.lit("r1").alias("recipe"), at(1))
    one = t.customer.filter("c_custkey % 3 > 0").select(key, version.alias("version"), F.lit("r1").alias("recipe"), at(2))
    two = t.customer.filter("c_custkey % 5 > 0").select(key, F.when(c("c_custkey") % 11 == 0, F.concat(version, F.lit("x"))).otherwise(version).alias("version"), F.lit("r1").alias("recipe"), at(3))
    clock = two.limit(1).withColumn("ts", at(5))  # a row that was there moves the time on
    out = f"{folder}/out"

    def run() -> DataFrame:
        for n, snapshot in enumerate((one, two, clock)):
            snapshot.write.mode("append").parquet(f"{folder}/in")
            stream = t.spark.readStream.schema(one.schema).parquet(f"{folder}/in")
            found = streams.stream_transitions(stream, old, dt.timedelta(days=2, hours=12))
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return t.spark.read.schema(found.schema).parquet(out)

    return _on_rocksdb(t, run)


@query("i05_stream_changes", """
SELECT doc_id, version, recipe FROM (
  SELECT 'C' || o_custkey AS doc_id, o_orderstatus AS version, o_orderpriority AS recipe, row_number() OVER w AS n, lag(o_orderstatus) OVER w AS v, lag(o_orderpriority) OVER w AS r
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE n = 1 OR v <> version OR r <> recipe""")
def _(t):
    return _on_rocksdb(t, lambda: _drained(t, streams.stream_changes(_snapshots(_stream(t, "orders")))))


@query("i07_distinct_snapshots", "SELECT DISTINCT 'C' || o_custkey AS doc_id, o_orderstatus AS version FROM orders")
def _(t):
    return _drained(t, streams.distinct_snapshots(_snapshots(_stream(t, "orders")).select("doc_id", "version", "ts"), "3650 days").select("doc_id", "version"))


@query("i04_stream_sync", _SELECT + """SELECT id AS doc_id, CASE WHEN (ord - 1000) % 37 = 0 THEN 'failed' ELSE 'published' END AS status,
  md5('---' || chr(10) || 'docsync_id: ' || id || chr(10) || 'created: 2024-01-01' || chr(10) || 'updated: 2024-01-01' || chr(10) || 'synced: 2024-01-01' || chr(10) || 'source: docsync/' || CASE WHEN folder = '' THEN '' ELSE folder || '/' END || name || chr(10) || 'tags:' || chr(10) || '  - ' || source || chr(10) || '---' || chr(10)
    || coalesce('<!-- docsync:begin page-1 h=' || substr(sha256(page), 1, 8) || ' -->' || chr(10) || page || chr(10) || '<!-- docsync:end page-1 -->' || chr(10), '')) AS note
FROM j LEFT JOIN (SELECT 'C' || doc_id AS page_of, trim(text, ' ' || chr(10)) AS page FROM documents WHERE text IS NOT NULL) ON page_of = id WHERE reason IS NULL""")
def _(t):
    """Each snapshot of the listing goes through selection, note building with the text of its pages, and the record of outcomes."""
    folder = scratch.scratch_folder(t.spark)
    criteria = dataclasses.replace(_CRITERIA, limit=None)

    def select(batch: DataFrame) -> DataFrame:
        own = Tables(batch.sparkSession, t._dir)
        own._made["customer"] = batch
        return _selected(own, criteria).filter("decision = 'process'")

    def publish(rows: DataFrame, n: int) -> DataFrame:
        rows = scratch.written(rows)
        docs = rows.select("doc_id", c("name").alias("title"), F.array("source").alias("tags"), F.array("folder").alias("folder_parts"))
        texts = t.documents.filter("text is not null").select(F.concat(F.lit("C"), c("doc_id").cast("string")).alias("doc_id"), F.lit(0).alias("idx"), "text", F.lit(None).cast("string").alias("error"))
        made = notes.build_notes(docs, texts.join(docs.select("doc_id"), "doc_id", "left_semi"), "2024-01-01").select("doc_id", F.md5(c("note").cast("binary")).alias("note"))
        failed = (c("ord") - 1000) % 37 == 0
        return made.join(rows.select("doc_id", F.when(failed, "failed").otherwise("published").alias("status")), "doc_id")

    record = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    streams.stream_sync(_stream(t, "customer"), f"{folder}/log", select, publish, record).awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("doc_id", "status", "note")


@query("a12_state_tables", "SELECT doc_id, destination, CASE WHEN run_id % 2 = 0 THEN 'v2' ELSE version END AS version FROM b_publications")
def _(t):
    tables = sinks.StateTables(t.spark, scratch.scratch_folder(t.spark))
    tables.save("publications", t.b_publications)
    new = t.b_publications.filter("run_id % 2 = 0").withColumn("version", F.lit("v2"))
    tables.save("publications", state.upsert_publications(tables.load("publications"), new))
    return tables.load("publications").select("doc_id", "destination", "version")


@query("a03_delimited_documents", "SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS file_type FROM customer")
def _(t):
    folder = scratch.scratch_folder(t.spark)
    body = F.when(c("c_custkey") % 5 > 0, F.to_json(F.struct(c("c_mktsegment").alias("fileType")))).otherwise("{broken")
    t.customer.select(F.concat(F.lit("C"), c("c_custkey").cast("string"), F.lit("\n"), body)).write.option("lineSep", "===FILE===").text(folder)
    return files.file_types(files.read_delimited_documents(t.spark, folder))


def _spread(key) -> Column:
    """One of 256 folders for a file of that key: a folder is listed by one task, and files are made in it one after another."""
    return F.format_string("%02x/", F.pmod(F.xxhash64(key), F.lit(256)))


@query("a01_blob_index", "SELECT o_custkey AS doc, count(*) AS blobs, CAST(sum(o_orderkey) AS BIGINT) AS bytes FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey")
def _(t):
    folder = scratch.scratch_folder(t.spark)
    size = F.when(c("o_custkey") % 3 == 0, "bad").otherwise(c("o_orderkey").cast("string"))
    line = F.concat_ws(":", F.lit("h"), F.lit("0"), c("o_orderkey").cast("string"), F.lit("0"), size)
    index = t.orders.groupBy("o_custkey").agg(F.concat(F.lit("3\nshort:line\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    sinks.write_notes(index.select(F.concat(_spread("o_custkey"), c("o_custkey").cast("string"), F.lit(".idx")).alias("path"), "text"), folder)
    found = files.read_blob_index(t.spark, f"{folder}/*")
    return found.groupBy(c("doc_id").cast("long").alias("doc")).agg(F.count("*").alias("blobs"), F.sum("size").alias("bytes"))


@query("a06_a09_notes", "SELECT conv_id AS doc_id, 'text' AS state, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(t):
    folder = scratch.scratch_folder(t.spark)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = t.conversations.groupBy("conv_id").agg(whole.alias("text"))
    sinks.write_notes(rows.select(F.concat(F.lit("notes/"), c("conv_id").cast("string"), F.lit(".md")).alias("path"), "text"), folder)
    found = files.read_notes(t.spark, folder)
    return found.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long").alias("doc_id"), "state", "text")


@query("a02_listing_ssh", "SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'C' || c_custkey ELSE CAST(1700000000000 + c_custkey AS VARCHAR) END AS hash, c_custkey % 2 = 0 AS pinned, CASE WHEN c_custkey % 3 > 0 THEN make_timestamp((1700000000000 + c_custkey) * 1000) END AS last_modified FROM customer")
def _(t):
    """Files without a hash of their own: the time of change stands in, else the id."""
    folder = scratch.scratch_folder(t.spark)
    changed = F.when(c("c_custkey") % 3 > 0, (c("c_custkey") + 1700000000000).cast("string"))
    body = F.to_json(F.struct(c("c_name").alias("visibleName"), changed.alias("lastModified"), (c("c_custkey") % 2 == 0).alias("pinned")))
    sinks.write_notes(t.customer.select(F.concat(_spread("c_custkey"), F.lit("C"), c("c_custkey").cast("string"), F.lit(".metadata")).alias("path"), body.alias("text")), folder)
    return files.read_listing(t.spark, f"{folder}/*", flavor="ssh").select("id", "hash", "pinned", c("last_modified").cast("timestamp_ntz").alias("last_modified"))


@query("a02_listing", "SELECT 'C' || c_custkey AS id, c_name AS name, CAST(c_custkey * 7 AS VARCHAR) AS hash, 'DocumentType' AS doc_type FROM customer WHERE c_custkey % 4 > 0")
def _(t):
    folder = scratch.scratch_folder(t.spark)
    body = F.to_json(F.struct(c("c_name").alias("visibleName"), (c("c_custkey") * 7).cast("string").alias("hash"), (c("c_custkey") % 4 == 0).alias("deleted")))
    path = F.concat(_spread("c_custkey"), F.lit("C"), c("c_custkey").cast("string"), F.lit(".metadata"))
    sinks.write_notes(t.customer.select(path.alias("path"), body.alias("text")), folder)
    return files.read_listing(t.spark, f"{folder}/*").select("id", "name", "hash", "doc_type")
