"""Pages: content lists, anomalies, outlines, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync_spark.functions.scalars import strip


def page_is_deleted(page: Column) -> Column:
    """Of a page entry (variant): not for a bare id; a deleted object's value, else whether deleted is true or not 0."""
    inner = F.coalesce(F.try_variant_get(page, "$.deleted.value", "double"), F.try_variant_get(page, "$.deleted.value", "boolean").cast("double"))
    flat = F.coalesce(F.try_variant_get(page, "$.deleted", "boolean").cast("double"), F.try_variant_get(page, "$.deleted", "double"))
    return F.coalesce(inner != 0, flat != 0, F.lit(False))


def flatten_page_list(contents: DataFrame, keep: str = "doc_id", json_col: str = "content") -> DataFrame:
    """(doc_id, pos, page_id, deleted, redir): the pages of each content JSON in order, from 0.

    cPages.pages wins over pages; an entry is an object or a bare id; entries without id are passed over.
    """
    body = F.try_parse_json(F.col(json_col))
    pages = F.coalesce(F.try_variant_get(body, "$.cPages.pages", "array<variant>"), F.try_variant_get(body, "$.pages", "array<variant>"))
    page = F.col("page")
    # casting any variant to a string works, so what an entry is has to be asked first
    bare = F.schema_of_variant(page) == "STRING"
    rows = contents.select(keep, F.posexplode(pages).alias("pos", "page"))
    id_ = F.when(bare, F.try_variant_get(page, "$", "string")).otherwise(F.try_variant_get(page, "$.id", "string"))
    return rows.select(keep, "pos", id_.alias("page_id"), F.when(bare, F.lit(False)).otherwise(page_is_deleted(page)).alias("deleted"), F.coalesce(F.try_variant_get(page, "$.redir.value", "int"), F.try_variant_get(page, "$.redir", "int")).alias("redir")).filter("page_id is not null")


def page_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc_id, moved): pages whose source is the same but whose rendering is not."""
    old = previous.select("doc_id", "page_index", F.col("source_hash").alias("s"), F.col("render_hash").alias("r"))
    moved = (F.col("source_hash") != "") & (F.col("source_hash") == F.col("s")) & F.col("r").isNotNull() & (F.col("r") != F.col("render_hash"))
    return current.join(old, ["doc_id", "page_index"]).filter(moved).groupBy("doc_id").agg(F.count("*").alias("moved"))


def blank_page_groups(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, same): documents of 3 pages or more with max(3, half) equal renderings."""
    by_hash = pages.groupBy("doc_id", "render_hash").agg(F.count("*").alias("c"))
    known = F.when(F.col("render_hash").isNotNull(), F.col("c"))
    found = by_hash.groupBy("doc_id").agg(F.sum("c").alias("pages"), F.max(known).alias("same"))
    return found.filter((F.col("pages") >= 3) & (F.col("same") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 2))))


def detect_anomalies(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc_id, kind, n): drift and blank-page warnings."""
    drift = page_drift(current, previous).select("doc_id", F.lit("moved").alias("kind"), F.col("moved").alias("n"))
    return drift.union(blank_page_groups(current).select("doc_id", F.lit("blank").alias("kind"), F.col("same")))


def breadcrumbs(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_id, page, breadcrumbs): for each page the outline entries in force, outermost first.

    Entries count in outline order up to the first that lies beyond the page; one at a level ends
    deeper and equal ones before it; blank titles are dropped. pages: (doc_id, page); toc:
    (doc_id, ord, level, title, page). One pass over a document's outline carries the open entries along; each page
    then takes what was open at the last entry at or before it, by one sort of both, so pages and entries are never paired.
    """
    own = Window.partitionBy("doc_id").orderBy("ord")
    # an entry is seen from pages of the largest page number up to it
    seen = F.max("page").over(own.rowsBetween(Window.unboundedPreceding, 0))
    entry = F.struct("ord", "level", "title", seen.alias("at"))
    outlines = toc.select("doc_id", entry.alias("e")).groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("entries"))
    open_ = F.struct(F.lit(0).alias("level"), F.lit("").alias("title"))
    state = F.struct(F.filter(F.array(open_), lambda x: F.lit(False)).alias("now"), F.array().cast("array<struct<at:bigint,ord:bigint,trail:array<string>>>").alias("out"))

    def step(st: Column, e: Column) -> Column:
        now = F.concat(F.filter(st["now"], lambda x: x["level"] < e["level"]), F.array(F.struct(e["level"].cast("int").alias("level"), F.coalesce(e["title"], F.lit("")).alias("title"))))
        return F.transform(F.array(now), lambda n: F.struct(n.alias("now"), F.concat(st["out"], F.array(F.struct(e["at"].cast("long").alias("at"), e["ord"].cast("long").alias("ord"), F.filter(F.transform(n, lambda x: x["title"]), lambda x: x != "").alias("trail")))).alias("out")))[0]

    trails = outlines.select("doc_id", F.inline(F.aggregate("entries", state, step, lambda st: st["out"])))
    asked = pages.select("doc_id", "page").distinct()
    both = trails.select("doc_id", F.col("at").alias("t"), F.lit(0).alias("kind"), "ord", "trail").unionByName(asked.select("doc_id", F.col("page").cast("long").alias("t"), F.lit(1).alias("kind")), allowMissingColumns=True)
    before = Window.partitionBy("doc_id").orderBy("t", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("breadcrumbs", F.last("trail", True).over(before)).filter("kind = 1").select("doc_id", F.col("t").alias("page"), "breadcrumbs")
    out = pages.join(found, ["doc_id", "page"], "left")
    return out.withColumn("breadcrumbs", F.coalesce("breadcrumbs", F.array().cast("array<string>")))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, joined by a sort over all tasks and never broadcast: Spark takes a list of pages that is read from JSON for much smaller than it is."""
    return rows.hint("merge")


def annotated_pages(content_pages: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, idx, page_id, member): annotated pages of a PDF or EPUB by the page they lie on.

    content_pages as from flatten_page_list; members: (doc_id, page_id, member). Deleted pages claim
    their member and drop it; the index is redir, else the position. Members of no page follow.
    """
    pages = _dealt(content_pages.select("doc_id", "page_id", "deleted", F.coalesce("redir", "pos").alias("idx"), "pos"))
    claimed = members.join(pages, ["doc_id", "page_id"])
    kept = claimed.filter(~F.col("deleted")).select("doc_id", "idx", "pos", "page_id", "member")
    n = _dealt(kept.groupBy("doc_id").agg(F.count("*").alias("n")))
    spare = members.join(pages, ["doc_id", "page_id"], "left_anti").join(n, "doc_id", "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("member")) - 1
    rest = spare.select("doc_id", (F.coalesce("n", F.lit(0)) + place).cast("int").alias("idx"), F.lit(None).cast("int").alias("pos"), "page_id", "member")
    return kept.unionByName(rest).select("doc_id", "idx", "page_id", "member")


def ordered_pages(content_pages: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, ordinal, page_id, member): live members in page-list order, then the others by path."""
    pages = _dealt(content_pages.select("doc_id", "page_id", "deleted", "pos"))
    joined = members.join(pages, ["doc_id", "page_id"], "left").filter(~F.coalesce("deleted", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("pos").asc_nulls_last(), "member")) - 1
    return joined.select("doc_id", place.alias("ordinal"), "page_id", "member")


def pages_per_document(content_pages: DataFrame, members: DataFrame) -> DataFrame:
    return ordered_pages(content_pages, members).groupBy("doc_id").agg(F.count("*").alias("pages"))


def number_pages(pages: DataFrame, order: str = "idx", sparse: str | None = None) -> DataFrame:
    """pages with ordinal from 0 and number: ordinal + 1, or the sparse page number where one is given."""
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy(order)) - 1
    out = pages.withColumn("ordinal", ordinal)
    return out.withColumn("number", F.col(sparse) if sparse else F.col("ordinal") + 1)


def judge_documents(docs: DataFrame, pages: DataFrame, skip_empty: bool = True) -> DataFrame:
    """(doc_id, verdict): publish, failed or skipped. docs: (doc_id, has_text)."""
    blank = F.coalesce(strip(F.col("text")) == "", F.lit(True))
    error = F.col("error").isNotNull()
    facts = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(error & blank).alias("lost"), F.bool_and(blank).alias("blank"), F.bool_or(error).alias("any_error"))
    out = docs.join(facts, "doc_id", "left")
    verdict = (
        F.when(F.col("n").isNull() | F.coalesce("has_text", F.lit(False)), "publish")
        .when(F.col("lost"), "failed")
        .when(F.lit(skip_empty) & F.col("blank") & ~F.col("any_error"), "skipped")
        .otherwise("publish")
    )
    return out.select("doc_id", verdict.alias("verdict"))


def page_facts(pages: DataFrame) -> DataFrame:
    """(doc_id, has_text, failed_pages)."""
    some = F.coalesce(strip(F.col("text")) != "", F.lit(False))
    return pages.groupBy("doc_id").agg(F.bool_or(some).alias("has_text"), F.count("error").alias("failed_pages"))


def source_page_keys(members: DataFrame, kind: str = "notebook") -> DataFrame:
    """members (doc_id, pdf_index, content binary) with source_key; unreadable (null) content gives ''."""
    head = F.concat(F.col("pdf_index").cast("string").cast("binary"), F.lit(b"\x00"), F.col("content"))
    return members.withColumn("source_key", F.coalesce(F.sha2(F.col("content") if kind == "notebook" else head, 256), F.lit("")))
