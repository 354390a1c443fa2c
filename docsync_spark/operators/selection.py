"""What is out of date where: the pending matrix, the selection, orphans, and tag sets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync_spark.functions import scalars as S
from docsync_spark.operators.hierarchy import with_folders
from docsync_spark.sources.scratch import configuration, written


def owes_publish(force: bool = False) -> Column:
    """Whether a (document, destination) pair of pending_matrix owes a publish."""
    row = F.col("published_version")
    recipe = ~F.coalesce("published_recipe", F.lit("")).eqNullSafe(F.coalesce("recipe", F.lit("")))
    changed = ~row.eqNullSafe(F.col("version")) | recipe | (F.coalesce("pages_failed", F.lit(0)) != 0) | ~F.coalesce("note_present", F.lit(True))
    return F.lit(force) | ~F.col("has_row") | changed


def pending_matrix(docs: DataFrame, destinations: DataFrame, publications: DataFrame, recipes: DataFrame, notes: DataFrame | None = None, force: bool = False) -> DataFrame:
    """(doc_id, destination, recipe, owes, ...) of every document and destination.

    docs: (doc_id, version, source). Destinations and recipes are configuration, a row for each
    destination (and source type): the pair is a broadcast product with them. Publications join
    by equality. notes: (destination, target) of notes that exist, else every note counts as present.
    """
    dims = destinations.select("destination").join(recipes, "destination", "left").select("destination", F.col("source").alias("__source"), "recipe")
    pairs = docs.join(configuration(destinations.select("destination")), how="cross")
    pairs = pairs.join(dims.withColumnRenamed("destination", "__d"), (F.col("__d") == F.col("destination")) & (F.col("__source") == F.col("source")), "left")
    own = publications.filter("profile = 'default'").select("doc_id", "destination", F.col("version").alias("published_version"), F.col("recipe").alias("published_recipe"), "pages_failed", "target", F.lit(True).alias("has_row"))
    out = pairs.join(own, ["doc_id", "destination"], "left").withColumn("has_row", F.coalesce("has_row", F.lit(False)))
    if notes is None:
        out = out.withColumn("note_present", F.lit(True))
    else:
        seen = notes.select("destination", "target", F.lit(True).alias("note_present")).distinct()
        out = out.join(seen, ["destination", "target"], "left").withColumn("note_present", F.coalesce("note_present", F.lit(False)))
    return out.withColumn("owes", owes_publish(force)).drop("__d", "__source")


def pending(matrix: DataFrame) -> DataFrame:
    """(doc_id, pending array): the destinations that each document owes; an empty array is 'unchanged'."""
    return matrix.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("owes"), F.col("destination")))).alias("pending"))


def note_exists(publications: DataFrame, notes: DataFrame) -> DataFrame:
    """publications with note_present: its recorded target is in the note index (destination, target, readable).

    A null target is missing; a note whose check failed (readable null) counts as present.
    """
    index = notes.select("destination", "target", F.coalesce("readable", F.lit(True)).alias("__present"))
    return publications.join(index, ["destination", "target"], "left").withColumn("note_present", F.coalesce("__present", F.lit(False))).drop("__present")


def orphans(publications: DataFrame, listing: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, name): published documents that the whole listing lacks; an empty listing orphans none."""
    any_row = listing.select(F.lit(True).alias("__any")).limit(1)
    gone = publications.select("doc_id").distinct().join(listing.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").join(F.broadcast(any_row), how="cross").drop("__any")
    if documents is None:
        return gone.withColumn("name", F.col("doc_id"))
    return gone.join(documents.select(F.col("id").alias("doc_id"), "name"), "doc_id", "left").withColumn("name", F.coalesce("name", "doc_id"))


def distinct_tags(tags: Column) -> Column:
    """Normalised tags, distinct whatever their case, first spelling and order kept."""
    clean = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: S.normalize_tag(t)), lambda t: t.isNotNull() & (t != ""))
    keep = lambda acc, t: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(t)), acc).otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(clean, F.array().cast("array<string>"), keep)


def extract_tags(content: Column) -> Column:
    """Tags of a content JSON text: document tags, then page tags; each a string or an object with a name."""
    body = F.try_parse_json(content)
    entries = lambda path: F.coalesce(F.try_variant_get(body, path, "array<variant>"), F.array().cast("array<variant>"))
    name = lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return distinct_tags(F.transform(F.concat(entries("$.tags"), entries("$.pageTags")), name))


def merge_tags(base: Column, doc: Column, existing: Column) -> Column:
    empty = F.array().cast("array<string>")
    return distinct_tags(F.concat(F.coalesce(base, empty), F.coalesce(doc, empty), F.coalesce(existing, empty)))


def tag_filter(tags: Column, wanted: Iterable[str]) -> Column:
    """Any of the wanted tags, whatever the case; unknown (null) tags pass; no wanted tags let all pass."""
    wanted = sorted({t.strip().lstrip("#").lower() for t in wanted} - {""})
    if not wanted:
        return F.lit(True)
    return tags.isNull() | F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, wanted)))


@dataclass(frozen=True)
class Criteria:
    """What the user asked for. A target overrides every other filter and the limit."""

    target: str | None = None
    excluded: tuple[str, ...] = ()
    source_path: str | None = None
    source_regex: str | None = None
    types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    limit: int | None = None
    force: bool = False
    names: dict = field(default_factory=dict)


def apply_limit(candidates: DataFrame, limit: int | None, order: str = "ord", key: str = "doc_id") -> DataFrame:
    """candidates with kept: the first ``limit`` in order; null or 0 keeps all. No global sort: top-k and a semi-join."""
    if not limit:
        return candidates.withColumn("kept", F.lit(True))
    first = candidates.orderBy(order, key).limit(limit).select(F.col(key).alias("__key"), F.lit(True).alias("__kept"))
    return candidates.join(first, F.col(key) == F.col("__key"), "left").withColumn("kept", F.coalesce("__kept", F.lit(False))).drop("__key", "__kept")


def select_documents(listing: DataFrame, criteria: Criteria, destinations: DataFrame, publications: DataFrame, recipes: DataFrame, tags: DataFrame | None = None, notes: DataFrame | None = None) -> DataFrame:
    """(doc_id, name, folder, source, version, ord, decision, pending): one classifier for preview and run.

    decision is the first that holds of trash, not_targeted (with a target) or else excluded,
    outside_path, wrong_type, unchanged, no_matching_tag; what is left is process or, past the limit,
    deferred. What the listing says of a document and what is owed to whom are written once, to the shared folder, and
    read by all that follows. Folders and nameless items are not judged. listing: (id, name, parent, doc_type,
    hash, file_type, ord). tags: (doc_id, tags). Tags are looked up for pending documents only.
    """
    c = criteria
    docs = with_folders(listing.filter((F.col("doc_type") != "DocumentType") | S.is_document(F.col("doc_type"), F.col("name"))))
    label, path = S.folder_label(F.col("folder_parts")), S.document_path(F.col("folder_parts"), F.col("name"))
    docs = docs.select(
        F.col("id").alias("doc_id"), "name", "ord", label.alias("folder"), "folder_parts", path.alias("path"),
        S.document_type(F.col("file_type"), F.array().cast("array<string>"), F.col("name")).alias("source"), S.document_version(F.col("hash"), F.lit(None).cast("string")).alias("version"),
    )
    first = F.when(S.is_trashed(F.lit(False), F.col("folder_parts")), "trash")
    if c.target:
        first = first.when(~S.matches_target(F.col("doc_id"), F.col("name"), F.col("folder_parts"), c.target), "not_targeted")
    else:
        first = first.when(S.excluded(F.col("folder"), c.excluded), "excluded").when(~S.path_filter(F.col("path"), c.source_path, c.source_regex), "outside_path").when(~S.type_filter(F.col("source"), c.types), "wrong_type")
    docs = written(docs.withColumn("reason", first))
    open_ = docs.filter("reason is null").select("doc_id", "version", "source")
    owed = pending(pending_matrix(open_, destinations, publications, recipes, notes, c.force or bool(c.target)))
    judged = docs.join(owed, "doc_id", "left")
    judged = written(judged.withColumn("reason", F.coalesce("reason", F.when(F.size(F.coalesce("pending", F.array().cast("array<string>"))) == 0, "unchanged"))))
    if c.tags and tags is not None:
        asked = judged.filter("reason is null").select("doc_id").join(tags, "doc_id", "left")
        misses = asked.filter(~tag_filter(F.col("tags"), c.tags)).select("doc_id", F.lit("no_matching_tag").alias("__tag"))
        judged = judged.join(misses, "doc_id", "left").withColumn("reason", F.coalesce("reason", "__tag")).drop("__tag")
    ready = apply_limit(judged.filter("reason is null").select("doc_id", "ord"), None if c.target else c.limit).select("doc_id", "kept")
    out = judged.join(ready, "doc_id", "left")
    decision = F.coalesce("reason", F.when(F.col("kept"), "process").otherwise("deferred"))
    return out.withColumn("decision", decision).select("doc_id", "name", "folder", "source", "version", "ord", "decision", "pending")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def find_documents(docs: DataFrame, query: str) -> DataFrame:
    """The document of that id alone; else those whose name or folder/name it is, whatever the case."""
    wanted = query.strip().strip("/").lower()
    full = F.lower(F.btrim(F.concat_ws("/", F.nullif("folder", F.lit("")), F.col("name")), F.lit("/")))
    exact = docs.filter(F.col("id") == query)
    named = docs.filter((F.lower("name") == wanted) | (full == wanted))
    return exact.union(named.join(F.broadcast(exact.select(F.lit(1).alias("__one")).limit(1)), how="left_anti", on=F.lit(True)))
