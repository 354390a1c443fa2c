"""Stored state: keyed upserts by full outer join, status, and deletions. Every result is a new snapshot."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync_spark.sources.scratch import configuration

#: How a column is merged: the new value, the old one, the new one if it isn't null, the old one if it isn't null.
POLICIES = {
    "new": lambda old, new, both: F.when(both, new).otherwise(old),
    "keep": lambda old, new, both: F.coalesce(old, new),
    "fill": lambda old, new, both: F.coalesce(new, old),
}
DOCUMENTS = {"last_error": "keep"}
PUBLICATIONS = {"first_published_at": "keep", "external_id": "fill", "target": "fill"}


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policies: Mapping[str, str] | None = None, null_keys: bool = True) -> DataFrame:
    """old with new's rows put in by key; columns that new lacks stay. new has one row a key. Without null_keys a null equals no other, and buckets by these keys serve the join."""
    policies = policies or {}
    a, b = old.select("*", F.lit(True).alias("__old")).alias("a"), new.select("*", F.lit(True).alias("__new")).alias("b")
    same = (lambda x, y: x.eqNullSafe(y)) if null_keys else (lambda x, y: x == y)
    joined = a.join(b, [same(F.col(f"a.{k}"), F.col(f"b.{k}")) for k in keys], "full_outer")
    has = F.col("b.__new").isNotNull()
    out: list[Column] = []
    for c in old.columns:
        if c in keys:
            out.append(F.when(has, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        elif c in new.columns:
            out.append(POLICIES[policies.get(c, "new")](F.col(f"a.{c}"), F.col(f"b.{c}"), has).alias(c))
        else:
            out.append(F.col(f"a.{c}").alias(c))
    return joined.select(*out)


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"], DOCUMENTS)


def upsert_publications(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["doc_id", "destination", "profile"], PUBLICATIONS)


def upsert_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["doc_id", "page_index"])


def upsert_device(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"])


def record_failure(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: (id, last_error); a null error clears it."""
    return upsert(documents, failures, ["id"])


def forget(rows: DataFrame, doc_ids: DataFrame, destination: str | None = None, key: str = "doc_id") -> DataFrame:
    """rows without those of the documents, at one destination or at all."""
    gone = doc_ids.select(F.col(doc_ids.columns[0]).alias("__gone")).distinct()
    joined = rows.join(gone, F.col(key) == F.col("__gone"), "left")
    match = F.col("__gone").isNotNull() & (F.lit(destination is None) | (F.col("destination") == destination) if destination is not None else F.lit(True))
    return joined.filter(~match).drop("__gone")


def publications_by_destination_unknown(publications: DataFrame, known: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(counts of each unknown destination, the publications that stay)."""
    known = list(known)
    if not known:
        raise ValueError("no known destination: everything would be dropped")
    unknown = ~F.col("destination").isin(known)
    return publications.filter(unknown).groupBy("destination").agg(F.count("*").alias("n")), publications.filter(~unknown)


def publications_by_document(publications: DataFrame) -> DataFrame:
    """(doc_id, published): a map from destination to its row."""
    row = F.struct("version", "recipe", "pages_failed", "external_id", "target", "first_published_at", "last_published_at", "run_id")
    return publications.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("destination", row.alias("row"))))).alias("published"))


def sync_overview(documents: DataFrame, publications: DataFrame, destinations: DataFrame) -> DataFrame:
    """(id, name, status): failed, else new (pending and at no enabled destination), changed, up_to_date.

    Compares versions only, nulls equal. Destinations are configuration: broadcast.
    """
    enabled = destinations.filter("enabled").select("destination")
    rows = documents.join(configuration(enabled), how="cross")
    own = publications.filter("profile = 'default'").select(F.col("doc_id").alias("id"), "destination", F.col("version").alias("published_version"), F.lit(True).alias("has_row"))
    joined = rows.join(own, ["id", "destination"], "left")
    owes = ~F.col("published_version").eqNullSafe(F.col("version"))
    facts = joined.groupBy("id").agg(F.bool_or(owes).alias("owes"), F.count("has_row").alias("rows"))
    out = documents.join(facts, "id", "left")
    failed = F.coalesce(F.col("last_error") != "", F.lit(False))
    status = F.when(failed, "failed").when(F.coalesce("owes", F.lit(False)) & (F.coalesce("rows", F.lit(0)) == 0), "new").when(F.coalesce("owes", F.lit(False)), "changed").otherwise("up_to_date")
    return out.select("id", "name", status.alias("status"))


def comparison_rows(selection: DataFrame, publications: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, name, folder, doc_type, ord, decision, published): gaps filled from stored documents; published is a map."""
    versions = publications.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("destination", "version")))).alias("published"))
    stored = documents.select(F.col("id").alias("doc_id"), F.col("folder").alias("__folder"), F.col("doc_type").alias("__type"))
    out = selection.join(stored, "doc_id", "left").join(versions, "doc_id", "left")
    return out.select(F.col("doc_id").alias("id"), "name", F.coalesce(F.nullif("folder", F.lit("")), "__folder").alias("folder"), F.coalesce("source", "__type").alias("doc_type"), "ord", "decision", "published")


def publish_context(docs: DataFrame, destinations: DataFrame, publications: DataFrame) -> DataFrame:
    """What the last publish left for each (document, destination); adopt_by_name where it left no external id."""
    own = publications.select("doc_id", "destination", "external_id", "target", "first_published_at", F.lit(True).alias("__row"))
    out = docs.join(configuration(destinations.select("destination")), how="cross").join(own, ["doc_id", "destination"], "left")
    return out.withColumn("adopt_by_name", F.col("__row").isNotNull() & F.col("external_id").isNull()).drop("__row")


def last_run(runs: DataFrame, scheduled: bool = False, by: str | None = None) -> DataFrame:
    """The newest run by id, of each ``by`` if given."""
    rows = runs.filter("trigger_kind = 'scheduled'") if scheduled else runs
    whole = F.max_by(F.struct(*runs.columns), "id").alias("x")
    return (rows.groupBy(by).agg(whole) if by else rows.agg(whole).filter("x is not null")).select("x.*")


def recent_runs(runs: DataFrame, n: int, by: str | None = None) -> DataFrame:
    if not by:
        return runs.orderBy(F.desc("id")).limit(n)
    return runs.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("id")))).filter(F.col("__rn") <= n).drop("__rn")


def runs_since(runs: DataFrame, since: Column) -> DataFrame:
    return runs.agg(F.count_if(F.col("started_at") >= since).alias("n"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def all_documents(documents: DataFrame, seen: str = "seen_run_id") -> DataFrame:
    return documents.orderBy(F.desc(seen), "id")
