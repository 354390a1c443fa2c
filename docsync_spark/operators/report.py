"""Run reports: totals, outcomes, rankings, distinct messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync_spark.functions.scalars import is_partial
from docsync_spark.operators.memo import cache_hit_rate

STATUSES = ("failed", "new", "changed", "up_to_date")
OUTCOMES = ("published", "would_publish", "skipped", "deferred", "failed")


def count_by_status(rows: DataFrame) -> DataFrame:
    """(status, n) of all four statuses, zeros too."""
    every = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = rows.groupBy("status").agg(F.count("*").alias("n"))
    return F.broadcast(every).join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def run_totals(outcomes: DataFrame, by: str = "run_id") -> DataFrame:
    """Counts for each status, partial ones, and sums of pages; one aggregation."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in OUTCOMES]
    sums = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("pages_failed", "transcribed", "cached")]
    out = outcomes.groupBy(by).agg(F.count("*").alias("seen"), *counts, F.count_if(is_partial(F.col("pages_failed"), F.col("status"))).alias("partial"), *sums)
    return out.withColumn("hit_rate", cache_hit_rate(F.col("cached"), F.col("transcribed")))


def run_outcome(outcomes: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, outcome, error): nothing_to_do, partial on any failure, else success; error is the first failure's reason."""
    work = F.count_if(~F.col("status").isin("skipped", "deferred"))
    failed = F.count_if(F.col("status") == "failed")
    facts = outcomes.groupBy(by).agg(work.alias("work"), failed.alias("failed"), F.min_by("reason", F.when(F.col("status") == "failed", F.col("ord"))).alias("first_reason"))
    error = F.when(F.col("failed") > 0, F.coalesce("first_reason", F.concat(F.col("failed").cast("string"), F.lit(" failed"))))
    return facts.select(by, F.when(F.col("work") == 0, "nothing_to_do").when(F.col("failed") > 0, "partial").otherwise("success").alias("outcome"), error.alias("error"))


def skips_by_type(selection: DataFrame) -> DataFrame:
    return selection.filter("decision = 'wrong_type'").groupBy("source").agg(F.count("*").alias("n")).orderBy("source")


def pending_totals(selection: DataFrame) -> DataFrame:
    """(considered, pending): rows that were classified, and those still owed a publish."""
    owed = F.col("decision").isin("process", "deferred")
    return selection.agg(F.count_if(owed | F.col("decision").isin("unchanged", "no_matching_tag")).alias("considered"), F.count_if(owed).alias("pending"))


def comparison_top(rows: DataFrame, k: int = 10) -> DataFrame:
    """(…, held_back): the k rows most in need of attention, and how many are held back. A top-k, no full sort."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    total = rows.agg(F.greatest(F.count("*") - k, F.lit(0)).alias("held_back"))
    return rows.withColumn("__rank", rank).orderBy("__rank", "ord").limit(k).drop("__rank").join(F.broadcast(total), how="cross")


def first_seen_distinct(messages: DataFrame, by: str, message: str = "message", order: str = "ord") -> DataFrame:
    """(by, messages): distinct messages in the order in which they were first seen."""
    once = messages.groupBy(by, message).agg(F.min(order).alias("__at"))
    return once.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", message))), lambda x: x[message]).alias("messages"))


def block_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("kind").agg(F.count("*").alias("n"))


def degradations(blocks: DataFrame, handled: Iterable[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, kind, rendered_as): kinds of blocks without a writer of their own, once for each key. They are written as their text, and callouts need none."""
    lost = blocks.filter(~F.col("kind").isin(*handled, "callout"))
    return lost.select(*keys, "kind", F.lit("paragraph").alias("rendered_as")).distinct()


def run_report(selection: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Selection rows that were skipped or deferred, then the processed ones, as outcome rows."""
    status = F.when(F.col("decision") == "deferred", "deferred").otherwise("skipped")
    left = selection.filter(~F.col("decision").isin("process", "not_targeted")).select("doc_id", "name", status.alias("status"), F.col("decision").alias("reason"))
    return left.unionByName(outcomes.select("doc_id", "name", "status", "reason"))


def headline(totals: DataFrame) -> DataFrame:
    """totals with headline: what was synced, or would be."""
    rehearsal = (F.col("would_publish") > 0) & (F.col("published") == 0)
    text = F.when(F.col("seen") == 0, "All documents are up to date.").when(rehearsal, F.concat(F.lit("Would sync "), F.col("would_publish").cast("string"), F.lit(" of "), F.col("seen").cast("string"), F.lit(" documents")))
    return totals.withColumn("headline", text.otherwise(F.concat(F.lit("Synced "), F.col("published").cast("string"), F.lit(" of "), F.col("seen").cast("string"), F.lit(" documents"))))
