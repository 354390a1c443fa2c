"""Content-addressed results: lookup, computing what is missing once, and eviction."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync_spark.functions.scalars import MASK, content_key, strip


def valid_entry(payload: Column) -> Column:
    return F.coalesce(F.length(payload) > 0, F.lit(False))


def cache_lookup(df: DataFrame, cache: DataFrame, key: str = "key", enabled: bool = True) -> DataFrame:
    """df with payload and hit; a disabled cache and an empty entry are misses. cache has one row a key."""
    if not enabled:
        return df.withColumns({"payload": F.lit(None).cast("string"), "hit": F.lit(False)})
    entries = cache.filter(valid_entry(F.col("payload"))).select(F.col("key").alias("__key"), "payload")
    return df.join(entries, F.col(key) == F.col("__key"), "left").withColumn("hit", F.col("__key").isNotNull()).drop("__key")


def cache_stats(cache: DataFrame, by: str | None = None) -> DataFrame:
    rows = cache.groupBy(by) if by else cache
    return rows.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def cache_hit_rate(cached: Column, transcribed: Column) -> Column:
    return F.try_divide(cached.cast("double"), (cached + transcribed).cast("double"))


def prune_cache(cache: DataFrame, max_age_days: int, now_day: Column) -> DataFrame:
    """What stays: entries used within the last max_age_days; 0 or less keeps all."""
    return cache if max_age_days <= 0 else cache.filter(F.col("last_used_day") >= now_day - max_age_days)


def touch(cache: DataFrame, hits: DataFrame, now_day: Column) -> DataFrame:
    """cache with last_used_day renewed for the keys of hits."""
    used = hits.select(F.col("key").alias("__key")).distinct()
    out = cache.join(used, F.col("key") == F.col("__key"), "left")
    return out.withColumn("last_used_day", F.when(F.col("__key").isNotNull(), now_day).otherwise(F.col("last_used_day"))).drop("__key")


def compute_misses(misses: DataFrame, fn: Callable[[str], str], secrets: Iterable[str] = (), parallelism: int | None = None) -> DataFrame:
    """(key, payload, error) of distinct misses (key, text); a failure is the row's error, redacted, not the job's."""
    hidden = sorted({s for s in secrets if len(s) >= 8}, key=lambda s: (-len(s), s))

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return fn(text), None
        except Exception as e:
            said = f"{type(e).__name__}: {e}"
            for s in hidden:
                said = said.replace(s, MASK)
            return None, said

    def run(batches):
        for batch in batches:
            done = [one(t) for t in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "payload": [p for p, _ in done], "error": [e for _, e in done]})

    rows = misses.select("key", "text").dropDuplicates(["key"])
    return (rows.repartition(parallelism) if parallelism else rows).mapInPandas(run, "key string, payload string, error string")


def apply_memoized(df: DataFrame, fingerprint: Column, fn: Callable[[str], str], cache: DataFrame, save: Callable[[DataFrame], DataFrame], secrets: Iterable[str] = (), parallelism: int | None = None) -> DataFrame:
    """df (with text) with result, error and source: 'blank', 'cache', 'computed' or 'error'.

    fn runs once for each distinct content that is neither blank nor cached. save gets the new rows
    (key, payload, error), writes them and returns what it wrote, so that they outlive this job;
    blank results are returned but are no cache entries.
    """
    blank = F.coalesce(strip(F.col("text")) == "", F.lit(True))
    keyed = df.withColumn("key", F.when(~blank, content_key(F.col("text"), fingerprint)))
    looked = cache_lookup(keyed, cache)
    new = save(compute_misses(looked.filter("not hit and key is not null"), fn, secrets, parallelism)).select(F.col("key").alias("__key"), F.col("payload").alias("__new"), "error")
    out = looked.join(new, F.col("key") == F.col("__key"), "left")
    source = F.when(F.col("key").isNull(), "blank").when(F.col("hit"), "cache").when(F.col("error").isNotNull(), "error").otherwise("computed")
    return out.withColumn("result", F.coalesce("payload", "__new", F.lit(""))).withColumn("source", source).drop("key", "__key", "__new", "payload", "hit")


def memo_stats(results: DataFrame) -> DataFrame:
    """(hits, blanks, calls, errors)."""
    return results.agg(*[F.count_if(F.col("source").isin(s)).alias(n) for n, s in (("hits", ["cache"]), ("blanks", ["blank"]), ("calls", ["computed", "error"]), ("errors", ["error"]))])
