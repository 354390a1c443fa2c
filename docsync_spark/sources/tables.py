"""Catalog tables that lookups and upserts read no more of than they must."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.operators import memo, state
from docsync_spark.sources.scratch import scratch_folder


def shard_of(key: Column) -> Column:
    """The first two characters of a content key: 256 shards of about equal size, since keys are digests."""
    return F.substring(key, 1, 2)


class CacheTable:
    """A cache partitioned by shard: (key, payload, size, last_used_day, ...), one row a key.

    A lookup of keys reads their shards alone, by dynamic partition pruning; renewing and pruning entries rewrites the shards that change and no
    other. Each rewrite is one dynamic partition overwrite, which appears whole when the job ends. Writers have to take turns.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def create(cls, name: str, cache: DataFrame, path: str | None = None) -> CacheTable:
        """A new table of these entries, in a new shared folder if no path is given. Large shards become several files."""
        rows = cache.withColumn("shard", shard_of(F.col("key"))).hint("rebalance", "shard")
        rows.write.format("parquet").partitionBy("shard").option("path", path or scratch_folder(cache.sparkSession)).saveAsTable(name)
        return cls(cache.sparkSession, name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def hits(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """The entries of these keys."""
        asked = keys.filter(F.length(key) > 0).select(F.col(key).alias("key"), shard_of(F.col(key)).alias("shard")).distinct()
        return self.entries().join(asked, ["shard", "key"], "left_semi")

    def lookup(self, df: DataFrame, key: str = "key") -> DataFrame:
        """df with payload and hit, as memo.cache_lookup has them."""
        return memo.cache_lookup(df, self.hits(df, key).select("key", "payload"), key)

    def save(self, new: DataFrame) -> None:
        """Puts in entries whose keys the table lacks."""
        columns = self.entries().columns
        new.withColumn("shard", shard_of(F.col("key"))).select(*columns).write.insertInto(self.name)

    def _rewrite(self, rows: DataFrame) -> None:
        """Puts these rows in place of all in their shards."""
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "dynamic")
        try:
            rows.select(*self.entries().columns).hint("rebalance", "shard").write.insertInto(self.name, overwrite=True)
        finally:
            self.spark.conf.set(setting, before)

    def touch(self, hits: DataFrame, now_day: Column) -> None:
        """Renews last_used_day of the keys of hits; other shards stay as they are."""
        used = hits.filter(F.length("key") > 0).select("key", shard_of(F.col("key")).alias("shard")).distinct()
        there = self.entries().join(F.broadcast(used.select("shard").distinct()), "shard", "left_semi")  # 256 rows at most
        self._rewrite(memo.touch(there, used, now_day))

    def prune(self, max_age_days: int, now_day: int) -> list[str]:
        """Drops entries that were last used over max_age_days ago; 0 or less drops none. Returns the shards that lost any."""
        if max_age_days <= 0:
            return []
        old = F.col("last_used_day") < now_day - max_age_days
        found = self.entries().groupBy("shard").agg(F.count_if(old).alias("old"), F.count("*").alias("n")).filter("old > 0").collect()  # 256 rows at most
        some, all_ = [r["shard"] for r in found if r["old"] < r["n"]], [r["shard"] for r in found if r["old"] == r["n"]]
        if some:
            self._rewrite(memo.prune_cache(self.entries().filter(F.col("shard").isin(some)), max_age_days, F.lit(now_day)))
        for shard in all_:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (shard = '{shard}')")
            location = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").first()["data_type"]
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{location}/shard={shard}")
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return sorted([*some, *all_])


class BucketedState:
    """State tables bucketed and sorted by their keys, which are not null: an upsert shuffles the new rows alone.

    The merged table is written beside the old one and takes its name when it is whole. Between these two moments ``load`` finds the new
    one under its own name, so that a writer that dies loses nothing. Writers have to take turns.
    """

    def __init__(self, spark: SparkSession, buckets: int = 64, folder: str | None = None):
        self.spark, self.buckets, self.folder = spark, buckets, folder

    def _write(self, name: str, df: DataFrame, keys: list[str]) -> None:
        folder = f"{self.folder}/{name}-{uuid.uuid4().hex}" if self.folder else scratch_folder(self.spark)
        df.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", folder).mode("overwrite").saveAsTable(name)

    def save(self, name: str, df: DataFrame, keys: list[str]) -> None:
        """A new table, one shuffle."""
        self._write(name, df.repartition(self.buckets, *keys), keys)

    def load(self, name: str) -> DataFrame:
        return self.spark.table(name if self.spark.catalog.tableExists(name) else f"{name}__next")

    def merged(self, name: str, new: DataFrame, keys: list[str], policies: Mapping[str, str] | None = None) -> DataFrame:
        return state.upsert(self.load(name), new, keys, policies, null_keys=False)

    def upsert(self, name: str, new: DataFrame, keys: list[str], policies: Mapping[str, str] | None = None) -> None:
        """Puts new rows in by key, as state.upsert does. A bucket is one task and one file."""
        if not self.spark.catalog.tableExists(name):  # an earlier writer ended before its last step
            self.spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
        self._write(f"{name}__next", self.merged(name, new, keys, policies), keys)
        self.spark.sql(f"DROP TABLE {name}")
        self.spark.sql(f"ALTER TABLE {name}__next RENAME TO {name}")
