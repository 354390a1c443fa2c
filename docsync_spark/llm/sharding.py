"""Contiguous shards of nearly equal bytes by global prefix sums.

Rows stand in the order of their ids. They are sorted across all tasks and written once, without their texts; each task's rows and
bytes are then summed, so that one small row for each task says where its own running sums begin. A row's shard is the one of
equally long stretches of all bytes that holds the row's middle byte: every cut lies within half a row of its target,
and the slots of a shard are the rows' places less those before the shard. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import materialize, table, unused

SHARDS = 16


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, size, text_crc32, shard, slot) of every row of docs.

    size is the text's bytes in UTF-8 and one more, so that each row has a place of its own; a null text has no bytes and the
    checksum of an empty one. Null ids come first. Repeated ids, and rows that are equal in all, follow each other in any order and
    may be cut apart like any others. A row that is longer than a shard's share leaves the shards beside it empty.
    An empty table gives an empty result. Columns of keep may have any names but the result's own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = F.struct(*[F.col(k) for k in keep] or [F.lit(1).alias("one")]).alias("kept")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), kept)
    # the last key parts rows that are equal in all others, so that no id is more than its share of the sort
    ordered = rows.orderBy(F.col("id").asc_nulls_first(), "size", "crc", F.monotonically_increasing_id())
    placed = materialize(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))

    totals = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    every = Window.partitionBy(F.lit(0))
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")], F.sum("bytes").over(every).alias("total"))
    inside = Window.partitionBy("part").orderBy("at")
    rows = placed.withColumns({"row": F.row_number().over(inside) - 1, "sum": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(F.broadcast(starts), "part")
    middle = 2 * (F.col("sum") + F.col("bytes_before")) - F.col("size")
    rows = rows.withColumn("shard", F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("total"))).cast("int")).withColumn("place", F.col("row") + F.col("n_before"))

    first = F.broadcast(rows.groupBy("shard").agg(F.min("place").alias("first")))  # one row a shard
    own = {c: F.col("kept")[c] for c in keep}
    return rows.join(first, "shard").select(F.col("id").alias(id_col), *[v.alias(c) for c, v in own.items()], "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and the slot of every document."""
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_sharding": op13_sharding}
SQL = {
    "op13_sharding": """
    WITH RECURSIVE bits(i, k, c) AS (
        SELECT i, 0, i FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    sized AS (
        SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
            list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
        FROM documents
    ), summed AS (
        SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS text_crc32
        FROM sized, crc_table
    ), ends AS (
        SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM summed
    ), dealt AS (SELECT *, ((2 * upto - size) * 16) // (2 * total) AS shard FROM ends)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
    FROM dealt
    """
}
