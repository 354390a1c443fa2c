"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: Text bytes that one step inside a Python task works on, so that word lists stay small.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a local master, elsewhere an error."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, sizes become known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with place, its row's number in that order from 1, and for each of sums (name: column) what stands before the row.

    Rows are sorted over all tasks; each task's own running sums begin where the tasks before it end. Only one row
    for each task goes through a single one.
    """
    at, part = unused(df, "at"), unused(df, "part")
    sorted_ = materialize(df.orderBy(*order, F.monotonically_increasing_id()).withColumn(at, F.monotonically_increasing_id()))
    rows = sorted_.withColumn(part, F.shiftright(at, 33))
    inside = Window.partitionBy(part).orderBy(at)
    totals = rows.groupBy(part).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(part).alias(f"{part}_"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{part}_{c}") for c in totals.columns[1:]])
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumns({name: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for name, c in sums.items()})
    rows = rows.join(F.broadcast(starts), F.col(part) == F.col(f"{part}_"))
    rows = rows.withColumn("place", (F.col("place") + F.col(f"{part}_n")).cast("long")).withColumns({name: F.col(name) + F.col(f"{part}_s{i}") for i, name in enumerate(sums)})
    return rows.select(*df.columns, "place", *sums)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def utf8(texts) -> list[bytes]:
    """Texts of a batch as UTF-8, null as empty."""
    return [b"" if not isinstance(x, str) else x.encode("utf-8", "surrogatepass") for x in texts]


def steps(texts: list[bytes], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about limit bytes together; a longer text stands alone."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > limit:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


def text_steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about limit bytes of text, and the texts of each as UTF-8, null as empty; only one slice's texts are Python objects."""
    text = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at), [x or b"" for x in text.slice(at, to - at).to_pylist()]
        at = to


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """One list of an Arrow column for each array; of no arrays, no list."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def thinned(rows: DataFrame, keys: list[str], wanted: int, n: int) -> DataFrame:
    """About a quarter more rows than wanted of n, chosen by the keys' hash: a bounded sample without a sort of all."""
    if n <= wanted:
        return rows
    return rows.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 31)) < int((1 << 31) * min(1.0, 1.25 * wanted / n + 64 / n)))
