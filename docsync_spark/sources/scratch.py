"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a configuration table that are sent to all executors.
SMALL = 10_000
#: Bytes of text of which a Python task makes rows at once.
STEP_BYTES = 1 << 20


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir. Where that is unset, a temporary one on a local master; elsewhere that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="docsync-")
    return f"{root}/scratch/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: computed once, and its lineage ends."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def configuration(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it has SMALL rows or fewer, which is checked; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def text_parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP_BYTES of that column: what a task holds as Python objects doesn't depend on how long a batch's texts are together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to
