"""Running values of each key over rows sorted across all tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync_spark.sources.scratch import written

#: Aggregates of a stretch of rows, and how what comes from other stretches joins the row's own: the row's own side comes first.
_KINDS = {
    "last": (lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("__at"))), lambda v: F.last(v, True), F.coalesce),
    "first": (lambda v: F.min_by(v, F.when(v.isNotNull(), F.col("__at"))), lambda v: F.first(v, True), F.coalesce),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
}


def running(rows: DataFrame, by: list[str], order: list[Column], before: dict[str, tuple[str, str]] | None = None, after: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """rows with a column for each of before and after, name: (kind, column): the last, first, max or min value of what stands before or after the row.

    Only rows with the same ``by`` count, nulls being a key of their own; null values are passed over; without any the result is null. ``order`` need
    not settle every tie: rows that tie follow each other in any one order.

    The rows are sorted over all tasks by ``by`` and ``order`` and written once, so that a key with most of the rows lies in as many tasks as
    it takes. Each task's stretch of a key is one window; what is carried between tasks is one row for each task and side.
    """
    before, after = before or {}, after or {}
    sorted_ = written(rows.orderBy(*by, *order, F.monotonically_increasing_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = sorted_.withColumn("__part", F.shiftright("__at", 33))
    key = F.struct(*by).alias("__key")
    out = parts
    window = Window.partitionBy("__part", *by).orderBy("__at")
    frames = {**{k: window.rowsBetween(Window.unboundedPreceding, -1) for k in before}, **{k: window.rowsBetween(1, Window.unboundedFollowing) for k in after}}
    wanted = before | after
    own = {k: _KINDS[kind][1](F.col(v)).over(frames[k]) for k, (kind, v) in wanted.items()}
    out = out.withColumns({f"__own_{k}": v for k, v in own.items()})

    # a key goes on into a task's first rows or on from its last ones; nothing else is carried
    ends = parts.groupBy("__part").agg(F.min_by(key, "__at").alias("__first"), F.max_by(key, "__at").alias("__last"))
    sides = ends.select("__part", F.explode(F.array_distinct(F.array("__first", "__last"))).alias("__key"))
    sides = sides.select("__part", *[F.col("__key")[c].alias(f"__{c}") for c in by])
    same = lambda df: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], df["__part"] == F.col("__of"))
    edge = parts.join(F.broadcast(sides.withColumnRenamed("__part", "__of")), same(parts), "left_semi")
    totals = edge.groupBy("__part", *by).agg(*[_KINDS[kind][0](F.col(v)).alias(f"__sum_{k}") for k, (kind, v) in wanted.items()])
    across = Window.partitionBy(*by).orderBy("__part")
    reach = {**{k: across.rowsBetween(Window.unboundedPreceding, -1) for k in before}, **{k: across.rowsBetween(1, Window.unboundedFollowing) for k in after}}
    carried = totals.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__{c}") for c in by], *[_KINDS[kind][1](F.col(f"__sum_{k}")).over(reach[k]).alias(f"__in_{k}") for k, (kind, _) in wanted.items()])
    out = out.join(F.broadcast(carried), same(out), "left")  # two rows a task at most
    return out.select(*rows.columns, *[_KINDS[kind][2](f"__own_{k}", f"__in_{k}").alias(k) for k, (kind, _) in wanted.items()])
