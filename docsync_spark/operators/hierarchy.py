"""Folders of a parent-pointer listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync_spark.functions.scalars import strip
from docsync_spark.operators.scan import running
from docsync_spark.sources.scratch import written

FOLDER = "CollectionType"


#: Ends each id in a folder's key; no id may hold it.
SIGN = "\x1f"
#: Sorts after whatever follows a key.
LAST = "\U0010ffff"


def _walked(walk: DataFrame) -> DataFrame:
    """walk (id, above, parts, ids) with parts and ids from the top; rows that never come to one, in or below a cycle, are absent.

    Each round joins every folder with the one that its pointer has reached, so that names of twice as many levels stand together.
    """
    open_ = walk.filter("above is not null").count()
    while open_:
        top = walk.groupBy(F.col("id").alias("__id")).agg(F.min(F.struct(F.col("parts").alias("p"), F.col("above").alias("a"), F.col("ids").alias("i"))).alias("top"))
        higher = walk.join(top, F.col("above") == F.col("__id"), "left")
        done = F.col("above").isNull()
        joined = lambda c, x: F.when(done, F.col(c)).otherwise(F.concat(F.col("top")[x], c)).alias(c)
        walk = written(higher.select("id", F.when(~done, F.col("top.a")).alias("above"), joined("parts", "p"), joined("ids", "i")))
        left = walk.filter("above is not null").count()
        if left == open_:
            break
        open_ = left
    return walk.filter("above is null").select("id", "parts", "ids")


def _started(folders: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """The first round of a walk over (id, name, parent); tops (id, parts, ids) are folders of known paths."""
    there = folders.select("id") if tops is None else folders.select("id").union(tops.select("id"))
    linked = folders.join(there.distinct().toDF("known"), F.col("parent") == F.col("known"), "left")
    names = F.when((F.col("parent") == "trash") & F.col("known").isNull(), F.array(F.lit("[TRASH]"), "name")).otherwise(F.array("name"))
    walk = linked.select("id", F.col("known").alias("above"), names.alias("parts"), F.array("id").alias("ids"))
    return written(walk if tops is None else walk.union(tops.select("id", F.lit(None).cast("string"), "parts", "ids")))


def _folders(listing: DataFrame) -> DataFrame:
    return listing.filter(F.col("doc_type") == FOLDER).select("id", strip(F.col("name")).alias("name"), "parent")


def resolve_folders(listing: DataFrame) -> DataFrame:
    """(id, parts): the names from the root to each folder, by pointer doubling over folders only.

    log2 of the depth joins, whatever the depth. An unknown parent ends the path; parent 'trash' puts '[TRASH]' in front.
    Folders in or below a parent cycle never come to an end and are absent, so a join finds them as null: once a
    round brings nobody to the top, all that is left is cycles. Of several folders with one id each has its row, and
    its children take the first by name.
    """
    return _walked(_started(_folders(listing))).select("id", "parts")


def folder_paths(listing: DataFrame) -> DataFrame:
    """(id, name, parent, parts, key) of every folder, for move_folders; one folder an id.

    key has the ids from the root on, each with a sign after it, so that a folder's subtree is one range of keys: what begins with its own.
    Folders in or below a cycle have null parts and key.
    """
    folders = _folders(listing)
    return _labelled(folders, _walked(_started(folders)))


def _labelled(folders: DataFrame, walked: DataFrame) -> DataFrame:
    key = F.array_join(F.transform("ids", lambda x: F.concat(x, F.lit(SIGN))), "")
    return folders.join(walked.select("id", "parts", key.alias("key")), "id", "left").select("id", "name", "parent", "parts", "key")


def move_folders(paths: DataFrame, changes: DataFrame) -> DataFrame:
    """paths after changes (id, name, parent, deleted): folders that are new, have another name or parent, or are gone; one row an id.

    The result is that of folder_paths for the changed listing. Walked are the subtrees of what has changed and of what now has a parent alone, which one
    range join of keys finds; all other paths are taken as they are, and those that the subtrees now hang on are where the walk ends. Folders in
    cycles are walked again each time. A range counts for all keys that sort after its start up to its end, so a running maximum of ends,
    over one sort of all keys across tasks, settles it however ranges lie in each other.
    """
    changes = written(changes.select("id", strip(F.col("name")).alias("name"), "parent", F.coalesce("deleted", F.lit(False)).alias("deleted")))
    ids = changes.select(F.col("id").alias("__id"))
    begun = paths.join(ids, F.col("id") == F.col("__id"), "left_semi").union(paths.join(ids, F.col("parent") == F.col("__id"), "left_semi"))
    ranges = begun.filter("key is not null").select(F.lit(0).alias("by"), F.lit(0).alias("kind"), F.col("key").alias("k"), F.concat("key", F.lit(LAST)).alias("end"), F.lit(None).cast("string").alias("id"))
    keyed = paths.filter("key is not null").select(F.lit(0), F.lit(1), "key", F.lit(None).cast("string"), "id")
    reached = running(ranges.union(keyed), ["by"], [F.col("k"), F.col("kind")], {"most": ("max", "end")}).filter("kind = 1 and most >= k").select("id")
    touched = written(reached.union(paths.filter("key is null").select("id")).union(changes.select("id")).distinct())

    same = paths.join(touched, "id", "left_anti")
    old = paths.join(touched, "id", "left_semi").join(changes.select("id"), "id", "left_anti").select("id", "name", "parent")
    folders = written(old.union(changes.filter("not deleted").select("id", "name", "parent")))
    above = same.join(folders.select(F.col("parent").alias("__parent")).distinct(), F.col("id") == F.col("__parent"), "left_semi")
    tops = above.select("id", "parts", F.filter(F.split("key", SIGN), lambda x: x != "").alias("ids"))
    return same.select("id", "name", "parent", "parts", "key").union(_labelled(folders, _walked(_started(folders, tops)).join(folders.select("id"), "id", "left_semi")))


def with_folders(listing: DataFrame) -> DataFrame:
    """Documents of a listing with folder_parts and in_cycle; one equi-join whatever the depth."""
    is_folder = listing.filter(F.col("doc_type") == FOLDER).select(F.col("id").alias("__folder")).distinct()
    first = resolve_folders(listing).groupBy(F.col("id").alias("__resolved")).agg(F.min("parts").alias("__parts"))
    places = is_folder.join(first, F.col("__folder") == F.col("__resolved"), "left").drop("__resolved")
    docs = listing.filter((F.col("doc_type") != FOLDER) | F.col("doc_type").isNull()).join(places, F.col("parent") == F.col("__folder"), "left")
    empty = F.array().cast("array<string>")
    parts = F.coalesce("__parts", F.when((F.col("parent") == "trash") & F.col("__folder").isNull(), F.array(F.lit("[TRASH]"))), empty)
    return docs.withColumn("folder_parts", parts).withColumn("in_cycle", F.col("__folder").isNotNull() & F.col("__parts").isNull()).drop("__folder", "__parts")
