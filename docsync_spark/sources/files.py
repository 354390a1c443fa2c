"""Reading listings, indexes, archives, notes and images with Spark's file sources."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.functions.scalars import path_is_contained
from docsync_spark.sources.scratch import text_parts
from docsync_spark.sources.sinks import file_system

#: Of Spark's splits of small files, those that one task read at most.
SPLITS = 64
#: Bytes of content, and names of files, that a Python task gives out at once.
STEP_BYTES, STEP_NAMES = 1 << 20, 1 << 12


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of that name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")) or name.endswith("._COPYING_")


def _names(folder: str, recursive: bool) -> Iterator[str]:
    """The files in a folder that are not hidden."""
    store, at = file_system(folder)
    for x in store.get_file_info(fs.FileSelector(at, recursive=recursive)):
        below = x.path[len(at) :].strip("/")
        if x.type == fs.FileType.File and not any(map(_hidden, below.split("/"))):
            yield f"{folder}/{below}"


def _listed(batches: Iterator[pa.RecordBatch], recursive: bool) -> Iterator[pa.RecordBatch]:
    """(path) of all files of rows (path, folder)."""
    for batch in batches:
        for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
            names = _names(path, recursive) if folder else iter([] if _hidden(path.rpartition("/")[2]) else [path])
            while some := list(itertools.islice(names, STEP_NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) of rows (path)."""
    paths, contents, held = [], [], 0
    given = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, at = file_system(path)
            with store.open_input_stream(at, compression=None) as f:
                contents.append(f.read())
            paths.append(path)
            held += len(contents[-1])
            if held >= STEP_BYTES or len(paths) == STEP_NAMES:
                yield given()
                paths, contents, held = [], [], 0
    if paths:
        yield given()


def _whole_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, content) of each file in the folders that path, a pattern perhaps, stands for, and of the files that it stands for.

    Tasks list the folders and read the files by Arrow's file systems, as write_notes writes them, so that the driver knows only what the path itself stands
    for. In stores that Arrow can't open Spark's reader finds the files; its driver keeps a record of each.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = [(x.getPath().toString(), x.isDirectory()) for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []]
    tasks = 4 * spark.sparkContext.defaultParallelism
    try:
        store, first = file_system(found[0][0])
        known = store.get_file_info(first).type != fs.FileType.NotFound
    except (IndexError, OSError, pa.ArrowException):
        known = False
    if not known:
        return _by_spark(spark, path, recursive, tasks)
    roots = spark.createDataFrame(found, "path string, folder boolean").repartition(min(len(found), tasks))
    names = roots.mapInArrow(lambda b: _listed(b, recursive), "path string").repartition(tasks, "path")
    return names.mapInArrow(_read, "path string, content binary")


def _by_spark(spark: SparkSession, path: str, recursive: bool, tasks: int) -> DataFrame:
    """The same by Spark's reader, many files to a task: opening one counts as 4 MB in Spark's splits, so that small files come a few to each.

    As binary files, since the text source copies Hadoop's configuration for every file that it opens.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    return raw.coalesce(max(tasks, -(-raw.rdd.getNumPartitions() // SPLITS)))


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_blob_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, hash, type, id, subfiles, size) from files of lines hash:type:id:subfiles:size.

    The first line of a file is its schema version; lines of fewer than 5 parts are passed over; a
    size that is no whole number makes the whole document void. doc_id is the file's name.
    """
    lines = _whole_files(spark, path).select(_stem(F.col("path")).alias("doc_id"), F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("n", "line"))
    parts = F.split("line", ":")
    rows = lines.filter("n > 0").select("doc_id", parts.alias("p")).filter(F.size("p") >= 5)
    rows = rows.select("doc_id", F.col("p")[0].alias("hash"), F.col("p")[1].alias("type"), F.col("p")[2].alias("id"), F.col("p")[3].try_cast("int").alias("subfiles"), F.col("p")[4].try_cast("long").alias("size"))
    return rows.join(rows.filter("size is null").select("doc_id").distinct(), "doc_id", "left_anti")


def read_listing(spark: SparkSession, path: str, flavor: str = "cloud", limit: int | None = None) -> DataFrame:
    """(id, hash, name, doc_type, parent, deleted, pinned, synced, last_modified, version) of JSON metadata files, one each.

    A file that is no JSON object costs its row alone; deleted items are dropped. 'ssh' takes lastModified,
    else the id, as hash; 'cloud' the JSON's own. limit takes the first accepted items by id.
    """
    raw = _whole_files(spark, path).select(_stem(F.col("path")).alias("file_id"), F.try_parse_json(F.col("content").cast("string")).alias("j"))
    get = lambda key, kind="string": F.try_variant_get("j", f"$.{key}", kind)
    millis = get("lastModified").try_cast("long")
    id_ = F.coalesce(get("id"), F.col("file_id"))
    rows = raw.filter(F.schema_of_variant("j").startswith("OBJECT")).select(
        id_.alias("id"), F.coalesce(get("lastModified"), id_).alias("__ssh") if flavor == "ssh" else get("hash").alias("__ssh"), F.coalesce(get("visibleName"), id_).alias("name"),
        F.coalesce(get("type"), F.lit("DocumentType")).alias("doc_type"), F.coalesce(get("parent"), F.lit("")).alias("parent"), F.coalesce(get("deleted", "boolean"), F.lit(False)).alias("deleted"),
        F.coalesce(get("pinned", "boolean"), F.lit(False)).alias("pinned"), F.coalesce(get("synced", "boolean"), F.lit(True)).alias("synced"), F.timestamp_millis(millis).alias("last_modified"), get("version").alias("version"),
    ).withColumnRenamed("__ssh", "hash").filter("not deleted")
    return rows.orderBy("id").limit(limit) if limit else rows


def read_delimited_documents(spark: SparkSession, path: str, separator: str = "===FILE===") -> DataFrame:
    """(id, json) of a stream of documents between separators: the first line is the id, the rest the body."""
    rows = spark.read.option("lineSep", separator).text(path)
    text = F.regexp_replace("value", "^[\\r\\n]+", "")
    id_ = F.trim(F.substring_index(text, "\n", 1))
    return rows.select(id_.alias("id"), F.when(F.instr(text, "\n") > 0, F.substring(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("").alias("json")).filter("id <> ''")


def file_types(documents: DataFrame) -> DataFrame:
    """(id, file_type) of read_delimited_documents rows; bad JSON gives null."""
    return documents.select("id", F.try_variant_get(F.try_parse_json("json"), "$.fileType", "string").alias("file_type"))


def explode_archives(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(archive, member, content) of the zip files; members that would leave the root are refused, bad archives have none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    wanted = tuple(s.lower() for s in suffixes) if suffixes else None

    def run(batches):
        for batch in batches:
            for archive, content in batch.itertuples(index=False, name=None):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for info in z.infolist():
                    if not info.is_dir() and (wanted is None or info.filename.lower().endswith(wanted)):
                        yield pd.DataFrame({"archive": [archive], "member": [info.filename], "content": [z.read(info)]})

    members = files.mapInPandas(run, "archive string, member string, content binary")
    return members.filter(path_is_contained(F.split("member", "/")))


def read_notes(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(path, text, state): 'text' or 'unreadable' for what exists, 'absent' for wanted paths that don't."""
    files = _whole_files(spark, path, recursive=True)
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    rows = files.select("path", F.when(fine, F.col("content").cast("string")).alias("text"), F.when(fine, "text").otherwise("unreadable").alias("state"))
    if wanted is None:
        return rows
    return wanted.select("path").join(rows, "path", "left").withColumn("state", F.coalesce("state", F.lit("absent")))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


def text_of(page: str | None) -> str:
    """The text pieces of a page, stripped, one a line; what can't be parsed gives ''."""
    parser = _Text()
    try:
        parser.feed(page or "")
        parser.close()
    except Exception:
        return ""
    return "\n".join(parser.parts)


def html_to_text(df: DataFrame, html_col: str, out: str = "text") -> DataFrame:
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept).schema.add(out, "string")

    def run(batches):
        for batch in batches:
            for part in text_parts(batch, html_col):
                made = pa.array([text_of(x) for x in part.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*map(part.column, kept), made], names=[*kept, out])

    return df.mapInArrow(run, schema)


def epub_text(members: DataFrame) -> DataFrame:
    """(archive, text): the parts of each book in the order of their names, joined by a blank line."""
    parts = members.filter(F.lower("member").rlike(r"\.x?html?$")).select("archive", "member", F.col("content").cast("string").alias("html"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("member", "text"))))
    return html_to_text(parts, "html").groupBy("archive").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "\n\n").alias("text"))


def is_blank_image(width: int, height: int, channels: int, data: bytes, tolerance: int = 3) -> bool:
    """Fully transparent, or over white of grey levels within the tolerance; unreadable images are not blank."""
    if width <= 0 or height <= 0:
        return False
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 4:
        alpha = pixels[..., 3:] / 255
        if not alpha.any():
            return True
        pixels = pixels[..., :3] * alpha + 255 * (1 - alpha)
    grey = pixels @ np.array([0.114, 0.587, 0.299]) if pixels.shape[-1] == 3 else pixels[..., 0]
    return bool(np.rint(grey).max() - np.rint(grey).min() <= tolerance)


def scan_blank_images(spark: SparkSession, path: str, tolerance: int = 3) -> DataFrame:
    """(origin, blank) of each image."""
    images = spark.read.format("image").load(path).select("image.*").select("origin", "width", "height", "nChannels", "data")

    def run(batches):
        for batch in batches:
            blank = [is_blank_image(w, h, c, d, tolerance) for w, h, c, d in batch[["width", "height", "nChannels", "data"]].itertuples(index=False, name=None)]
            yield pd.DataFrame({"origin": batch["origin"], "blank": blank})

    return images.mapInPandas(run, "origin string, blank boolean")
