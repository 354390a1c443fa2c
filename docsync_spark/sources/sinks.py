"""Writing notes, transcripts, reports and state snapshots."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.functions import scalars as S


def file_system(root: str):
    """(file system, path) of a folder given by a path or a URI that Arrow can open: file, hdfs, s3, gs, abfs."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.realpath(root.removeprefix("file:"))


def write_notes(df: DataFrame, root: str) -> None:
    """Writes (path, text) rows to files under root, a folder that all executors share, by path or URI.

    Each file is written beside its place and then moved there, so that a repeated task leaves the
    same. Files are what takes time, so rows are dealt to all tasks however few bytes they are. Paths that leave the root, by name or, on a local file system, by link, are refused.
    """
    bad = df.filter(~S.path_is_contained(F.split("path", "/"))).limit(1).count()
    if bad:
        raise ValueError("a path leaves the root")

    def run(rows):
        store, base = file_system(root)
        made = set()
        for row in rows:
            target = f"{base}/{row['path']}"
            folder = target.rpartition("/")[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                if isinstance(store, fs.LocalFileSystem) and os.path.commonpath([os.path.realpath(base), os.path.realpath(folder)]) != os.path.realpath(base):
                    raise ValueError(f"leaves the root: {row['path']}")
                made.add(folder)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write((row["text"] or "").encode("utf-8", "surrogatepass"))
            store.move(part, target)

    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    df.select("path", "text").repartition(tasks, "path").foreachPartition(run)


def render_transcripts(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, transcript): a line of JSON meta data, then for each page its header and its error or text.

    docs: (doc_id, meta struct, body_text); pages: (doc_id, number, label, breadcrumbs, text, error).
    The body text follows if no page gave text.
    """
    text = S.strip(F.coalesce("text", F.lit("")))
    body = F.coalesce(F.nullif("error", F.lit("")), text)
    header = S.section_header(S.page_label(F.col("number"), F.col("label")), F.coalesce("breadcrumbs", F.array().cast("array<string>")))
    part = F.concat(header, F.lit("\n\n"), F.when(body != "", F.concat(body, F.lit("\n\n"))).otherwise(""))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", part.alias("part")))), lambda x: x["part"]), "").alias("parts"), F.bool_or(text != "").alias("some"))
    out = docs.join(whole, "doc_id", "left")
    extra = F.when(~F.coalesce("some", F.lit(False)) & (F.coalesce("body_text", F.lit("")) != ""), F.concat("body_text", F.lit("\n"))).otherwise("")
    return out.select("doc_id", F.concat(F.to_json("meta"), F.lit("\n\n"), F.coalesce("parts", F.lit("")), extra).alias("transcript"))


def report_json(totals: DataFrame, outcomes: DataFrame, by: str = "run_id", warnings: DataFrame | None = None) -> DataFrame:
    """(by, report): each run's totals, documents and warnings, (by, ord, message), as one JSON object."""
    fields = [c for c in outcomes.columns if c not in (by, "ord")]
    docs = outcomes.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("doc")))), lambda x: x["doc"]).alias("documents"))
    joined = totals.join(docs, by, "left")
    if warnings is not None:
        said = warnings.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"]).alias("warnings"))
        joined = joined.join(said, by, "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    return joined.select(by, F.to_json(F.struct(*totals.columns, "documents", *(["warnings"] if warnings is not None else []))).alias("report"))


def inventory_json(rows: DataFrame) -> DataFrame:
    """(line): each row as a JSON object; one file of lines when written as text."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


class StateTables:
    """Snapshots of named tables as numbered Parquet folders: the newest one that was written to its end counts.

    A snapshot appears with Spark's own mark of a finished write and is never changed, so that readers always
    find a whole one and keep the one that they opened.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _newest(self, name: str) -> tuple[int, str | None]:
        """(number, path) of the newest finished snapshot."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/v-*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        folders = [x.getPath().getParent() for x in found or ()]
        return max(((int(p.getName().split("-")[1]), p.toString()) for p in folders), default=(0, None))

    def save(self, name: str, df: DataFrame) -> None:
        df.write.parquet(f"{self.root}/{name}/v-{self._newest(name)[0] + 1}-{uuid.uuid4().hex}")

    def load(self, name: str) -> DataFrame | None:
        path = self._newest(name)[1]
        return None if path is None else self.spark.read.parquet(path)

    def counts(self, names: list[str]) -> dict[str, int]:
        return {n: df.count() for n in names if (df := self.load(n)) is not None}
