"""Structured Streaming over successive listing snapshots and runs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from docsync_spark.functions.scalars import describe_run


#: Documents share the state of a bucket, so that a batch reads and writes one value for each bucket and not one for each document.
BUCKETS = 4096


class _Documents(StatefulProcessor):
    """What is known of the documents of one bucket: {doc_id: (value, ...)}, in the state store as one Arrow stream."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "documents binary, timer long")

    def _load(self) -> tuple[dict[str | None, tuple], int | None]:
        """The documents, and when the bucket's timer rings."""
        if not self._seen.exists():
            return {}, None
        stored, timer = self._seen.get()
        with pa.ipc.open_stream(stored) as reader:
            ids, *values = (column.to_pylist() for column in reader.read_all().columns)
        return dict(zip(ids, zip(*values, strict=True), strict=True)), timer

    def _save(self, known: dict[str | None, tuple], timer: int | None = None) -> None:
        if not known:
            self._seen.clear()
            return
        columns = [pa.array(list(known)), *map(pa.array, zip(*known.values(), strict=True))]
        table = pa.table(columns, names=[str(i) for i in range(len(columns))])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self._seen.update((sink.getvalue().to_pybytes(), timer))

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(doc_id, version, recipe, at) by time; a bucket's rows may come in several frames, each in any order."""
        every = [row for batch in rows for row in zip(*(batch[c].tolist() for c in ("doc_id", "version", "recipe", "at")), strict=True)]
        for *texts, at in sorted(every, key=lambda row: row[3]):
            yield (*(x if isinstance(x, str) else None for x in texts), at)

    def close(self) -> None:
        pass


def _bucketed(rows: DataFrame):
    """rows by bucket, with the time in microseconds, an unknown one first."""
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))
    key = F.col("doc_id").cast("string")
    return rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), key.alias("doc_id"), "version", "recipe", at.alias("at"), "ts").groupBy("bucket")


class _Changes(_Documents):
    """Remembers the version and recipe last emitted for a document."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, _ = self._load()
        out = []
        for doc_id, version, recipe, _ in self._in_order(rows):
            if known.get(doc_id) != (version, recipe):
                known[doc_id] = (version, recipe)
                out.append((doc_id, version, recipe))
        if out:
            self._save(known)
            yield pd.DataFrame(out, columns=["doc_id", "version", "recipe"])


def stream_changes(listing_stream: DataFrame) -> DataFrame:
    """(doc_id, version, recipe) whenever either differs from what was last emitted. Needs the RocksDB state store.

    Input: (doc_id, version, recipe, ts). State is three strings a document, spread by doc_id over BUCKETS values.
    """
    return _bucketed(listing_stream).transformWithStateInPandas(_Changes(), "doc_id string, version string, recipe string", "Append", "None")


class _Transitions(_Documents):
    """Remembers a document's last version and recipe, and until when it counts as present. A bucket's timer rings when the first of its documents is due."""

    def __init__(self, gone_after_ms: int):
        self._gone_after = gone_after_ms

    def _keep(self, known: dict, doc_id, version, recipe, at: int) -> None:
        until = at // 1000 + self._gone_after
        known[doc_id] = (version, recipe, max(until, known[doc_id][2]) if doc_id in known else until)

    def _set(self, known: dict, timer: int | None) -> None:
        """A timer that rings for nothing is harmless, so an earlier one is only added."""
        first = min((until for *_, until in known.values()), default=None)
        if first is not None and (timer is None or first < timer):
            self._handle.registerTimer(first)
            timer = first
        self._save(known, timer)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known, timer = self._load()
        for row in self._in_order(iter([initialState])):
            self._keep(known, *row)
        self._set(known, timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        out = []
        for doc_id, version, recipe, at in self._in_order(rows):
            if doc_id not in known or known[doc_id][:2] != (version, recipe):
                out.append((doc_id, version, recipe, "changed" if doc_id in known else "new"))
            self._keep(known, doc_id, version, recipe, at)
        self._set(known, timer)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "version", "recipe", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, timer = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        gone = [(doc_id, version, recipe, "orphaned") for doc_id, (version, recipe, until) in known.items() if until <= now]
        self._set({d: v for d, v in known.items() if v[2] > now}, timer if timer is not None and timer > now else None)
        if gone:
            yield pd.DataFrame(gone, columns=["doc_id", "version", "recipe", "change"])


def stream_transitions(listing_stream: DataFrame, published: DataFrame | None = None, gone_after: dt.timedelta = dt.timedelta(days=1), watermark: str = "0 seconds") -> DataFrame:
    """(doc_id, version, recipe, change): a document is new, has changed, or is orphaned, as no snapshot has shown it for gone_after.

    Input: (doc_id, version, recipe, ts), ts the time of the snapshot; published has the same columns, as of the last publication, one row a
    document, and is what the state starts from. Needs the RocksDB state store. State is one row a document, spread by doc_id over BUCKETS values
    with a timer each; an orphan's goes, so that the state holds what is there and no more. Time is that of the snapshots: while none comes, nothing is orphaned.
    """
    stream = listing_stream.select("doc_id", "version", "recipe", "ts").withWatermark("ts", watermark)
    first = _bucketed(published.select("doc_id", "version", "recipe", "ts")) if published is not None else None
    made = _bucketed(stream).transformWithStateInPandas(_Transitions(int(gone_after.total_seconds() * 1000)), "doc_id string, version string, recipe string, change string", "Append", "EventTime", initialState=first)
    return made.withColumn("doc_id", F.col("doc_id").cast(listing_stream.schema["doc_id"].dataType))


def distinct_snapshots(listing_stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Without replays of the same document version within the watermark."""
    return listing_stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["doc_id", "version"])


def stream_run_stats(runs_stream: DataFrame, period: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """(start, phrase, n): runs by what they amount to in each period. started_at may be of either timestamp type."""
    phrase = describe_run(F.col("outcome"), F.col("published"), F.col("failed"), F.lit(None).cast("string"))
    rows = runs_stream.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", watermark)
    return rows.groupBy(F.window("at", period).alias("w"), phrase.alias("phrase")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "phrase", "n")


def stream_sessions(runs_stream: DataFrame, by: str = "device", gap: str = "6 hours", watermark: str = "1 hour") -> DataFrame:
    """(by, start, end, runs, failed): runs of one ``by`` that follow each other within the gap, once the watermark has closed them.

    end is the gap after the last run. Rows that come after the watermark has passed the session that they would belong to are dropped; late_rows counts them.
    """
    rows = runs_stream.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", watermark)
    sessions = rows.groupBy(F.session_window("at", gap).alias("w"), by).agg(F.count("*").alias("runs"), F.count_if(F.col("outcome") == "error").alias("failed"))
    return sessions.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "runs", "failed")


class LateRows(StreamingQueryListener):
    """Counts, for each query, the rows that its stateful operators dropped as too late. Add it to spark.streams before the query starts."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


def stream_sync(listing_stream: DataFrame, checkpoint: str, select: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], DataFrame], record: Callable[[DataFrame, int], None]):
    """A query that selects, publishes and records each snapshot.

    publish writes notes and returns an outcome row for each document; record runs after it and only for
    rows that it got back, so state never runs ahead of notes. Both get the batch's number and have
    to give the same again when a batch is repeated. A document's failure is a row, not an exception.
    """

    def tick(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            record(publish(select(batch), batch_id), batch_id)
        finally:
            batch.unpersist()

    return listing_stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
