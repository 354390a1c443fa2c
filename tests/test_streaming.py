import datetime as dt

from pyspark.sql import functions as F

from docsync_spark.streaming import streams

SCHEMA = "doc_id string, version string, recipe string, ts timestamp"


def put(spark, folder, n, rows):
    spark.createDataFrame([(*r, dt.datetime(2024, 1, 1, n)) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_changes_are_emitted_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = []

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        query = streams.stream_changes(stream).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
        assert query.awaitTermination(120)

    put(spark, tmp_path / "in", 1, [("a", "1", "r"), ("b", "1", "r")])
    run()
    put(spark, tmp_path / "in", 2, [("a", "1", "r"), ("b", "2", "r"), ("c", "1", "r")])
    run()
    assert sorted(out) == [("a", "1", "r"), ("b", "1", "r"), ("b", "2", "r"), ("c", "1", "r")]


def test_sync_twice_gives_the_same_state(spark, tmp_path):
    put(spark, tmp_path / "in", 1, [("a", "1", "r"), ("bad", "1", "r")])
    recorded = []

    def publish(df, batch_id):
        return df.select("doc_id", "version", F.when(F.col("doc_id") == "bad", "failed").otherwise("published").alias("status"))

    for n in (1, 2):
        query = streams.stream_sync(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "c"), lambda df: df.dropDuplicates(["doc_id"]), publish, lambda df, b: recorded.append((b, sorted(map(tuple, df.collect())))))
        assert query.awaitTermination(120)
    assert recorded == [(0, [("a", "1", "published"), ("bad", "1", "failed")])]


def test_run_stats_as_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), "success", 1, 0) for h in range(3)] + [(dt.datetime(2024, 1, 5), None, 0, 0)]
    kind = "started_at timestamp_ntz, outcome string, published int, failed int"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    out = []
    stats = streams.stream_run_stats(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    query = stats.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: out.append(sorted((r["phrase"], r["n"]) for r in df.collect()))).start()
    assert query.awaitTermination(120)
    assert out[-1] == [("did not finish", 1), ("synced 1 document", 3)]
    assert streams.distinct_snapshots(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).isStreaming


def test_transitions_start_from_what_is_published_and_survive_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "doc_id string, version string, recipe string, ts timestamp"
    old = spark.createDataFrame([("same", "1", "r", dt.datetime(2024, 1, 1)), ("moved", "1", "r", dt.datetime(2024, 1, 1)), ("gone", "1", None, dt.datetime(2024, 1, 1))], kind)
    out = []

    def run():
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        query = streams.stream_transitions(stream, old, dt.timedelta(hours=3)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
        assert query.awaitTermination(120)

    put(spark, tmp_path / "in", 1, [("same", "1", "r"), ("moved", "2", "r"), ("fresh", "1", None)])
    run()
    assert sorted(out) == [("fresh", "1", None, "new"), ("moved", "2", "r", "changed")]
    put(spark, tmp_path / "in", 5, [("same", "1", "r"), ("fresh", "1", None)])
    run()
    run()  # nothing new: no row again
    assert sorted(out[2:]) == [("gone", "1", None, "orphaned"), ("moved", "2", "r", "orphaned")]
    put(spark, tmp_path / "in", 6, [("moved", "2", "r"), ("same", "1", "r2")])
    run()
    assert sorted(out[4:]) == [("moved", "2", "r", "new"), ("same", "1", "r2", "changed")]


def test_sessions_are_closed_once_and_late_rows_are_counted(spark, tmp_path):
    kind = "device int, started_at timestamp_ntz, outcome string"
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    late = streams.LateRows()
    spark.streams.addListener(late)
    out, ids = [], set()

    def run(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        sessions = streams.stream_sessions(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), gap="1 hour", watermark="2 hours")
        query = sessions.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).start()
        assert query.awaitTermination(120)
        ids.add(str(query.id))

    try:
        run([(1, at(1), "success"), (1, at(1, 30), "error"), (1, at(4), "error"), (2, at(8), None)])
        run([(1, at(2), "success"), (1, at(3), "success"), (2, at(8, 30), None), (2, at(20), None)])  # the first two belong to closed hours
        deadline = dt.datetime.now() + dt.timedelta(seconds=60)
        while len(late.ended) < 2 and dt.datetime.now() < deadline:
            pass
    finally:
        spark.streams.removeListener(late)
    assert sorted(out) == [(1, at(1), at(2, 30), 2, 1), (1, at(4), at(5), 1, 1), (2, at(8), at(9, 30), 2, 0)]
    assert sum(late.dropped[i] for i in ids) == 2


def test_documents_of_a_bucket_share_one_value_of_state(spark, tmp_path):
    """The state store holds a row a bucket, however many documents there are, and each document keeps its own time."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, n = [], 3 * streams.BUCKETS

    def run(hour, rows):
        rows.withColumn("ts", F.lit(f"2024-01-01 {hour:02}:00:00").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("doc_id long, version string, recipe string, ts timestamp").parquet(str(tmp_path / "in"))
        query = streams.stream_transitions(stream, None, dt.timedelta(hours=3)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("append").foreachBatch(lambda df, _: out.extend((r["doc_id"], r["change"]) for r in df.collect())).start()
        assert query.awaitTermination(120)
        return max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress)

    listed = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("1").alias("version"), F.lit("r").alias("recipe"))
    assert run(1, listed) <= 4 * streams.BUCKETS  # a value, and a timer in two orders, with room for stale ones
    assert len(out) == n
    run(3, listed.filter("doc_id % 2 = 0"))
    run(5, listed.filter("doc_id % 4 = 0"))
    gone = lambda: {d for d, change in out if change == "orphaned"}
    assert gone() == set(range(1, n, 2))
    run(7, listed.filter("doc_id % 4 = 0"))
    assert gone() == {d for d in range(n) if d % 4}
