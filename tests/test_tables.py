import glob
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from docsync_spark.functions import scalars as S
from docsync_spark.functions import substrings
from docsync_spark.operators import notes, state
from docsync_spark.sources import tables


def files_of(folder):
    return {f: None for f in glob.glob(f"{folder}/shard=*/*.parquet")}


@pytest.fixture
def cache(spark, tmp_path):
    rows = spark.range(600).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.concat(F.lit("p"), "id").alias("payload"), F.lit(1).cast("long").alias("size"), (F.col("id") % 100).cast("int").alias("last_used_day"))
    table = tables.CacheTable.create("cache_" + uuid.uuid4().hex, rows, str(tmp_path / "cache"))
    yield table
    spark.sql(f"DROP TABLE {table.name}")


def test_a_lookup_reads_the_shards_of_its_keys(spark, cache):
    keys = spark.range(3).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    got = cache.lookup(keys.union(spark.createDataFrame([("zz",), (None,), ("",)], "key string")))
    assert sorted((r["payload"] or "", r["hit"]) for r in got.collect()) == [("", False)] * 3 + [("p0", True), ("p1", True), ("p2", True)]
    hits = cache.hits(keys)
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    scans = [x for x in re.findall(r"Scan parquet[^\n]*", plan) if "cache_" in x]
    assert scans and all("PartitionFilters" in x for x in scans)


def test_a_prune_rewrites_only_shards_that_lose_entries(spark, cache, tmp_path):
    cache.save(spark.range(1).select(F.lit("ffff").alias("key"), F.lit("new").alias("payload"), F.lit(1).cast("long").alias("size"), F.lit(500).alias("last_used_day")))
    before = files_of(tmp_path / "cache")
    old = cache.entries().filter("last_used_day < 5").select("shard").distinct()
    expected = sorted(r["shard"] for r in old.collect())
    left = cache.entries().filter("last_used_day >= 5").count()
    assert cache.prune(0, 95) == [] and cache.prune(90, 95) == expected
    assert cache.entries().count() == left and cache.entries().filter("last_used_day < 5").count() == 0
    after = files_of(tmp_path / "cache")
    shard = lambda f: re.search("shard=(..)", f)[1]
    assert {shard(f) for f in before if f not in after} == set(expected)
    assert all(f in after for f in before if shard(f) not in expected)
    cache.prune(90, 10_000)
    assert cache.entries().count() == 0 and not files_of(tmp_path / "cache")


def test_a_hit_renews_its_entry_alone(spark, cache, tmp_path):
    before = files_of(tmp_path / "cache")
    hit = cache.entries().filter("payload = 'p7'").select("key")
    cache.touch(hit, F.lit(300))
    assert [(r["payload"], r["last_used_day"]) for r in cache.entries().filter("last_used_day = 300").collect()] == [("p7", 300)]
    assert cache.entries().count() == 600
    assert len({re.search("shard=(..)", f)[1] for f in before if f not in files_of(tmp_path / "cache")}) == 1


def test_an_upsert_does_not_shuffle_the_old_state(spark, tmp_path):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored, name, keys = tables.BucketedState(spark, 4, str(tmp_path)), "state_" + uuid.uuid4().hex, ["doc_id", "page_index"]
    try:
        old = spark.range(400).select((F.col("id") % 100).alias("doc_id"), (F.col("id") / 100).cast("int").alias("page_index"), F.lit("old").alias("source_hash"))
        new = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(3).alias("page_index"), F.lit("new").alias("source_hash")).union(spark.createDataFrame([(500, 0, "new")], "doc_id long, page_index int, source_hash string"))
        stored.save(name, old, keys)
        for _ in range(2):
            plan = stored.merged(name, new, keys)._jdf.queryExecution().executedPlan().toString()
            old_side = plan[plan.index("FullOuter") :].split("Exchange")[0] if "Exchange" in plan else plan
            assert plan.count("Exchange hashpartitioning") == 1 and f"{name}" in old_side
            stored.upsert(name, new, keys)
            want = state.upsert_pages(old, new)
            assert sorted(map(tuple, stored.load(name).collect())) == sorted(map(tuple, want.collect()))
        # a writer that ended before its last step
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__next")
        assert stored.load(name).count() == 401
        stored.upsert(name, new, keys)
        assert stored.load(name).count() == 401
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_many_secrets_like_the_fold(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("ab*rÉ\n") for _ in range(n))
    secrets = [piece(rng.randint(6, 12)) for _ in range(150)] + ["redacted", "***redac", "d******r", "bbbbbbbb", "xx***red", "ted***bb", None, ""]
    texts = [None, ""] + ["".join(rng.choice([piece(3), rng.choice(secrets) or ""]) for _ in range(20)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    want = {r["id"]: r["t"] for r in df.select("id", S.redact(F.col("text"), secrets).alias("t")).collect()}
    assert {r["id"]: r["text"] for r in S.redact_all(df, "text", secrets).collect()} == want


def test_the_plan_holds_no_secret(spark):
    df = spark.createDataFrame([("my secret-number-00017 is out",)], "text string")
    sizes = []
    for n in (10, 10_000):
        out = S.redact_all(df, "text", [f"secret-number-{i:05}" for i in range(n)] + ["secret-number-00017"])
        sizes.append(len(out._jdf.queryExecution().analyzed().toString().split("LocalRelation")[0]))
        assert out.first()["text"] == "my ***redacted*** is out"
    assert max(sizes) < 1.2 * min(sizes)


def test_secrets_are_looked_up_by_a_hash_join(spark):
    """Work grows with texts and secrets, not with their product; copies of a text and a table of secrets do as well."""
    secrets = spark.range(20_000).selectExpr("format_string('secret%05d-key', id) as s")
    df = spark.createDataFrame([(i, f"a secret{i % 7:05}-key and secret00300-key") for i in range(50)] + [(50, None), (51, "")], "id int, text string")
    out = S.redact_all(df, "text", secrets)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["text"] for r in out.collect()} == {i: f"a {S.MASK} and {S.MASK}" for i in range(50)} | {50: None, 51: ""}


def test_segments_in_sql(spark):
    notes.register_segments(spark)
    body = "mine\n<!-- docsync:begin page-1 h=abcdef01 -->\ntext\n<!-- docsync:end page-1 -->\nend"
    spark.createDataFrame([(1, body), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("some_notes")
    got = spark.sql("SELECT id, s.* FROM some_notes, LATERAL note_segments(body) s ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, None, "mine", None), (1, 1, "page-1", "text", "abcdef01"), (1, 2, None, "end", None), (3, 0, None, "", None)]


def test_only_what_occurs_of_many_secrets_becomes_rows(spark):
    """Not every place of a text: 100,000 places hold three secrets, and strings like them that are none."""
    secrets = spark.range(5000).selectExpr("concat('secret-é', repeat('x', int(id % 7)), lpad(string(id), 5, '0')) as s")
    text = "word secret-é " * 7500 + "secret-é00000 secret-éx00001secret-éxx00002 secret-éxx00003 secret-é0000"
    texts = spark.createDataFrame([("k", text), ("n", None), ("o", "short"), ("p", "secret-é"), ("q", "00000 secret-é00000")], "`__key` string, text string")
    seen = sorted((r["__key"], r["__bytes"]) for r in substrings.occurring(texts, secrets).collect())
    assert set(seen) >= {("k", 14), ("k", 15), ("k", 16), ("q", 14)} and len(seen) <= 6
    want = spark.range(1).select(S.redact(F.lit(text), [r["s"] for r in secrets.limit(3).collect()]))
    assert S.redact_all(texts.filter("__key = 'k'"), "text", secrets).first()["text"] == want.first()[0]
