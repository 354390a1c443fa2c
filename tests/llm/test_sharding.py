import random
import zlib
from collections import defaultdict

from docsync_spark.llm import sharding

SCHEMA = "doc_id long, text string, shard string, at int, kept string"


def rows_of(seed, n):
    rng = random.Random(seed)
    ids = [*range(n), None, None, 3, 3, 3]
    rng.shuffle(ids)
    return [(i, rng.choice([None, "", "é" * rng.randint(1, 9), "x" * rng.randint(1, 400), "same"]), "s", 1, f"k{i}") for i in ids]


def brute(rows, shards):
    sized = sorted(((-1 if r[0] is None else r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows))
    total, before, out, slots = sum(s for _, s, _ in sized), 0, [], defaultdict(int)
    for i, size, crc in sized:
        shard = (2 * before + size) * shards // (2 * total)
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return sorted(out)


def got(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect())


def test_matches_brute_force_and_balance(spark):
    for seed, n, shards in ((1, 300, 16), (2, 5, 16), (3, 200, 3)):
        rows = rows_of(seed, n)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert got(sharding.sharded(docs, shards)) == brute(rows, shards)
    held = defaultdict(int)
    for _, size, _, shard, _ in brute(rows_of(1, 300), 16):
        held[shard] += size
    assert max(held.values()) - min(held.values()) <= 2 * 402


def test_one_id_in_most_rows_and_one_giant(spark):
    rows = [(7, "same text", "s", 1, "k")] * 500 + [(i, "ab", "s", 1, "k") for i in range(20)]
    assert got(sharding.sharded(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows, 16)
    giant = [(1, "x" * 2_000_000, "s", 1, "k"), (2, "y", "s", 1, "k"), (0, None, "s", 1, "k")]
    assert got(sharding.sharded(spark.createDataFrame(giant, SCHEMA))) == brute(giant, 16)


def test_kept_columns_and_empty_table(spark):
    out = sharding.sharded(spark.createDataFrame(rows_of(4, 20), SCHEMA), keep=("at", "kept"))
    assert out.columns == ["doc_id", "at", "kept", "size", "text_crc32", "shard", "slot"]
    assert {(r["doc_id"], r["kept"]) for r in out.collect()} == {(r[0], r[4]) for r in rows_of(4, 20)}
    assert sharding.sharded(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_and_no_text_in_the_sort(spark):
    plan = sharding.sharded(spark.createDataFrame(rows_of(5, 9), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
