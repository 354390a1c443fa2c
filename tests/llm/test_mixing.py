import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from docsync_spark.llm import mixing

GOLDEN = 2654435769


def spark_hash(*values):
    """Spark's xxhash64 of a row, as signed number."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = {s: 0.0 for s in sizes}
    left, still = 1.5 * sum(sizes.values()), set(sizes)
    while still:
        level = left / sum(weight[s] for s in still)
        full = {s for s in still if level * weight[s] > 2 * sizes[s]}
        if not full:
            for s in still:
                target[s] = level * weight[s]
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        still -= full
    return order, target


def brute(rows, block=mixing.BLOCK_WORDS):
    """taken of each row, in the order of rows."""
    docs = [(i, d, s, len((t or "").encode().split()), spark_hash(d, s, t)) for i, (d, t, s) in enumerate(rows)]
    sizes = {}
    for _, _, s, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    order, target = brute_targets(sizes)
    total = sum(target.values())
    ends, at = [], 0.0
    for s in order:
        ends.append((round(at / total * 2**32) if total else 0, round((at + target[s]) / total * 2**32) if total else 0, s))
        at += target[s]
    uses, rank = {}, {}
    for slot in range(int(-(-total // block))):
        point = slot * GOLDEN % 2**32
        for low, high, s in ends:
            if low <= point < high:
                r = rank[s] = rank.get(s, -1) + 1
                blocks = -(-sizes[s] // block)
                if r < 2 * blocks:
                    uses[s, r % blocks] = uses.get((s, r % blocks), 0) + 1
    taken = [0] * len(docs)
    for s in order:
        start = 0
        own = sorted((d for d in docs if d[2] == s), key=lambda d: (d[4], d[1] is not None, d[1] or 0, d[3]))
        for i, _, _, n, _ in own:
            for w in range(start // block, (start + n - 1) // block + 1) if n else ():
                taken[i] += uses.get((s, w), 0) * (min(start + n, (w + 1) * block) - max(start, w * block))
            start += n
    return sizes, target, taken


def corpus():
    rows = [(None, "no id here", "b"), (1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "word " * 5000, None), (5, "x y z", "a\x00"), (5, "x y z", "a\x00")]
    for i in range(10, 900):
        rows.append((i, f"w{i} " * (i * 7919 % 90), ["hot", "hot", "hot", "a", "b", "c", "d", "é", None][i % 9]))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "sid": F.lit(2), "h": F.lit("x"), "target": F.lit(0)})
    got = mixing.mix(docs).collect()
    sizes, target, taken = brute(rows)
    want = sorted(((d, len((t or "").split()), s, sizes[s], k) for (d, t, s), k in zip(rows, taken)), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["source"], r["source_size"], r["taken"]) for r in got), key=repr) == want
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"]
    by = {}
    for r in got:
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
    assert all(abs(by[s] - target[s]) <= 5 * mixing.BLOCK_WORDS for s in by)


def test_resampled_rows(spark):
    rows = corpus()
    _, _, taken = brute(rows)
    got = mixing.resampled(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = []
    for row, k in zip(rows, taken):
        n = len((row[1] or "").split())
        want += [row] * ((2 * k + n) // (2 * n) if n else 0)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table_and_no_words(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], kind)).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(corpus()[:20], "doc_id long, text string, source string")
    assert "Python" not in mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
