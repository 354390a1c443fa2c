import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsync_spark.llm import topk


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, queries, k):
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = set()
    for q, v in {(i, tuple(v)) for i, v in clean if queries(i)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in clean if j != q and len(w) == len(v))[:k]
        out |= {(q, v, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return sorted((q, r, j, s) for q, _, r, j, s in out)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(1500)]
    rows += [(5000 + i, rows[0][1]) for i in range(700)]  # one very common vector
    rows += [(9000, None), (9050, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (9100, [math.nan] * 8), (9150, [math.inf] * 8), (None, [1.0] * 8), (9200, []), (9250, [1.0]), (9251, [2.0]), (9300, [3e6, -1.0]), (9301, [1e6, 5.0]), (9350, [1e9, 0.5, 0.0]), (9351, [0.01, 7.0, 1.0]), (9352, [-0.02, 1e9, 3.0]), (9400, [4e5, 1.0, 0.0, 0.0]), (9401, [5e5, 2.0, 0.0, 0.0]), (9402, [6e5, 0.0, 0.0, 0.0])]
    rows += [rows[3], rows[3], (50, rows[50][1]), (100, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"cell": F.lit("x"), "kth": F.lit(1), "v": F.lit(2)})
    vectors = topk.quantized(df, "vec_id", "embedding")
    for components in (1 << 23, 512):
        got = topk.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, shard_components=components).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, lambda i: i % 50 == 0, 5)


def test_fewer_candidates_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    vectors = topk.quantized(spark.createDataFrame([(0, [1.0]), (1, [0.5])], kind), "vec_id", "embedding")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(vectors, vectors.filter("vec_id = 0")).collect()] == [(0, 1, 1, 256 * 128)]
    empty = topk.quantized(spark.createDataFrame([], kind), "vec_id", "embedding")
    assert topk.exact_top_k(empty, empty).collect() == []


def test_most_balls_are_skipped():
    rng = np.random.default_rng(0)
    centers = rng.integers(-3000, 3000, (40, 16))
    rows = (centers[rng.integers(0, 40, 20000)] + rng.integers(-50, 50, (20000, 16))).astype(np.int32)
    tree = topk.BallTree(rows, np.arange(20000))
    seen = []
    bound = tree.bound
    tree.bound = lambda node, q, norm: seen.append(node) or bound(node, q, norm)
    q = rows[:1]
    tree.search(q, np.arange(1), 5, np.full(1, topk.LOWEST))
    assert len(seen) < len(tree.nodes) / 2


def test_scores_beyond_a_long_are_an_error(spark):
    for rows in ([(0, [3e9]), (1, [3e9])], [(0, [1e300]), (1, [1.0])]):
        vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
        with pytest.raises(Exception, match="does not fit a long|too large for exact"):
            topk.exact_top_k(vectors, vectors.filter("vec_id = 0")).collect()


def test_most_shards_of_clustered_vectors_are_dropped_before_the_shuffle(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 4, (32, 16))
    rows = [(int(i), (centers[i % 32] + rng.normal(0, 0.1, 16)).tolist()) for i in range(6000)]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    report = {}
    got = topk.exact_top_k(vectors, vectors.filter("vec_id % 500 = 0"), shard_components=16 * 200, least_shards=32, report=report).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, lambda i: i % 500 == 0, 5)
    assert report["searched"] < report["pairs"] / 4, report


def test_scores_near_the_ends_of_a_long(spark):
    big = (1 << 54) * 0.75  # times 256: between 2^61 and 2^62
    rows = [(0, [1.875e9 / 256 * 1.0, 0.0]), (1, [1.0, 0.0]), (50, [9.4e6, 1.0]), (51, [9.6e6, 0.0]), (52, [-9.6e6, 0.5]), (53, [9.0e6, -2.0]), (100, [2.0, big]), (101, [0.0, -1.5 / 256]), (102, [3.0, 1 / 256])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    want = [r for r in brute([r for r in rows if r[0] != 100], lambda i: i == 50, 5)]
    assert max(r[3] for r in want) > 5.9e18
    few = vectors.filter("vec_id <> 100")
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(few, few.filter("vec_id = 50")).collect()) == want
    own = vectors.filter("vec_id >= 100")  # a component beyond 2^61
    got = topk.exact_top_k(own, own.filter("vec_id = 100")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute([r for r in rows if r[0] >= 100], lambda i: i == 100, 5)


def test_lowest_long_counts(spark):
    vectors = spark.createDataFrame([(0, [-(1 << 62), 1]), (1, [2, 0]), (2, [1, 1])], "vec_id long, v array<long>")
    got = topk.exact_top_k(vectors, vectors.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 2, 1 - (1 << 62)), (2, 1, -(1 << 63))]
