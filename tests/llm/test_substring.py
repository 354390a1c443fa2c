import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docsync_spark.llm import substring


def brute(rows, length):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    counts = Counter(tuple(w[i : i + length]) for _, w in docs for i in range(len(w) - length + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if counts[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, vocabulary, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "a b", "\x1c"]
    shared = [[rng.choice(words) for _ in range(rng.randint(20, 120))] for _ in range(6)]
    rows = [(None, None), (0, ""), (1, " \n\t"), (2, "short text"), (None, "a " * 100)]
    for i in range(3, n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            own = [rng.choice(words) for _ in range(rng.randint(0, 60))]
            part = list(rng.choice(shared))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edit"
            if rng.random() < 0.3:
                part = part[rng.randint(0, 15) :]
            parts += own + (part if rng.random() < 0.6 else [])
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [rows[10], rows[10], (10_000, rows[11][1])]
    return rows


def test_matches_brute_force(spark):
    for seed, vocabulary in ((1, 2000), (2, 2), (3, 20)):
        rows = corpus(seed, vocabulary, 60)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k1": F.lit(1), "start": F.lit(2), "anchor": F.lit("x")})
        got = sorted((tuple(r)[:4] for r in substring.remove_repeats(docs).collect()), key=repr)
        assert got == brute(rows, 35)


def test_other_lengths_and_kept_text(spark):
    rows = corpus(4, 50, 40)
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=9, anchor=4).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute(rows, 9)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_blocks_are_parsed_and_larger_ones_counted(spark, monkeypatch):
    """One anchor in thousands of different phrases."""
    rng = random.Random(9)
    hot = [f"hot{i}" for i in range(8)]
    sides = [[f"s{rng.randrange(40)}" for _ in range(30)] for _ in range(60)]
    rows = []
    for i in range(3000):
        before, after = list(rng.choice(sides)), list(rng.choice(sides))
        before[rng.randrange(30)] = f"b{i}"
        after[rng.randrange(30)] = f"a{i}"
        rows.append((i, " ".join(before + hot + after)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 35)
    assert sum(r[2] > 0 for r in want) > 900
    for most in (1 << 16, 100):
        monkeypatch.setattr(substring, "MOST", most)
        assert sorted((tuple(r)[:4] for r in substring.remove_repeats(docs).collect()), key=repr) == want


def test_longest_factors_of_a_block():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n, width = int(rng.integers(1, 12)), int(rng.integers(1, 6))
        block = np.sort(rng.integers(0, 3, n))
        sides = rng.integers(1, 3, (2, n, width)).astype(np.uint64)
        for side in sides:
            for row, k in zip(side, rng.integers(0, width + 1, n)):
                row[k:] = 0
        common = lambda x, y: int(np.logical_and.accumulate((x == y) & (x != 0)).sum())
        left, right = sides
        want = np.full((n, width + 1), -1)
        for i in range(n):
            for j in range(width + 1):
                if j and left[i, j - 1] == 0:
                    continue
                want[i, j] = max((common(right[i], right[p]) for p in range(n) if p != i and block[p] == block[i] and common(left[i], left[p]) >= j), default=-1)
        assert (substring.longest(block, left, right) == want).all()
