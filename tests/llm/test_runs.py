import hashlib
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsync_spark.llm import runs

SCHEMA = "doc_id long, text string, runs string, n_words int, start string"


def brute_runs(x, least, times):
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i + q - s
            smaller = any(all(x[k] == x[k + p] for k in range(s, s + length - p)) for p in range(1, q))
            if length >= max(least, times * q) and not smaller:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(rows, least=24, times=3, rewrite=None):
    out = []
    for key, text, *_ in rows:
        ws = (text or "").encode().split()
        rule = rewrite(key, len(ws)) if rewrite else None
        if rule:
            a, p = rule
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        found = brute_runs(ws, least, times)
        gone = {i for s, n, p in found for i in range(s + p, s + n)}
        out.append((key, len(ws), found, b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in df.collect()), key=repr)


def corpus(seed, vocabulary, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "\x1c", " "]
    rows = [(None, None), (0, ""), (1, " \n\t"), (None, "a " * 100), (2, "short text"), (3, "a b " * 30 + "c " + "a b " * 30)]
    for i in range(4, n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            root = [rng.choice(words) for _ in range(rng.randint(1, 12))]
            part = (root * rng.randint(1, 9))[: rng.randint(1, 90)]
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "edit"
            parts += part + [rng.choice(words) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "\n", " \x0b "]).join(parts)))
    return [(*r, "x", 1, "y") for r in [*rows, rows[8], rows[8]]]


@pytest.mark.parametrize(("seed", "vocabulary", "least", "times"), [(1, 200, 24, 3), (2, 2, 24, 3), (3, 1, 6, 3), (4, 3, 10, 2)])
def test_matches_brute_force(spark, seed, vocabulary, least, times):
    rows = corpus(seed, vocabulary, 60)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(runs.periodic_runs(docs, least=least, times=times)) == brute(rows, least, times)


def test_query_digests_and_rewritten_tails(spark, tmp_path):
    rows = corpus(5, 50, 120)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, _, found, collapsed in brute(rows, rewrite=runs.periodic_tail):
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        want.append((key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed))))
    assert any(runs.periodic_tail(r[0], 50) for r in rows)
    assert sorted(map(tuple, runs.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_empty_table_and_bounds(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert runs.periodic_runs(docs).collect() == []
    with pytest.raises(ValueError, match="periods"):
        runs.periodic_runs(docs, times=1)


def test_long_texts_in_near_linear_time():
    rng = random.Random(1)
    texts = [[0] * 200_000, [i % 7 for i in range(200_000)], [rng.randrange(2) for _ in range(200_000)]]
    began = time.time()
    found = [runs.runs_in(np.array(x)).tolist() for x in texts]
    assert time.time() - began < 60
    assert found[0] == [[0, 200_000, 1]]
    assert found[1] == [[0, 200_000, 7]]


def least_suffixes_first(x):
    out = []
    for i in range(len(x)):
        j = i + 1
        while j < len(x) and x[j:] > x[i:]:
            j += 1
        out.append(j)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_lyndon_array(x):
    ranks = [sorted(set(x)).index(v) for v in x]
    assert runs.lyndon_ends(ranks) == least_suffixes_first(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=12), st.integers(1, 9), st.lists(st.integers(0, 1), max_size=12), st.sampled_from([(3, 3), (6, 3), (4, 2)]))
def test_runs_of_stretches(root, times_over, rest, bounds):
    x = rest + root * times_over + rest[::-1] + root * 4
    found = [(a + s, n, p) for _, a, b in runs.stretches(np.array(x, np.int64), [len(x)], *bounds) for s, n, p in runs.runs_in(np.array(x[a:b]), *bounds).tolist()]
    assert found == brute_runs(x, *bounds)
