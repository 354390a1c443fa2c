import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docsync_spark.llm import shingles, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    fps = sorted({f for _, f in rows})
    at = {f: i for i, f in enumerate(fps)}
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    least = {}
    for d, f in rows:
        if d is not None:
            r = find(at[f])
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f, least.get(find(at[f]))) for d, f in rows), key=repr)


def sample_rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß", "X Y"]
    rows = [(None, "null id"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "One TWO three"), (7, "one two three")]
    for i in range(10, 250):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 400))]
        rows.append((i, " ".join(words)))
        if i % 7 == 0:
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            rows += [(1000 + i, " ".join(near)), (2000 + i, "\n".join(words)), (2000 + i, "\n".join(words))]
    return rows


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_matches_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(0), "component_id": F.lit("x"), "leaf": F.lit(1)})
    got = sorted(((r[0], r[1], r[2]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    want = brute_components([(d, signed(brute_fingerprint(t))) for d, t in rows])
    assert got == sorted(((d, f, c) for d, f, c in want), key=repr)


def test_shards_dealt_again_lose_no_link(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(300):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 8)):
            x ^= 1 << rng.randrange(64)
            fps.add(x)
            y = x ^ (1 << rng.randrange(64))
            fps.add(y)
    rows = [(i, signed(f)) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    want = {}
    for d, f, c in brute_components([(d, f) for d, f in rows]):
        want.setdefault(c, []).append(d)
    for shard_rows in (simhash.SHARD_ROWS, 4):
        got = {r[0]: r[1] for r in simhash.components(simhash.links(df.select("fp"), 2, shard_rows)).collect()}
        groups = {}
        for d, f in rows:
            groups.setdefault(got.get(f, f), []).append(d)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_tree_of_a_shard_loses_no_link():
    rng = np.random.default_rng(1)
    for bits, n in ((64, 1500), (14, 3000)):
        points = rng.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(4) if bits == 64 else rng.integers(0, 1 << bits, n, dtype=np.uint64)
        points = np.unique(np.concatenate([points, points[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))]))
        label = simhash.link(points, np.ones(len(points), bool), 2)
        near = np.bitwise_count(points[:, None] ^ points[None]) <= 2
        want = np.arange(len(points))
        while True:
            now = np.array([want[row].min() for row in near])
            if (now == want).all():
                break
            want = now
        assert (label == want).all()


def test_each_fingerprint_has_three_copies_and_shards_stay_small():
    assert [m.bit_count() for m in simhash.runs(0, 3)] == [21, 21, 22]
    assert all(m & 0b111 == 0b111 and m.bit_count() in (23, 24) for m in simhash.runs(0b111, 3))
    rng = np.random.default_rng(2)
    for n in (50_000, 800_000, 3_200_000):
        fps = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        largest = max(np.unique(fps & np.uint64(m), return_counts=True)[1].max() for m in simhash.runs(0, 3))
        assert largest < 30, (n, largest)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.one_of_each_component(docs).collect() == []


def test_one_of_each_component_keeps_the_smallest_id_once(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, "other words here now", None), (None, "lonely words of no id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, simhash.one_of_each_component(docs).collect()), key=repr)
    assert got == sorted([(3, text, "b"), (9, "other words here now", None), (None, "lonely words of no id", "c")], key=repr)


def test_components_with_the_same_smallest_id_keep_a_row_each(spark):
    """Rows of one id that are nothing alike are different documents."""
    texts = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(3)]
    rows = [(3, texts[0], "a"), (3, texts[1], "b"), (3, texts[1] + " more", "c"), (4, texts[0] + " more", "d"), (5, texts[2], "e"), (3, texts[1], "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for find in (simhash.near_duplicates, shingles.similar):
        got = [tuple(r) for r in simhash.one_of_each_component(docs, find=lambda d, *a, find=find, **k: find(d, *a, **k, radius=6)).collect()]
        assert sorted((d, t[:2]) for d, t, _ in got) == [(3, "0w"), (3, "1w"), (5, "2w")] and len({r[2] for r in got} & {"b", "c"}) == 1
