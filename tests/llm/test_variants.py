import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsync_spark.llm import variants

SCHEMA = "doc_id long, text string, word string, n int, `key` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(x, y):
    x, y = sorted((x, y), key=len, reverse=True)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(x) == len(y) + 1 and any(x[:i] + x[i + 1 :] == y for i in range(len(x)))


def counted(rows, edited):
    n = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if edited and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return n


def brute(rows, edited=True, length=7, least=2, ratio=10):
    n = {w: c for w, c in counted(rows, edited).items() if len(w) >= length and c >= least}
    near = {w: [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def corpus(seed, letters, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 12))) for _ in range(25)]
    rows = [(None, None), (0, ""), (None, " \n"), (1, "1234 --- ~"), (2, "Ünïcödé Ünïcödé ünïcödé")]
    for i in range(3, n):
        ws = []
        for _ in range(rng.randint(0, 80)):
            w = base[min(int(rng.expovariate(0.4)), 24)]
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice([rng.choice(letters), "", "", w[at] * 2]) + w[at + 1 :]
            ws.append(rng.choice([w, w, w.upper(), w.title()]))
        rows.append((i if rng.random() < 0.9 else None, rng.choice([" ", "-", "\n", "9"]).join(ws)))
    return [(*r, "w", 1, "k") for r in rows + rows[5:9] * 3]


def got(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=repr)


@pytest.mark.parametrize(("seed", "letters", "most"), [(1, "abcdeé", 1 << 12), (2, "ab", 3), (3, "xyÀÿ×", 2)])
def test_matches_brute_force(spark, seed, letters, most):
    rows = corpus(seed, letters, 60)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(variants.variants(docs, spelt=variants.misspelt, most=most)) == brute(rows)


def test_other_bounds_and_no_edits(spark):
    rows = [*corpus(5, "abc", 40), (99, "pqrstuv " + "pqrstu " * 3 + "pqrst " * 9, "w", 1, "k")]
    found = got(variants.variants(spark.createDataFrame(rows, SCHEMA), least_length=1, least_count=1, ratio=2))
    assert found == brute(rows, False, 1, 1, 2)
    assert any(r[5] not in (r[0], r[3]) for r in found)  # roots beyond the first form
    with pytest.raises(ValueError, match="ratio"):
        variants.variants(spark.createDataFrame(rows, SCHEMA), ratio=1)


def test_many_words_with_one_beginning_and_a_very_long_word(spark):
    rng = random.Random(7)
    words = ["commonbeginning" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(600)]
    long = "q" * 30_000
    rows = [(1, " ".join(words * 2 + [long, long, long[:-1], long[:-1]] + ["aaaaaaaa", "aaaaaaa"] * 2), "w", 1, "k")]
    assert got(variants.variants(spark.createDataFrame(rows, SCHEMA), most=16)) == brute(rows, False)


def test_empty_table(spark):
    assert variants.variants(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 6), st.sets(st.text("abc", max_size=6), max_size=40), st.sampled_from(["", "a", "b"]))
def test_pairs_of_an_acceptor(longer, words, after):
    words = sorted(w for w in words if longer - 1 <= len(w) <= longer)
    want = []
    for x in words:
        for y in words:
            if len(x) == longer and (len(y) == longer and y < x or len(y) < longer) and one_edit(x, y):
                a, b = x + after + "$", y + after + "$"
                if next(i for i in range(len(b)) if a[i] != b[i]) < longer:
                    want.append((x, y))
    assert sorted(variants.one_edit_pairs(words, longer, after)) == sorted(want)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("ab", max_size=5), max_size=20))
def test_acceptor_accepts_the_words_and_is_minimal(words):
    states = variants.minimal_acceptor(sorted(words))

    def accepted(at, before):
        final, arcs = states[at]
        yield from [before] if final else []
        for c, to in arcs.items():
            yield from accepted(to, before + c)

    assert sorted(accepted(len(states) - 1, "")) == sorted(words)
    right = [tuple(sorted(accepted(i, ""))) for i in range(len(states))]
    assert len(set(right)) >= len(states) - 1  # only the first state may equal another
