from collections import Counter

from pyspark.sql import functions as F

from docsync_spark.llm import quality


def brute_base(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def low(v):
    shift = max(v.bit_length() - 6, 0)
    return v >> shift << shift


TEXTS = [None, "", " \t", "a b c", "one two three four five six seven eight " * 2, "x " * 200, "é ß 漢 " * 20, "a\n\na\n a\n\x0b\nb\nb", "#*$ %& |<> " * 5, "w" * 30000, "l1\nl2\n" * 50]


def rows():
    out = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    for i in range(100, 600):
        text = " ".join(f"w{i * 31 + j * j % 97}" for j in range(30 + i % 50)) + ("" if i % 40 else " ####" * 60)
        out.append((i, text, [None, "en", "de"][i % 3 and 1 + (i % 7 == 0)], [None, "a", "b", "hot", "hot"][i % 5]))
    return out + [out[20], out[20], (None, "null id " * 3, None, None)]


def test_base_measures(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumns({"n_words": F.lit("x"), "kept": F.lit(1), "failed": F.lit(2)})
    got = quality.quality(docs).collect()
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted([(d, *brute_base(t)) for d, t, _, _ in data], key=repr)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_thresholds_match_exact_quantiles_of_buckets(spark):
    data = rows()
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    scaled, groups = [], {}
    for d, t, lang, source in data:
        n, chars, symbols, lines, rep = brute_base(t)
        base = n < 20 or 100 * rep > 30 * n
        m = {"symbols": symbols * 1000 // max(chars, 1), "dup_lines": lines * 1000 // ((t or "").count("\n") + 1), "repeats": rep * 1000 // max(n, 1), "word_length": chars * 1000 // max(n, 1)}
        m = {k: low(v) for k, v in m.items()}
        scaled.append((d, base, m, lang, source))
        if not base:
            for g in ((lang, source), (lang,), ()):
                groups.setdefault(g, []).append(m)
    for d, base, m, lang, source in scaled:
        kept = not base
        for k, v in m.items():
            own = next(g for g in ((lang, source), (lang,), ()) if not g or len(groups.get(g, [])) >= quality.LEAST_GROUP)
            x = sorted(e[k] for e in groups[own])
            q1, q3 = x[-(-len(x) // 4) - 1], x[-(-3 * len(x) // 4) - 1]
            reach = max(3 * (q3 - q1), quality.MEASURES[k])
            kept = kept and not (v > q3 + reach or k in quality.BOTH_SIDES and v < q1 - reach)
        assert got[d] == kept, d


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    out = quality.quality(docs)
    assert out.collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    only = quality.quality(spark.createDataFrame([(1, "too short", None, None)], "doc_id long, text string, lang string, source string")).collect()
    assert [r["kept"] for r in only] == [False]
