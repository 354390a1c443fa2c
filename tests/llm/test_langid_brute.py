"""op4 against a plain-Python version of the whole fusion, and its accuracy on held-out documents."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from docsync_spark.llm import langid
from tests.llm.test_langid import run, tables

WORD = re.compile(r"[^\W\d_]+")


def grams(text):
    for w in WORD.findall(text.lower()):
        w = f" {w} "
        yield from (zlib.crc32(w[i : i + 3].encode()) % 32768 for i in range(len(w) - 2))


def brute(labelled, rows):
    """rows: (id, text, host, domain, suffix, declared), visible text and address parts worked out by hand."""
    langs = sorted({x for i, t, x in labelled if None not in (i, t, x)})
    counts = {x: Counter(g for i, t, y in labelled if y == x and None not in (i, t) for g in grams(t)) for x in langs}
    total = {x: sum(counts[x].values()) + 0.02 * 32768 for x in langs}
    like, soft = [], []
    for _, text, *_ in rows:
        z = [0.3 * sum(math.log((counts[x][g] + 0.02) / total[x]) for g in grams(text)) for x in langs]
        z = [max(v - max(z), -40.0) for v in z]
        like.append(z)
        e = [math.exp(v) for v in z]
        soft.append([round(v / sum(e) * 1e6) for v in e])
    sums = {k: defaultdict(lambda: [0] * len(langs)) for k in ("host", "domain", "suffix", "declared")}
    everyone = [sum(p[i] for p in soft) for i in range(len(langs))]
    for (_, _, *keys), p in zip(rows, soft):
        for kind, key in zip(sums, keys):
            if key is not None:
                sums[kind][key] = [a + b for a, b in zip(sums[kind][key], p)]
    kappa = 5e6
    overall = [(x + kappa / len(langs)) / (sum(everyone) + kappa) for x in everyone]
    out = {}
    for (name, _, host, domain, suffix, declared), p, z in zip(rows, soft, like):
        below = overall
        for kind, key in (("domain", domain), ("host", host)):
            left = [max(a - b, 0) for a, b in zip(sums[kind][key], p)] if host is not None else [0] * len(langs)
            below = [(a + kappa * b) / (sum(left) + kappa) for a, b in zip(left, below)]
        score = [a + math.log(b) for a, b in zip(z, below)]
        for kind, key in (("suffix", suffix), ("declared", declared)):
            if key is not None:
                score = [s + math.log((a + 5e5) / (b + 1e6)) for s, a, b in zip(score, sums[kind][key], everyone)]
        best = max(score)
        out[name] = (langs[score.index(best)], 1 / sum(math.exp(s - best) for s in score))
    return out


def test_fusion_matches_brute_force(spark):
    labelled, pages = tables(spark)
    labelled.append((500, "zoo zug zank zar", "zc"))  # a language of one document is not left out
    flat = []
    for i, _, page, _, _ in pages:
        text = re.search(r"<p>(.*)</p>", page)[1]
        lang = re.search(r'lang="(..)"', page)[1]
        flat.append((i, text, f"site{i % 3}.{lang}z", f"site{i % 3}.{lang}z", f"{lang}z", lang))
    more = [(700, "zug zar zoo", None, None, "h"), (701, "", None, None, "h"), (702, None, None, None, None), (703, None, "<html lang=qq><b>kor", "http://a.b.example/x", None)]
    flat += [(700, "zug zar zoo", "h", "h", None, None), (701, "", "h", "h", None, None), (702, "", None, None, None, None), (703, "kor", "a.b.example", "b.example", "example", "other")]
    got = {r[0]: r[1:] for r in run(spark, labelled, pages + more)}
    want = brute(labelled, flat)
    assert set(got) == set(want) and got[700][0] == "zc"
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5, (k, got[k], want[k])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = docs.select("doc_id", "text", F.lit(None).cast("string").alias("html"), F.lit(None).cast("string").alias("url"), F.col("source").alias("host"), F.col("lang").alias("truth"))
    found = langid.identify(rows, docs.filter(~held_out), ("doc_id", "truth")).filter(held_out)
    right, n = found.agg(F.avg((F.col("lang") == F.col("truth")).cast("double")), F.count("*")).first()
    print("held-out accuracy", right, "of", n)
    assert n > 100 and right > 0.9


def test_malformed_pages_take_linear_time():
    for part in ("<script ", "<!-- ", "</script", "<head><nav>", "<", "&#", "&#" + "9" * 5000 + ";"):
        page = part * (256_000 // len(part))
        began = time.process_time()
        langid.page_text(page)
        assert time.process_time() - began < 1, part
    assert langid.page_text("&#00000065;&#99999999999; &#x41;") == "A� A"
    assert langid.page_text("a<!-- b --><style>c</STYLE >d<nav>e<script>f</nav>g</script>h").split() == ["a", "d", "g", "h"]
    assert langid.page_text("<nav>open <script>x</script>y").split() == ["open", "y"]


def test_unclosed_tags_of_markup_take_linear_time(spark):
    labelled = spark.createDataFrame([(i, "zug zar zoo", "h") for i in range(9)], "doc_id long, text string, lang string")
    pages = ["<html " * 100_000, "<html lang " * 50_000, "<html lang=" + " " * 200_000, "<html>" + "<html lang=qq>" * 9]
    rows = spark.createDataFrame([(i, None, p, None, None) for i, p in enumerate(pages)], "page_id long, text string, html string, url string, host string")
    began = time.time()
    assert sorted(r["page_id"] for r in langid.identify(rows, labelled, ("page_id",)).collect()) == [0, 1, 2, 3]
    assert time.time() - began < 60


def test_one_id_in_many_rows_does_not_fill_the_fit(spark, monkeypatch):
    from pyspark.sql import functions as F

    labelled = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("wort "), (F.col("id") % 5000).cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "aa").otherwise("bb").alias("lang"))
    path = f"{langid.materialize(spark.createDataFrame([(0,)], 'n int'))._jdf.inputFiles()[0]}".rpartition("/")[0].removeprefix("file:") + "-fit"
    fit = langid.fit

    def counting(texts, langs, languages):
        with open(path, "w") as f:
            f.write(f"{len(texts)} {len(set(texts))}")
        return fit(texts, langs, languages)

    monkeypatch.setattr(langid, "fit", counting)
    langid.train(labelled, fit_rows=200)
    n, different = map(int, open(path).read().split())
    assert n == different <= 200
