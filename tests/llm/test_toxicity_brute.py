"""The fit and the scores of op10 against plain Python with dicts and loops, and accuracy on held-out documents."""

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from docsync_spark.llm import toxicity


def word_features(word):
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) % (1 << 18) for x in ["=" + word] + ["^" + word[:k] for k in (3, 4, 5, 6) if len(word) >= k]}


def bag(text):
    """The words of each sentence that has any."""
    found = [re.findall(r"\w+", s) for s in re.split(r"[.!?\n]+", (text or "").lower())]
    return [s for s in found if s]


def softplus(z):
    return max(z, 0) + math.log1p(math.exp(-abs(z)))


def brute_fit(texts, labels, epochs=150, rate=0.2, l1=5e-6):
    """(bias, {feature: weight}) after the same number of steps uphill."""
    bags = [bag(t) for t in texts]
    used = {f for b in bags for s in b for w in s for f in word_features(w)}
    weights, m, v = dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0), dict.fromkeys(used, 0.0)
    bias, mb, vb = -5.0, 0.0, 0.0
    if not any(labels) or not used:
        return bias, weights
    for epoch in range(1, epochs + 1):
        g, gb = dict.fromkeys(used, 0.0), 0.0
        for b, y in zip(bags, labels):
            z = [bias + sum(weights[f] for w in s for f in word_features(w)) for s in b]
            clean = sum(map(softplus, z))
            odds = math.exp(-clean) / max(-math.expm1(-clean), 1e-12)
            for s, x in zip(b, z):
                slope = 1 / (1 + math.exp(-min(max(x, -30), 30))) * (-odds if y else 1.0) / len(texts)
                gb += slope
                for w in s:
                    for f in word_features(w):
                        g[f] += slope
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = rate / (1 - 0.9**epoch)
        for f in used:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] * g[f]
            spread = math.sqrt(v[f] / (1 - 0.99**epoch)) + 1e-9
            step = weights[f] - scale * m[f] / spread
            weights[f] = math.copysign(max(abs(step) - rate * l1 / spread, 0), step)
        bias = min(bias - scale * mb / (math.sqrt(vb / (1 - 0.99**epoch)) + 1e-9), -3.0)
    return bias, weights


def brute_score(bias, weights, text):
    """Probability of the document, and (start, length) of its sentences of one half and more."""
    clean, worst, at = 0.0, [], 0
    for piece in re.split(r"([.!?\n]+)", text or ""):
        words = re.findall(r"\w+", piece.lower())
        if words:
            z = bias + sum(round(weights.get(f, 0.0) * (1 << 20)) for w in words for f in word_features(w)) / (1 << 20)
            clean += softplus(z)
            if z >= 0:
                worst.append((at, len(piece)))
        at += len(piece)
    return -math.expm1(-clean), worst


TEXTS = ["you are fine. all good today!", "what a vile idiot! go away", "nothing here\nreally nothing", "idiots everywhere. vile people", "a calm day. a calm night", "", "... !!", "vile", "fine fine fine", "good day\nidiot"]
LABELS = [0, 1, 0, 1, 0, 0, 0, 1, 0, 1]


def test_fit_is_the_plain_one():
    bias, weights = toxicity.fit(TEXTS, np.array(LABELS))
    plain_bias, plain = brute_fit(TEXTS, LABELS)
    assert abs(bias - plain_bias) < 1e-6
    assert all(abs(weights[f] - w) < 1e-5 for f, w in plain.items())
    assert set(np.flatnonzero(weights)) <= set(plain)
    assert toxicity.fit(TEXTS, np.zeros(len(TEXTS)))[0] == -5.0 and not toxicity.fit([], np.array([]))[1].any()


def test_scores_are_the_plain_ones(spark):
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate([*TEXTS, "Vile! Idiot\n\nfine? VILE...", None])], "doc_id long, text string")
    labels = spark.createDataFrame([(i + 1, y) for i, y in enumerate(LABELS)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    known = [(i + 1, t) for i, t in enumerate(TEXTS) if zlib.crc32(str(i + 1).encode()) % 5]
    bias, weights = brute_fit([t for _, t in known], [LABELS[i - 1] for i, _ in known])
    for i, t in docs.collect():
        score, worst = brute_score(bias, weights, t)
        assert abs(got[i]["score"] - score) < 1e-4 and got[i]["predicted"] == (score >= 0.5)
        assert [(x["start"], x["length"]) for x in got[i]["offending"]] == worst


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    found = toxicity.toxicity(docs.select("doc_id", "text"), labels).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    r = found.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("caught"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("false")).first()
    print("held out", r)
    assert r["n"] > 500 and r["caught"] >= 0.8 * r["toxic"] and r["false"] <= 0.02 * (r["n"] - r["toxic"])


def test_thinned_labels_keep_their_rate():
    """Half of the clean rows, each counting twice, fit as well as all of them: the cut stays where it is."""
    clean = [f"calm words number{i} of a quiet day" for i in range(40)]
    toxic = ["a vile day", "vile words of number3", "quiet but vile"]
    whole = toxicity.fit(clean + toxic, np.array([0] * 40 + [1] * 3))
    half = toxicity.fit(clean[::2] + toxic, np.array([0] * 20 + [1] * 3), np.array([2.0] * 20 + [1.0] * 3))
    text = "a vile word"
    one, two = (toxicity.Scorer(*m).score(text)[0] for m in (whole, half))
    assert abs(one - two) < 0.05 and abs(whole[0] - half[0]) < 0.2
