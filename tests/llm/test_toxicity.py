import random
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from docsync_spark.llm import toxicity

BAD = ["idiot", "moron", "scum", "trash"]


def corpus(n=500):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}" for a in ("ba", "ko", "li", "ne", "su") for b in ("ran", "tel", "mi", "pon", "des", "vu")]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(1, 8))]
        toxic = i % 4 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(BAD)
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_place(spark):
    docs, labels = corpus()
    extra = [(None, "null id"), (9000, None), (9001, ""), (9002, "..!\n"), (9003, "you MORON " * 3000), (9003, "you MORON " * 3000)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumns({"score": F.lit("x"), "y": F.lit(1), "offending": F.lit(2)})
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (12345, 1), labels[0]], "doc_id long, toxic int")
    got = toxicity.toxicity(df, marks).collect()
    assert len(got) == len(docs) + len(extra)
    truth = dict(labels)
    texts = dict(docs)
    held = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["predicted"] and r["doc_id"] in texts and r["offending"]:
            span = texts[r["doc_id"]][r["offending"][0]["start"] :][: r["offending"][0]["length"]]
            assert any(b in span for b in BAD)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[9000] == by[9001] == by[9002] == 0.0 and by[9003] > 0.5


def test_noisy_or():
    weights = np.zeros(toxicity.FEATURES)
    weights[toxicity.features("bad")[0]] = 4.0
    scorer = toxicity.Scorer(-2.0, weights)
    p = lambda z: 1 / (1 + np.exp(-z))
    score, found = scorer.score("Fine. Bad one! bad bad\nfine")
    assert np.isclose(score, 1 - (1 - p(-2)) ** 2 * (1 - p(2)) * (1 - p(6)))
    assert [(a, n) for a, n, _ in found] == [(5, 8), (14, 8)]


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(docs, none).collect()] == [0]
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(100)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    one, two = (toxicity.train(df, spark.createDataFrame(x, "doc_id long, toxic int")).first() for x in (labels, flipped))
    assert one == two


def test_one_id_in_many_rows_is_learnt_from_once(spark):
    docs, labels = corpus(60)
    usual = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5][0]
    many = spark.createDataFrame(docs, "doc_id long, text string").union(spark.range(20_000).select(F.lit(usual).cast("long"), F.concat(F.lit("zzz "), F.col("id").cast("string"))))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    once = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (toxicity.train(x, marks, fit_rows=20).first() for x in (many, once))
    assert (a["bias"], a["at"], a["weights"]) == (b["bias"], b["at"], b["weights"])  # the smallest text is the first one


def test_fit_holds_few_bytes_a_word(monkeypatch):
    """Not Python's numbers: of millions of words these would stay in a worker that later stages use again."""
    monkeypatch.setattr(toxicity, "FEATURES", 1 << 10)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    texts = [" ".join(f"word{(i * j) % 997}" for j in range(400)) for i in range(1, 601)]
    tracemalloc.start()
    toxicity.fit(texts, np.arange(600) % 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 * 600 * 400
