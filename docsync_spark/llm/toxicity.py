"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of its words'
weights; a document's is their noisy-or, 1 - prod(1 - p). Only documents have labels: the
likelihood of these labels is maximised over the weights, which also tells where
the offending sentences are. A word's weight is the sum of the hashed weights of its whole form
and of its first letters, so inflected forms share evidence.

The fit takes a bounded sample of labelled rows (``fit_rows`` of each label, those of smallest hash,
of at most ``fit_chars`` characters) in one task. Rows of a label that the bound thins out count for as many
as they stand for, so that the fit sees the labels' own rates at every size; scoring covers every whole text.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from docsync_spark.llm.common import table, text_steps, thinned, unused

FEATURES = 1 << 18
KNOWN_WORDS = 1 << 18
SENTENCE = re.compile(r"[^.!?\n]+")
#: Words, and what ends a sentence.
TOKEN = re.compile(r"\w+|[.!?\n]+")
ENDS = ".!?\n"
EPOCHS, RATE, L1, BIAS = 150, 0.2, 5e-6, -5.0
#: Weights are summed in units of 1 / UNIT, so that their order does not matter.
UNIT = 1 << 20
END = 1 << 60


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its beginnings of 3 to 6 letters."""
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in (f"={word}", *(f"^{word[:k]}" for k in range(3, 7) if len(word) >= k))})


def fit(texts: list[str], labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(bias, weights) that maximise the likelihood of document labels under noisy-or; counts: for how many documents each stands."""
    number: dict[str, int] = {}
    # 8 bytes each: as Python's numbers those of millions of words would take what a task should not hold, nor its worker keep afterwards
    words, sentence, owner = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        fresh = True
        for t in TOKEN.findall(text.lower()):
            if t[0] in ENDS:
                fresh = True
                continue
            if fresh:
                owner.append(d)
                fresh = False
            words.append(number.setdefault(t, len(number)))
            sentence.append(len(owner) - 1)
    weights, bias = np.zeros(FEATURES), BIAS
    if not owner or not labels.any():
        return bias, weights
    at, feature = array("q"), array("q")
    for w, i in number.items():
        found = features(w)
        at.extend([i] * len(found))
        feature.extend(found)
    words, sentence, owner, at, feature = (np.frombuffer(x, np.int64) for x in (words, sentence, owner, at, feature))
    y = labels.astype(float)
    share = (np.ones(len(texts)) if counts is None else counts / counts.mean()) / len(texts)
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    used = np.unique(feature)
    for epoch in range(1, EPOCHS + 1):
        by_word = np.bincount(at, weights[feature], len(number))
        z = bias + np.bincount(sentence, by_word[words], len(owner))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(owner, np.logaddexp(0, z), len(texts))  # -log of the probability of no toxic sentence
        odds = np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-12)
        slope = p * np.where(y[owner] > 0, -odds[owner], 1.0) * share[owner]
        by_word = np.bincount(words, slope[sentence], len(number))
        g = np.bincount(feature, by_word[at], FEATURES)
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        scale = RATE / (1 - 0.9**epoch)
        spread = np.sqrt(v[used] / (1 - 0.99**epoch)) + 1e-9
        step = weights[used] - scale * m[used] / spread
        weights[used] = np.sign(step) * np.maximum(np.abs(step) - RATE * L1 / spread, 0)
        bias = min(bias - scale * mb / (np.sqrt(vb / (1 - 0.99**epoch)) + 1e-9), -3.0)
    return float(bias), weights


class Scorer:
    def __init__(self, bias: float, weights: np.ndarray):
        self.bias = bias
        units = {int(i): round(float(weights[i]) * UNIT) for i in np.flatnonzero(weights)}

        class Known(dict):
            def __missing__(self, token: str) -> int:
                if len(self) > KNOWN_WORDS:
                    self.clear()
                x = self[token] = END if token[0] in ENDS else sum([units.get(f, 0) for f in features(token)])
                return x

        self.known = Known()

    def evidence(self, text: str) -> np.ndarray:
        """z of each sentence that has a word."""
        tokens = TOKEN.findall(text.lower())
        if not tokens:
            return np.zeros(0)
        values = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        word = values != END
        starts = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]))
        values[~word] = 0
        return self.bias + np.add.reduceat(values, starts) / UNIT if len(starts) else np.zeros(0)

    def sentences(self, text: str):
        """(start, length, z) of each sentence that has a word; positions in code points."""
        for m in SENTENCE.finditer(text):
            for z in self.evidence(m[0])[:1]:
                yield m.start(), m.end() - m.start(), float(z)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and its sentences of at least one half."""
        z = self.evidence(text)
        held = float(np.logaddexp(0.0, z).sum())
        worst = [(a, n, float(1 / (1 + np.exp(-x)))) for a, n, x in self.sentences(text) if x >= 0] if (z >= 0).any() else []
        return float(-np.expm1(-held)), worst


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = 6000, fit_chars: int = 20_000) -> DataFrame:
    """One row (bias, at array<int>, weights array<double>): the model, of the weights that are not zero.

    Learns from rows of labels with toxic 0 or 1 whose crc32(doc_id) mod 5 is not 0. Of several
    labels of one document, toxic counts; of several texts of one id, the smallest one is learnt from. With no such rows the model calls nothing toxic.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= fit_chars))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [thinned(known.filter(F.col("y") == y), ["doc_id"], fit_rows, counts.get(y, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows) for y in (0, 1)]
    # each sampled row stands for as many labelled ones as its label's bound left out
    stands = F.when(F.col("y") == 1, counts.get(1, 0) / max(1, min(fit_rows, counts.get(1, 0)))).otherwise(counts.get(0, 0) / max(1, min(fit_rows, counts.get(0, 0))))
    # of an id's texts the smallest, so that rows are bounded and not ids alone
    sample = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y", stands.cast("double").alias("stands"))

    def learn(batches):
        frames = [b for b in batches if len(b)]
        rows = pd.concat(frames).sort_values(["doc_id", "text"], kind="stable") if frames else pd.DataFrame({"text": [], "y": [], "stands": []})
        bias, weights = fit(rows["text"].tolist(), rows["y"].to_numpy(), rows["stands"].to_numpy())
        at = np.flatnonzero(weights)
        yield pd.DataFrame({"bias": [bias], "at": [at.astype(np.int32)], "weights": [weights[at]]})

    return sample.repartition(1).mapInPandas(learn, "bias double, at array<int>, weights array<double>")


NEW = ("score", "predicted", "offending")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", new: tuple[str, str, str] = NEW, **limits) -> DataFrame:
    """docs with score double, predicted int and offending array of (start, length, score), named as new says.

    Every whole text is scored; null and empty texts score 0. offending holds the sentences of
    probability 0.5 or more, positions in code points. Columns of docs with the new names are
    replaced. Repeated rows come back as often as they came; an empty table gives an empty result. The model has a fixed size, 2^18 weights at most, and goes to all tasks.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(named, labels, **limits).first()
    weights = np.zeros(FEATURES, np.float64)
    if model is not None:
        weights[np.array(model["at"], np.int64)] = model["weights"]
    bias = model["bias"] if model is not None else BIAS
    sent = docs.sparkSession.sparkContext.broadcast((bias, weights))
    kept = [c for c in docs.columns if c not in new]
    read = text_col if text_col in kept else unused(docs, "text_")
    places = ArrayType(StructType().add("start", "integer").add("length", "integer").add("score", "double"))
    schema = docs.select(*kept).schema.add(new[0], "double").add(new[1], "integer").add(new[2], places)

    def run(batches):
        scorer = Scorer(*sent.value)
        found = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part, texts in text_steps(batch, read):
                done = [scorer.score(t.decode("utf-8", "surrogatepass")) if t else (0.0, []) for t in texts]
                score = np.array([s for s, _ in done], np.float64)
                offending = [[{"start": a, "length": n, "score": p} for a, n, p in w] for _, w in done]
                own = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(offending, found)], names=schema.names)

    rows = docs.select(*kept) if text_col in kept else docs.select(*kept, F.col(text_col).alias(read))
    return rows.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, from the labels of documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
