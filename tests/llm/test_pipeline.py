"""The pipeline against its stages in plain Python, and each stage's columns."""

import re
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docsync_spark.llm import bpe
from tests.llm.test_mixing import brute as mix
from tests.llm.test_pii import ANY, replace
from tests.llm.test_toxicity import corpus
from tests.llm.test_toxicity_brute import brute_fit, brute_score

LIBRARY = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def tables():
    docs, labels = corpus(300)
    rows = [(d, f"{t} number{d} card 4785380592391139." if d % 10 == 3 else f"{t} Word{d}.", ("en", "de")[d % 2], f"src{d % 4}") for d, t in docs]
    rows += [(1000 + d, t, lang, source) for d, t, lang, source in rows if d % 6 == 1]  # exact copies
    rows += [(2000 + d, t.upper(), lang, source) for d, t, lang, source in rows if d % 50 == 2]
    long = " ".join(f"w{i}" for i in range(150))
    rows += [(3000 + k, long.replace(f"w{10 * k} ", "other ").replace("w140 ", "w140 more " * (k % 3)), "en", "src1") for k in range(8)]  # near copies, some too far
    rows += [(5000, None, "en", "src0"), (5001, "", "en", None), (5002, "<|endoftext|> Été 10.0.0.1", None, "é")]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows], [(d, 1, y) for d, y in labels]


def one_of_each(docs):
    """Of each component of Jaccard 0.8 or more over five-word shingles the document with the smallest id."""
    sets = []
    for d, t, *_ in docs:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both) and both:
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(docs):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [r for i, r in enumerate(docs) if least[find(i)] == r[0]]


def brute(docs, labels):
    y = {d: t for d, _, t in labels if zlib.crc32(str(d).encode()) % 5}
    sample = sorted((r[0], r[1]) for r in docs if r[0] in y and r[1] is not None)
    model = brute_fit([t for _, t in sample], [y[d] for d, _ in sample])
    docs = [r for r in docs if brute_score(*model, r[1])[0] < 0.5]
    docs = one_of_each(docs)
    docs = [(d, None if t is None else re.sub(ANY, replace, t, flags=re.ASCII), lang, source) for d, t, lang, source, _ in docs]
    taken = mix([(d, t, source) for d, t, _, source in docs])[2]
    out = []
    for (d, t, lang, source), k in zip(docs, taken):
        n = len((t or "").encode().split())
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        out += [(d, lang, source, len(ids), tuple(ids))] * ((2 * k + n) // (2 * n) if n else 0)
    return sorted(out, key=repr)


def test_run_matches_plain_python(spark, tmp_path):
    docs, labels = tables()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r["doc_id"], r["lang"], r["source"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(docs, labels)


def test_columns_that_clash_with_a_stage(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, size string, h string, fp string, row1 string, segments string"
    row = lambda i, t: (i, t, "en", "s", len(t), "a", "b", "c", "d", "e", "f", "g")
    docs = spark.createDataFrame([row(i, f"some words of document {i}, ip 17.1.2.3 and no more") for i in range(4)], kind)
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.schema.simpleString() == spark.createDataFrame([], kind).schema.simpleString()
        assert docs.count() > 0 and {r[5:] for r in docs.collect()} == {("a", "b", "c", "d", "e", "f", "g")}


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], kind)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(f.name, f.dataType.simpleString()) for f in empty.schema]
        assert out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).collect() == []
