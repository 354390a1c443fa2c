import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docsync_spark.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
CODER = bpe.Coder(bpe.vocabulary())
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    "", " ", "Hello, World's best!", "I'll we've it's DON'T", "á Été ß İ ΣαΣ", "x\x1cy\x85z  w",
    "<|startoftext|>hi<|endoftext|> there<|ENDOFTEXT|>", "12345 6.7 ٣٤", "\U0001f600\U0001f600 日本語 한국", "aaaa" * 500, "!!!" * 100, "é<|endoftext|>́", "don’t 'sx 's", "ẛ̣ Å ﬁ", "\x00\x01\x7f",
]


def expect(text):
    LIBRARY.no_truncation()
    LIBRARY.no_padding()
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    ids, decoded = expect(text)
    assert CODER.ids(text) == ids
    assert CODER.encode(text)[1] == decoded == CODER.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("'sdtmlrev \n<|>AEIOÚ̧Σ")), max_size=60))
def test_as_the_library_on_any_text(text):
    ids, decoded = expect(text)
    assert CODER.ids(text) == ids
    assert CODER.encode(text)[1] == decoded


def test_fragments_are_cut_where_no_token_joins():
    fragments = CODER.fragments("zzqxj")
    assert "".join(s for f in fragments for s in f) == "zzqxj</w>"
    assert len(fragments) > 1
    assert all(pair in CODER.joined for f in fragments for pair in zip(f, f[1:]))


def test_tables(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (7, None), (7, "the cat"), (7, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "n_tokens": F.lit(3)})
    got = sorted(map(tuple, bpe.digests(docs).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x[0]), sha(" ".join(map(str, x[0]))), sha(x[1])) for i, t in rows for x in [expect(t or "")]]
    assert got == sorted(want, key=repr)
    coded = bpe.encode(docs)
    assert {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded.collect()} == {(i, tuple(x[0]), x[1]) for i, t in rows for x in [expect(t or "")]}
    again = bpe.decode(coded.select("doc_id", "ids"))
    assert {(r["doc_id"], r["decoded"]) for r in again.collect()} == {(i, expect(t or "")[1]) for i, t in rows}
    assert bpe.digests(docs.limit(0)).collect() == []
