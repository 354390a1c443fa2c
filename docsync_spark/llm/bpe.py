"""BPE encoding and decoding with forced boundaries.

Two neighbouring byte symbols that never stand side by side inside any token of the vocabulary can
not be merged by whatever rule, so each such pair marks a certain cut. Words are split at
those cuts, the fragments are merged independently, and their ids are concatenated. A task remembers
the ids of words and whitespace-separated chunks as bytes, in two generations of bounded size: when the young
one is full it becomes the old one, and what is asked for again moves back. The vocabulary file is
read on the driver and travels with the function (about 2 MB, whatever the data).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from docsync_spark.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Entries of one generation of a task's table of known chunks, about 180 bytes each.
KNOWN = 1 << 18
LONG_CHUNK = 256
SHORT_FRAGMENT = 24
NO_RANK = 1 << 40
#: Rows whose ids are held at once.
ROWS = 256
#: The bytes that byte-level vocabularies write as themselves; the others follow from code point 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    letters = {b: chr(b) for b in PRINTABLE}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(PRINTABLE))
    return [letters[b] for b in range(256)]


class Known(dict):
    """What ``make`` returns for a string, remembered in two generations; strings over LONG_CHUNK are made anew each time."""

    def __init__(self, make):
        self.make = make
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        x = self.old.get(key)
        if x is None:
            x = self.make(key)
        if len(key) <= LONG_CHUNK:
            if len(self) >= KNOWN:
                self.old = dict(self)
                self.clear()
            self[key] = x
        return x


class Coder:
    """Encodes and decodes as the tokenizer file says (BPE over byte letters with a word-end suffix)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.ranks: dict[tuple[str, str], int] = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.word = regex.compile(splits[0].replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.joined = self._neighbours()
        self.decimals = {i: str(i) for i in self.tokens}
        self.known, self.words = Known(self.chunk), Known(self.word_ids)

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        return [*body[:-1], body[-1:] + (self.end if body != token else "")]

    def _neighbours(self) -> set[tuple[str, str]]:
        """The pairs of symbols that stand side by side inside some token."""
        return {pair for token in self.vocab for s in [self._symbols(token)] for pair in zip(s, s[1:])}

    def fragments(self, word: str) -> list[list[str]]:
        """The symbols of a word, split at every certain cut."""
        letters = [*map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass"))]
        letters[-1] += self.end
        cuts = [i for i, pair in enumerate(zip(letters, letters[1:]), 1) if pair not in self.joined]
        return [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])] if cuts else [letters]

    def merge(self, symbols: list[str]) -> list[str]:
        """Applies the merges to one fragment, lowest rank first, leftmost among equals."""
        n = len(symbols)
        if n < 2:
            return symbols
        if n <= SHORT_FRAGMENT:
            return self._merge_short(symbols)
        symbols = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (r := self.ranks.get((symbols[left], symbols[right]))) is not None:
                    heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
        return [s for s in symbols if s]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same with a plain search for the lowest rank; after a merge only the pairs beside it are looked up."""
        rank = self.ranks.get
        symbols = list(symbols)
        found = [rank(pair, NO_RANK) for pair in zip(symbols, symbols[1:])]
        while found and (best := min(found)) != NO_RANK:
            i = found.index(best)
            made = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], made), NO_RANK)
            if i < len(found):
                found[i] = rank((made, symbols[i + 1]), NO_RANK)
        return symbols

    def word_ids(self, word: str) -> bytes:
        """The ids of one word of the text, as int32 bytes."""
        vocab = self.vocab
        return np.array([vocab[t] for f in self.fragments(word) for t in self.merge(f) if t in vocab], np.int32).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a text without white space."""
        text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if text.isascii() and text.isalpha():  # one word, and its own chunk
            return self.word_ids(text) if text == chunk else self.known[text]
        return b"".join([self.known[w] if w.isascii() and w.isalpha() else self.words[w] for w in self.word.findall(text)])

    def plain(self, text: str) -> bytes:
        chunks = text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else filter(None, self.space.split(text))
        return b"".join(map(self.known.__getitem__, chunks))

    def coded(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        parts, at = [], 0
        text = text or ""
        for m in self.specials.finditer(text) if "<|" in text else ():
            parts.append(self.plain(text[at : m.start()]))
            parts.append(np.int32(self.special[m[0]]).tobytes())
            at = m.end()
        parts.append(self.plain(text[at:]))
        return np.frombuffer(b"".join(parts), np.int32)

    def ids(self, text: str | None) -> list[int]:
        return self.coded(text).tolist()

    def encode(self, text: str | None) -> tuple[str, str, int]:
        """Of a text: its ids in decimal joined by one space, the text decoded from them, how many."""
        ids = self.ids(text)
        return " ".join(map(self.decimals.__getitem__, ids)), self.decode(ids), len(ids)

    def decode(self, ids) -> str:
        """The tokens joined by one space, special ones too; numbers outside the vocabulary are passed over."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _text(x) -> str:
    return x if isinstance(x, str) else ""


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, out: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with ``out`` array<int>, the token ids of the whole text, and ``decoded``, the text that they stand for.

    Null and empty texts have no ids. Strings of special tokens in a text become those tokens.
    Existing columns of these names are replaced. Rows are otherwise as they were.
    """
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [c for c in docs.columns if c not in (out, decoded)]
    schema = docs.select(*kept).schema.add(out, ArrayType(IntegerType()))
    if decoded:
        schema = schema.add(decoded, "string")

    def run(batches):
        c = Coder(spec.value)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                frame, ids, texts = part[kept].copy(), [], []
                for t in part[text_col]:
                    ids.append(c.coded(_text(t)))
                    texts.append(c.decode(ids[-1].tolist()) if decoded else None)
                frame[out] = ids
                if decoded:
                    frame[decoded] = texts
                yield frame

    return docs.mapInPandas(run, schema)


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None, out: str = "decoded") -> DataFrame:
    """rows with ``out``, the text of their ids; null ids give null."""
    spec = rows.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [c for c in rows.columns if c != out]
    schema = rows.select(*kept).schema.add(out, "string")

    def run(batches):
        c = Coder(spec.value)
        for batch in batches:
            yield batch[kept].assign(**{out: [None if x is None else c.decode(map(int, x)) for x in batch[ids_col]]})

    return rows.mapInPandas(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded, without sending the ids on."""
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = docs.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        c = Coder(spec.value)
        for batch in batches:
            n, ids, texts = [], [], []
            for t in batch[text_col]:
                i, d, k = c.encode(_text(t))
                n.append(k)
                ids.append(hashlib.sha256(i.encode()).hexdigest())
                texts.append(hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest())
            yield batch[[id_col]].assign(n_tokens=np.array(n, np.int64), ids_sha256=ids, decoded_sha256=texts)

    return docs.select(id_col, text_col).mapInPandas(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded with the word-end vocabulary."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
