"""Substring dedup by relative Lempel-Ziv parsing against an index of all reference blocks.

A window is ``length`` consecutive words. Every window has an anchor, the leftmost smallest hash of
its runs of ``anchor`` words, so equal windows have equal anchors. The windows of a document that share one
occurrence of an anchor make a phrase, and all phrases of all documents with one anchor make a reference
block, to which no other phrase can have an equal window. Every document is factored against every block that
its anchors name, and only blocks of two phrases or more are looked at again:

* a phrase that stands elsewhere as it is, word for word, is a factor whole;
* the other phrases of a block are laid over each other at the anchor and sorted by what stands on its right. From each
  word of a phrase the greedy parse takes the longest factor that any other phrase of the block has: of the phrases with the same
  words between there and the anchor, one of its neighbours in that order goes along the furthest. Factors of ``length`` words and more
  become duplicate spans;
* neighbouring phrases overlap by ``length - 1`` words, so a window across the boundary of two factors
  belongs to one of the phrases and is checked there.

Blocks of more than ``MOST`` different phrases, more than one task should hold, are not parsed: their windows are counted one by one,
which has the same result. Identical phrases are counted before they are dealt, so a passage with a million
copies is one row from each task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.llm.common import materialize, steps, table, utf8

U = np.uint64
#: Two odd bases of the word-sequence hashes, modulo 2^64, and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
KNOWN_WORDS = 1 << 18
#: Different phrases of a block that is parsed in one task.
MOST = 1 << 16
#: Documents that lose words up to which their keys go to all tasks, so that no other text is shuffled.
FEW = 1 << 20


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        x = self[word] = xxhash.xxh3_64_intdigest(word)
        return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, U(base))
    p[0] = 1
    return np.multiply.accumulate(p)


class Text:
    """The words of some texts in a row, with hashes of any runs of them in constant time."""

    def __init__(self, texts: list[bytes], known: dict):
        self.words = [x.split() for x in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.starts[-1])
        hashes = np.fromiter((known[w] for doc in self.words for w in doc), U, n)
        self.sums, self.back = [], []
        for seed, base, inverse in zip((0, 1), BASES, INVERSES, strict=True):
            own = hashes if not seed else _mixed(hashes + U(0x5851F42D4C957F2D))
            sums = np.zeros(n + 1, U)
            np.cumsum(own * _powers(max(n, 1), base)[:n], out=sums[1:])
            self.sums.append(sums)
            self.back.append(_powers(n + 1, inverse))

    def runs(self, at: np.ndarray, size, which: int = 0) -> np.ndarray:
        """Hashes of the words [at, at + size)."""
        return _mixed((self.sums[which][at + size] - self.sums[which][at]) * self.back[which][at] + np.asarray(size).astype(U))

    def phrases(self, doc: int, length: int, anchor: int) -> tuple[np.ndarray, ...]:
        """Of one text: where each phrase starts (an index of all words), how many windows it has, how far its anchor is in, the anchor's hash."""
        n = int(self.sizes[doc]) - length + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
        first = int(self.starts[doc])
        h = self.runs(np.arange(first, first + n + length - anchor), anchor)
        width = length - anchor + 1
        # rank of equal hashes does not matter: the first of the smallest is the anchor
        at = np.empty(n, np.int64)
        for a in range(0, n, 1 << 15):
            b = min(n, a + (1 << 15))
            at[a:b] = np.lib.stride_tricks.sliding_window_view(h[a : b + width - 1], width).argmin(axis=1) + np.arange(a, b)
        new = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        return first + new, np.diff(np.concatenate([new, [n]])), at[new] - new, h[at[new]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parsed(batches, length: int, anchor: int):
    """The phrases of each document: (k1, k2, start, n, lead, anchor, phrase); start counts from the document's first word."""
    known = _WordHashes()
    for batch in batches:
        texts = utf8(batch["text"])
        k1, k2 = batch["k1"].to_numpy(np.int64), batch["k2"].to_numpy(np.int64)
        for a, b in steps(texts):
            text = Text(texts[a:b], known)
            for i in range(b - a):
                start, n, lead, h = text.phrases(i, length, anchor)
                if len(start):
                    yield pd.DataFrame({
                        "k1": k1[a + i], "k2": k2[a + i], "start": (start - text.starts[i]).astype(np.int32), "n": n.astype(np.int32), "lead": lead.astype(np.int32),
                        "anchor": _signed(h), "phrase": _signed(text.runs(start, n + length - 1, 1)),
                    })


def _joined(frames, rows: int = 20_000):
    """Small frames put together, since each frame sent has a cost of its own."""
    held, n = [], 0
    for x in frames:
        held.append(x)
        n += len(x)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _opened(batches, length: int, anchor: int):
    """Phrases of blocks with the hashes of their words beside the anchor; of a large block one row for each window, with its hashes."""
    known = _WordHashes()
    whole = {"words": None, "w1": 0, "w2": 0}
    for batch in batches:
        texts = utf8(batch["text"])
        for a, b in steps(texts):
            text = Text(texts[a:b], known)
            for i, (k1, k2, spans) in enumerate(batch[["k1", "k2", "spans"]].iloc[a:b].itertuples(index=False, name=None)):
                parts, rows = text.words[i], []
                for s in spans:
                    begin, lead = s["start"], s["lead"]
                    if s["large"]:
                        at = begin + np.arange(s["n"])
                        where = at + text.starts[i]
                        yield pd.DataFrame({"k1": k1, "k2": k2, "start": at.astype(np.int32), "n": 1, "lead": 0, "anchor": s["anchor"], "words": None, "w1": _signed(text.runs(where, length, 0)), "w2": _signed(text.runs(where, length, 1))})
                    else:
                        beside = parts[begin : begin + lead] + parts[begin + lead + anchor : begin + s["n"] + length - 1]
                        rows.append({"k1": k1, "k2": k2, "start": begin, "n": s["n"], "lead": lead, "anchor": s["anchor"], **whole, "words": np.fromiter((known[w] for w in beside), U, len(beside)).tobytes()})
                if rows:
                    yield pd.DataFrame(rows)


def longest(block: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The greedy parse of blocks of phrases, laid over each other at the anchor.

    block: whose phrase it is; left and right: word hashes leftward and rightward from the anchor, [phrases, words], zero where the phrase has no
    more. Returns reach[phrase, j]: how many words on the right of the anchor the longest factor has that starts j words
    before the anchor and stands in another phrase of the block; -1 for none.
    """
    n, width = left.shape
    rank = np.empty(n, np.int64)
    rank[np.lexsort(right.T[::-1])] = np.arange(n)
    reach = np.full((n, width + 1), -1, np.int16)
    same_left = _mixed(block.astype(U) + U(1))  # of the block and the j words before the anchor
    at = np.arange(n)
    for j in range(width + 1):
        order = at[np.lexsort((rank[at], same_left[at]))]
        beside = same_left[order[1:]] == same_left[order[:-1]]
        a, b = order[1:][beside], order[:-1][beside]
        if not len(a):
            break
        along = np.logical_and.accumulate((right[a] == right[b]) & (right[a] != 0), axis=1).sum(axis=1, dtype=np.int16)
        reach[a, j] = along
        reach[b, j] = np.maximum(reach[b, j], along)
        if j < width:  # who has no partner for j words has none for more
            at = np.union1d(a, b)
            at = at[left[at, j] != 0]
            same_left[at] = _mixed(same_left[at] * U(BASES[0]) + left[at, j])
    return reach


def _factors(batches, length: int, anchor: int):
    """(k1, k2, start, n) of the windows inside factors of length words and more; rows come sorted by anchor."""
    width = length - anchor

    def parsed(rows: pd.DataFrame):
        block = np.cumsum(np.concatenate([[0], np.diff(rows["anchor"].to_numpy(np.int64)) != 0]))
        lead, n, start = (rows[c].to_numpy(np.int64) for c in ("lead", "n", "start"))
        sides = np.zeros((2, len(rows), width), U)
        for i, x in enumerate(rows["words"]):
            x = np.frombuffer(x, U)
            x = np.where(x == 0, U(1), x)
            sides[0, i, : lead[i]] = x[: lead[i]][::-1]
            after = x[lead[i] :]
            sides[1, i, : len(after)] = after
        reach = longest(block, *sides)
        k1, k2 = rows["k1"].to_numpy(np.int64), rows["k2"].to_numpy(np.int64)
        offsets = lead[:, None] - np.arange(n.max(initial=0))  # words before the anchor at which each window starts
        inside = (np.arange(offsets.shape[1]) < n[:, None]) & (offsets >= 0)
        inside &= np.take_along_axis(reach, np.maximum(offsets, 0), 1) >= width - offsets
        edge = np.diff(np.pad(inside.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        yield pd.DataFrame({"k1": k1[row], "k2": k2[row], "start": (start[row] + begin).astype(np.int32), "n": (end - begin).astype(np.int32)})

    held = None
    for batch in batches:
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        open_ = batch["anchor"] == batch["anchor"].iloc[-1]
        held = batch[open_]
        if not open_.all():
            yield from parsed(batch[~open_].reset_index(drop=True))
    if held is not None:
        yield from parsed(held.reset_index(drop=True))


def _cut(batches, length: int, kept: list[str], text_col: str, with_text: bool):
    for batch in batches:
        texts = utf8(batch[text_col])
        total, gone, digests, left_texts, factors = [], [], [], [], []
        for text, spans in zip(texts, batch["spans"], strict=True):
            parts = text.split()
            removed, runs = 0, []
            if spans is not None and len(spans):
                edge = np.zeros(len(parts) + 1, np.int32)
                for s in spans:
                    edge[s["start"]] += 1
                    edge[s["start"] + s["n"] + length - 1] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                removed = int(covered.sum())
                left = b" ".join([p for p, c in zip(parts, covered.tolist(), strict=True) if not c])
                ends = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]))).reshape(-1, 2).tolist()
                runs = [{"start": a, "length": b - a} for a, b in ends]
            else:
                left = b" ".join(parts)
            total.append(len(parts))
            gone.append(removed)
            digests.append(hashlib.sha256(left).hexdigest())
            if with_text:
                left_texts.append(left.decode("utf-8", "surrogatepass"))
                factors.append(runs)
        yield batch[kept].assign(n_words=np.array(total, np.int64), n_removed=np.array(gone, np.int64), kept_sha256=digests, **{"kept_text": left_texts, "factors": factors} if with_text else {})


def _sent(keys: DataFrame) -> DataFrame:
    """keys, to all tasks if there are few of them."""
    return F.broadcast(keys) if keys.count() <= FEW else keys


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 35, anchor: int = 8, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text, factors]) of every row of docs.

    Removed is each word covered by a window of ``length`` words whose words also start anywhere
    else, in the same document too. Texts that are null or shorter than a window keep all.
    Repeated rows are documents of their own: each is a repeat of the other. Null ids are kept.
    An empty table gives an empty result; other columns of docs are not looked at. factors has the
    (start, length) in words of what was removed, neighbouring and overlapping factors as one.
    """
    row = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    row = row.withColumns({"k1": F.xxhash64("__id", "text"), "k2": F.xxhash64(F.lit(1), "text", "__id")})
    phrase = "k1 long, k2 long, start int, n int, lead int, anchor long, phrase long"
    phrases = materialize(row.mapInPandas(lambda b: _joined(_parsed(b, length, anchor)), phrase))

    shared = materialize(phrases.groupBy("anchor").count().filter("count > 1").select("anchor"))
    indexed = materialize(phrases.join(shared, "anchor"))  # the blocks of two phrases and more
    copies = materialize(indexed.groupBy("anchor", "phrase").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start", "n", "lead")).alias("one")))
    several = indexed.join(copies.filter("copies > 1").select("anchor", "phrase"), ["anchor", "phrase"])

    blocks = copies.groupBy("anchor").agg(F.count("*").alias("different")).filter("different > 1")
    asked = copies.select("anchor", "one.*").join(blocks, "anchor").groupBy("k1", "k2")
    asked = asked.agg(F.collect_set(F.struct("start", "n", "lead", "anchor", (F.col("different") > MOST).alias("large"))).alias("spans"))
    asked = materialize(asked)
    texts = row.join(_sent(asked.select("k1", "k2")), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    opened = "k1 long, k2 long, start int, n int, lead int, anchor long, words binary, w1 long, w2 long"
    opened = materialize(texts.join(asked, ["k1", "k2"]).mapInPandas(lambda b: _joined(_opened(b, length, anchor)), opened))

    small = opened.filter("words is not null").drop("w1", "w2").repartition("anchor").sortWithinPartitions("anchor")
    factors = small.mapInPandas(lambda b: _joined(_factors(b, length, anchor)), "k1 long, k2 long, start int, n int")
    windows = opened.filter("words is null").select("k1", "k2", "start", "n", "w1", "w2")
    repeated = windows.groupBy("w1", "w2").count().filter("count > 1").drop("count")
    counted = windows.join(repeated, ["w1", "w2"], "left_semi").select("k1", "k2", "start", "n")

    spans = several.select("k1", "k2", "start", "n").union(factors).union(counted).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    result = "__id " + docs.schema[id_col].dataType.simpleString() + ", n_words long, n_removed long, kept_sha256 string"
    result += ", kept_text string, factors array<struct<start:int,length:int>>" if with_text else ""
    spans = materialize(spans)
    keys = _sent(spans.select("k1", "k2"))
    # texts that lose nothing stay where they are
    whole = row.join(keys, ["k1", "k2"], "left_anti").select("__id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    less = row.join(keys, ["k1", "k2"], "left_semi").join(spans, ["k1", "k2"]).select("__id", "text", "spans")
    cut = whole.union(less).mapInPandas(lambda b: _cut(b, length, ["__id"], "text", with_text), result)
    return cut.withColumnRenamed("__id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 35-word windows."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL: dict[str, str] = {}
