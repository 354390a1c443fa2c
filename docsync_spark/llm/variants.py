"""Spelling variants by composing a minimal acceptor of the vocabulary with a one-edit transducer and the acceptor again.

Words are counted where the texts are read. Two words that differ by one code point agree before and after it. Let the place of an
edit be the first at which the longer word and the other differ, and L the longer word's length. The L places are cut in two
halves; a pair whose edit lies in one of them agrees on all the other half, which therefore names the state from which the
composition starts: (L, half, what stands outside of it). Each word goes to four such partitions, with L its length or one more, and
each pair of near words meets in exactly one. A partition of too many words is cut again, by the halves of what is still open, until one place is
left, where no more than an alphabet can meet.

In a partition the open middles of the words make a minimal acyclic acceptor. The composition walks it once: on unedited paths both
copies of the acceptor are in the same state, from which the transducer's edit (another letter, or one left out) leads to a pair of states; what both
accept from there ends a pair of near words. What pairs of states accept is kept, since minimal acceptors come to the same pairs
again and again. Only a count and the best neighbour of each word leave the partition, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.llm.common import materialize, table

#: What words are made of, and which of it is lower-cased.
LETTERS, UPPER, LOWER = "A-Za-z\\u00C0-\\u00FF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a partition beyond which it is cut again.
MOST = 1 << 12


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run) of each run of letters, A-Z in lower case."""
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    return docs.select(F.col(id_col).alias("id"), F.explode(F.split(lowered, f"[^{LETTERS}]+")).alias("run")).filter("run <> ''")


def misspelt(id_: Column, run: Column) -> Column:
    """run, without one of its code points where the checksum of id and run divides by 31. A null id is empty."""
    h = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 31 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def minimal_acceptor(words: list[str]) -> list[tuple[bool, dict[str, int]]]:
    """States (accepting, arcs) of the minimal acyclic acceptor of sorted distinct words; arcs lead to earlier states, the last state is the first one."""
    states: list[tuple[bool, dict[str, int]]] = []
    known: dict[tuple, int] = {}

    def settled(state: list) -> int:
        key = (state[0], *state[1].items())
        if key not in known:
            known[key] = len(states)
            states.append((state[0], state[1]))
        return known[key]

    path: list[list] = [[False, {}]]  # the states of the last word that may still change
    last = ""
    for word in words:
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            state = path.pop()
            path[-1][1][last[len(path) - 1]] = settled(state)
        path += [[False, {}] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        state = path.pop()
        path[-1][1][last[len(path) - 1]] = settled(state)
    states.append((path[0][0], path[0][1]))
    return states


def one_edit_pairs(words: list[str], longer: int, after: str) -> Iterator[tuple[str, str]]:
    """Pairs (x, y) of sorted distinct words one edit apart, x of the length longer.

    y has the same length and is smaller, or it lacks one code point of x. The edit is at the first difference of
    the words, and if they agree throughout the shorter one, what comes ``after`` both of them must differ from the last of x.
    """
    states = minimal_acceptor(words)
    both: dict[tuple[int, int], tuple[str, ...]] = {}

    def ends(p: int, q: int) -> tuple[str, ...]:
        """What both states accept. Arcs lead to earlier states, so a stack of open pairs comes to an end."""
        wanted = [(p, q)]
        while wanted:
            a, b = top = wanted[-1]
            if top in both:
                wanted.pop()
                continue
            (final_a, arcs_a), (final_b, arcs_b) = states[a], states[b]
            shared = [(c, (to, arcs_b[c])) for c, to in arcs_a.items() if c in arcs_b]
            missing = [s for _, s in shared if s not in both]
            if missing:
                wanted += missing
                continue
            both[top] = (*([""] if final_a and final_b else []), *[c + e for c, s in shared for e in both[s]])
            wanted.pop()
        return both[p, q]

    walk = [(len(states) - 1, "")]
    while walk:
        at, before = walk.pop()
        final, arcs = states[at]
        if len(before) >= longer:
            continue
        letters = list(arcs.items())
        room = longer - len(before) - 1  # what may follow the edit in x
        for i, (a, p) in enumerate(letters):
            for b, q in letters[:i]:
                low, high = (b, a) if b < a else (a, b)
                for e in ends(p, q):
                    if len(e) == room:
                        yield before + high + e, before + low + e
            for c, to in states[p][1].items():  # a is left out: what follows it also follows before
                if c != a and c in arcs:
                    for e in ends(to, arcs[c]):
                        if len(e) == room - 1:
                            yield before + a + c + e, before + c + e
            if not room and final and states[p][0] and a != after:
                yield before + a, before
        walk += [(to, before + c) for c, to in letters]


def _partition(longer: int, low: int, high: int, words: list[str], n: list[int], found: dict) -> None:
    """Adds the near pairs of words that agree outside of [low, high) of the longer one: found[word] = [near words, their best (n, word)]."""
    tail = longer - high
    middles = {w[low : len(w) - tail]: i for i, w in enumerate(words)}
    after = words[0][len(words[0]) - tail :][:1]
    for x, y in one_edit_pairs(sorted(middles), high - low, after):
        i, j = middles[x], middles[y]
        for a, b in ((i, j), (j, i)):
            held, other = found.setdefault(words[a], [0, None]), (-n[b], words[b])
            held[0] += 1
            if held[1] is None or other < held[1]:
                held[1] = other


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, n_near, best_n, best) of each word with a near one in a partition; rows come sorted by key."""

    def partitions(rows: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {}
        words, n, longer, low, high = (rows[c].tolist() for c in ("word", "n", "longer", "low", "high"))
        edges = [0, *(np.flatnonzero(np.diff(rows["key"].to_numpy(np.int64))) + 1).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:]):
            if b - a < 2:
                continue
            apart: dict[tuple, list[int]] = {}  # different partitions of one key
            for i in range(a, b):
                tail = longer[i] - high[i]
                apart.setdefault((longer[i], low[i], high[i], words[i][: low[i]], words[i][len(words[i]) - tail :]), []).append(i)
            for (l, x, y, _, _), of in apart.items():
                if len(of) > 1:
                    _partition(l, x, y, [words[i] for i in of], [n[i] for i in of], found)
        return pd.DataFrame({"word": np.array(list(found), object), "n_near": np.array([x[0] for x in found.values()], np.int64), "best_n": np.array([-x[1][0] for x in found.values()], np.int64), "best": np.array([x[1][1] for x in found.values()], object)})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.flatnonzero(np.diff(rows["key"].to_numpy(np.int64))) + 1
        if len(new):
            yield partitions(rows.iloc[: new[-1]])
        held = rows.iloc[new[-1] if len(new) else 0 :].reset_index(drop=True)
    if held is not None and len(held) > 1:
        yield partitions(held)


def near_words(vocabulary: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) that has a near one; best has the largest n, of several the smallest word."""
    length = F.length("word")
    lengths = F.explode(F.array(length, length + 1)).alias("longer")
    halves = F.inline(F.array(F.struct(F.lit(0).alias("low"), (F.col("longer") / 2).cast("int").alias("high")), F.struct((F.col("longer") / 2).cast("int").alias("low"), F.col("longer").alias("high"))))
    key = F.xxhash64("longer", "low", "high", F.substring("word", F.lit(1), F.col("low")), F.expr("right(word, longer - high)")).alias("key")
    open_ = vocabulary.select("word", "n", lengths).select("*", halves).select("*", key)
    out = None
    while True:
        sizes = materialize(open_.groupBy("key").count().filter("count > 1"))
        large = sizes.filter(F.col("count") > most).limit(1).count() > 0
        dealt = open_.join(sizes, "key")
        dealt = materialize(dealt) if large else dealt
        # one place only holds an alphabet of words, and is never cut
        cut = (F.col("count") > most) & (F.col("high") - F.col("low") > 1)
        rows = dealt.filter(~cut).drop("count").repartition("key").sortWithinPartitions("key")
        found = rows.mapInPandas(_composed, "word string, n_near long, best_n long, best string")
        out = found if out is None else out.union(found)
        if not large:
            break
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        ranges = F.inline(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("high").alias("b"))))
        open_ = dealt.filter(cut).select("word", "n", "longer", ranges).select("word", "n", "longer", F.col("a").alias("low"), F.col("b").alias("high")).select("*", key)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spelt: Callable[[Column, Column], Column] | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of docs of so many code points and occurrences.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; spelt(id, run) may change each occurrence. form is the near word that
    occurs most, of several the first in code-point order, if it occurs ratio times as often as the word; root is
    where forms lead in the end. ratio has to be over 1, so that they lead somewhere. Null and empty texts have no words, repeated rows
    count each time, null ids are empty to spelt. An empty table has no words; other columns of docs are not looked at.
    """
    if ratio <= 1:
        raise ValueError("ratio has to be over 1")
    runs = runs_of(docs, id_col, text_col)
    word = spelt(F.col("id"), F.col("run")) if spelt else F.col("run")
    counted = runs.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
    vocabulary = materialize(counted)
    near = near_words(vocabulary, most)
    often = F.col("best_n") >= ratio * F.col("n")
    rows = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n"))
    rows = materialize(rows)

    # counts grow by the ratio with each step, so few doublings reach every root
    up = rows.filter("form is not null").select("word", F.col("form").alias("to"))
    while True:
        further = up.join(up.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        doubled = materialize(further.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        up = doubled.select("word", "to")
        if not doubled.filter("moved").limit(1).count():
            break
    return rows.join(up, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, its near words, its form and its root."""
    return variants(table(spark, sf_dir, "documents"), spelt=misspelt).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL = {
    "op12_spelling_variants": """
    WITH RECURSIVE bits(i, k, c) AS (
        SELECT i, 0, i FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
    ), grouped AS (
        SELECT run, count(*) AS n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
        FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
    ), summed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) AS h FROM grouped, crc_table
    ), spelt AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed
    ), words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    without AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(length(word)) r(i)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
    ), best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(near := near, n := n), struct_pack(m := -n, near := near)) AS b FROM pairs GROUP BY word),
    formed AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.near END AS form, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n
        FROM words w LEFT JOIN best USING (word)
    ), steps(word, root) AS (
        SELECT word, word FROM formed
        UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL
    ), roots AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
    """
}
