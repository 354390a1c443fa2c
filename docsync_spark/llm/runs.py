"""Periodic runs of words by the grouping phase of Baier's suffix sorter.

Phase one of that sorter needs no suffix array: from the highest group of suffixes down, each group's members leave a list of the
text's places, and the place before them joins a new group just above its own, since its context grows by theirs. When a place
leaves the list, the next one in it ends its longest Lyndon prefix; so grouping the words in one order and in the reverse
order gives both Lyndon arrays directly. Every run has a Lyndon root under one of the two orders (the runs theorem): each
place with its Lyndon prefix is a candidate that is extended to both sides by longest common extensions, and what reaches
far enough is a run. Extensions are exact: they look up names of stretches of 1, 2, 4, ... words.

A text is worked on where it is read; nothing is shuffled. Before it is grouped, the stretches that can hold a run are found: of a
run of ``least`` words and ``times`` periods each word lies in a window of ``least - least // times`` words that starts again one
period away. What no such window covers is in no run, and no run leaves its stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.llm.common import steps, table

U = np.uint64
#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3


def lyndon_ends(ranks: list[int]) -> list[int]:
    """For each place the end of the longest Lyndon word that starts there, by Baier's groups; ranks are 0, 1, ..., all in use."""
    n = len(ranks)
    members: list[list[int]] = [[] for _ in range(max(ranks, default=-1) + 1)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group = list(ranks)  # of each place
    lower, higher = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))  # groups beside each group
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # places beside each place, of those that have not left
    ends = [0] * n
    top = len(members) - 1
    while top >= 0:
        grown: dict[tuple[int, int], list[int]] = {}
        for i in members[top]:
            if group[i] != top:
                continue  # it has moved up
            j = before[i]
            if j >= 0 and group[j] == top:
                continue  # it leaves with the one before
            copies, x = 0, i
            while x < n and group[x] == top:
                ends[x] = x = after[x]
                copies += 1
            if x < n:
                before[x] = j
            if j >= 0:
                after[j] = x
                grown.setdefault((group[j], copies), []).append(j)
        # of places in one group, those that more copies follow come higher
        for old, copies in sorted(grown, reverse=True):
            new = len(members)
            members.append(grown[old, copies])
            above = higher[old]
            lower.append(old)
            higher.append(above)
            higher[old] = lower[above] = new
            for j in members[new]:
                group[j] = new
        top = lower[top]
    return ends


def names_of(ranks: np.ndarray) -> list[np.ndarray]:
    """For each power of two names of the stretches of so many words that start at each place: equal names, equal stretches."""
    levels, size = [ranks.astype(np.int32)], 1
    while 2 * size <= len(ranks):
        last = levels[-1].astype(np.int64)
        _, found = np.unique(last[:-size] * len(ranks) + last[size:], return_inverse=True)
        levels.append(found.astype(np.int32))
        size *= 2
    return levels


def _extended(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words before i and j, and how many from i and j on, are the same; i < j."""
    n, back, on = len(levels[0]), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        at = np.flatnonzero(j + on + size <= n)
        at = at[levels[k][i[at] + on[at]] == levels[k][j[at] + on[at]]]
        on[at] += size
        at = np.flatnonzero(i - back >= size)
        at = at[levels[k][i[at] - back[at] - size] == levels[k][j[at] - back[at] - size]]
        back[at] += size
    return back, on


def runs_in(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of the runs of so many words and periods, sorted; ids name the words."""
    _, ranks = np.unique(ids, return_inverse=True)
    levels, found = names_of(ranks), []
    for order in (ranks, ranks.max() - ranks):
        i = np.arange(len(ids))
        period = np.array(lyndon_ends(order.tolist()), np.int64) - i
        i = i[(times * period <= len(ids)) & (i + period < len(ids))]
        period = period[i]
        back, on = _extended(levels, i, i + period)
        length = back + period + on
        far = length >= np.maximum(least, times * period)
        found.append(np.stack([i - back, length, period], axis=1)[far])
    both = np.unique(np.concatenate(found), axis=0)
    return both[np.lexsort((both[:, 2], both[:, 0]))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def stretches(ids: np.ndarray, sizes: list[int], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(text, start, end), as places in ids, of what can hold a run; ids are those of texts of these sizes, one after the other."""
    width = least - least // times
    if len(ids) < least:
        return
    text = np.repeat(np.arange(len(sizes)), sizes)
    h, size = _mixed(ids.astype(U) + U(1)), 1
    while 2 * size <= width:
        h, size = _mixed(h[:-size] * U(0x9E3779B97F4A7C15) + h[size:]), 2 * size
    over = width - size  # two windows of a power of two, one at either end
    h = h[: len(ids) - width + 1] * U(0xC2B2AE3D27D4EB4F) + h[over : over + len(ids) - width + 1]
    own = text[: len(h)]
    h = _mixed(h) ^ _mixed(own.astype(U) + U(7))
    at = np.flatnonzero(own == text[width - 1 :])  # windows inside of a text
    at = at[np.argsort(h[at], kind="stable")]
    near = (h[at[1:]] == h[at[:-1]]) & (own[at[1:]] == own[at[:-1]]) & (times * (at[1:] - at[:-1]) <= np.asarray(sizes)[own[at[1:]]])
    begin = np.unique(np.concatenate([at[1:][near], at[:-1][near]]))
    if not len(begin):
        return
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + width, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = np.concatenate([[True], text[1:] != text[:-1]])
    first = np.flatnonzero(inside & (new | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (np.concatenate([new[1:], [True]]) | ~np.concatenate([inside[1:], [False]]))) + 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= least:
            yield int(text[a]), a, b


Rewrite = Callable[[object, int], tuple[int, int] | None]


def _searched(batches: Iterator[pa.RecordBatch], least: int, times: int, rewrite: Rewrite | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        keys = batch.column(0).to_pylist()
        for low, high in steps(texts):
            index: dict[bytes, int] = {}
            words, ids, sizes = [], [], []
            for key, text in zip(keys[low:high], texts[low:high], strict=True):
                own = text.split()
                rule = rewrite(key, len(own)) if rewrite else None
                if rule:
                    a, p = rule
                    own = own[:a] + (own[a : a + p] * ((len(own) - a) // p + 1))[: len(own) - a]
                words.append(own)
                ids += [index.setdefault(w, len(index)) for w in own]
                sizes.append(len(own))
            flat, starts = np.array(ids, np.int64), np.concatenate([[0], np.cumsum(sizes)]).tolist()
            runs: list[list[dict]] = [[] for _ in sizes]
            for of, a, b in stretches(flat, sizes, least, times):
                runs[of] += [{"start": a - starts[of] + s, "length": n, "period": p} for s, n, p in runs_in(flat[a:b], least, times).tolist()]
            kept = []
            for own, found in zip(words, runs, strict=True):
                if found:
                    edge = np.zeros(len(own) + 1, np.int32)
                    for r in found:
                        edge[r["start"] + r["period"]] += 1
                        edge[r["start"] + r["length"]] -= 1
                    own = [w for w, c in zip(own, np.cumsum(edge[:-1]).tolist(), strict=True) if not c]
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sizes, pa.int64()), pa.array(runs, schema.field(2).type), pa.array(kept, pa.binary())], schema=schema)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES, rewrite: Rewrite | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row of docs.

    Words are what stands between blanks, numbered from 0. runs, an array of (start, length, period) by start and period, has each stretch of
    ``least`` words and ``times`` periods or more whose smallest period no neighbouring word carries on. collapsed is the text
    of the words, one blank between them, without those that a run holds after its first period. rewrite(id, n) may
    give (a, p): the words from a on then repeat the p words at a. Null and empty texts have no words; repeated rows are rows of
    their own; an empty table gives an empty result; other columns of docs are not looked at. A text that is periodic throughout takes memory
    in proportion to n log n of its n words.
    """
    if times < 2 or least < times:
        raise ValueError("runs have two periods at least, and no fewer words than periods")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = "id " + docs.schema[id_col].dataType.simpleString() + ", n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"

    def run(batches):
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.binary())])
            yield from _searched(iter([batch]), least, times, rewrite, schema)

    return rows.mapInArrow(run, kind).select(F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def periodic_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """One id in ten by its checksum has a tail that repeats three to ten times; a null id has none."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document and what is left without their repeats."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=periodic_tail)
    longest = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL = {
    "op11_periodic_runs": """
    WITH RECURSIVE bits(i, k, c) AS (
        SELECT i, 0, i FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
    ), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    docs AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
            CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) END AS h
        FROM documents, crc_table
    ), tails AS (
        SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN (h // 10) % len(ws) END AS a, 3 + (h // 10) % 8 AS parts FROM docs
    ), changed AS (
        SELECT doc_id, n, list_transform(range(n), lambda i: CASE WHEN i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // parts)] ELSE ws[1 + i] END) AS ws FROM tails
    ), words AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM changed),
    equal AS (
        SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
    ), islands AS (
        SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal)
        GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)
    ), found AS (
        SELECT * FROM islands r WHERE NOT EXISTS (SELECT 1 FROM islands o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.len >= r.s + r.len)
    ), per AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS text, list(struct_pack(s := s, len := len, q := q) ORDER BY s, q) AS runs FROM found GROUP BY doc_id
    ), most AS (
        SELECT doc_id, s, len, q FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len::DOUBLE / q DESC, s, q) AS k FROM found) WHERE k = 1
    ), dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM found),
    kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, m.s AS start, m.len AS length, m.q AS period, 1000 * m.len // m.q AS exponent_milli,
        sha256(coalesce(p.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
    FROM documents d LEFT JOIN per p USING (doc_id) LEFT JOIN most m USING (doc_id) LEFT JOIN kept k USING (doc_id)
    """
}
