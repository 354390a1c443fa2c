"""Exact top-k search by inner product: ball trees per shard, branch and bound.

Vectors are dealt into shards by a coarse ball tree that is grown from a bounded sample; a shard that
is too large is cut into parts, whatever its rows. Each query first searches the shard whose center it likes best; the
k-th score found there settles, on the small table of the shards' balls and before any query is copied,
which other shards can hold a better one: those with an upper bound ``q.c + |q| r`` that reaches it. Inside a task whole
balls are skipped in the same way, and the k-th score rises further from shard to shard.
Queries are copied to shards in blocks; a part is bounded by its number of components,
so that a task holds one part's trees and one block of queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import materialize, table, thinned

#: Components and scores are longs; others raise an error.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
LEAF = 256
BLOCK = 1024
#: Bounds of the sample from which shards are made (rows; components in all), and of the shards' number; shards that share a task, about.
SAMPLE_ROWS, SAMPLE_COMPONENTS, MOST_SHARDS, SHARDS_A_TASK = 1 << 14, 1 << 22, 1 << 12, 4


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; unusable vectors are left out.

    Unusable are null vectors, null ids, and null or non-finite components. A component whose
    product is no long is an error.
    """
    vec = F.col(vec_col)
    usable = vec.isNotNull() & F.col(id_col).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    product = lambda x: x.cast("double") * scale
    fits = lambda x: (product(x) >= float(LOWEST)) & (product(x) < -float(LOWEST))
    x = F.transform(vec, lambda x: F.when(fits(x), F.floor(product(x))).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long")))
    return df.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v"))


def _halves(x: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(direction, projections) that part the rows of x between two that lie far apart; away: distances from the center."""
    a = x[away.argmax()]
    b = x[((x - a) ** 2).sum(axis=1).argmax()]
    return b - a, x @ (b - a)


class Shards:
    """A coarse ball tree over a sample: which shard a vector is dealt to, and each shard's center."""

    def __init__(self, sample: list[np.ndarray], wanted: int):
        self.trees, self.centers = {}, []
        by_dim: dict[int, list] = {}
        for v in sample:
            by_dim.setdefault(len(v), []).append(v)
        self.dims: list[int] = []
        for d in sorted(by_dim):
            x = np.array(by_dim[d], np.float64).reshape(len(by_dim[d]), d)
            self.trees[d] = self._grown(x, wanted * len(x) / len(sample))

    def _grown(self, x: np.ndarray, wanted: float):
        center = x.mean(axis=0)
        away = ((x - center) ** 2).sum(axis=1)
        if wanted > 1.5 and len(x) >= 8 and away.max() > 0:
            direction, along = _halves(x, away)
            steps = np.sort(along)
            a, b = len(steps) // 4, -(-3 * len(steps) // 4)
            at = a + int(np.diff(steps[a : b + 1]).argmax())  # the widest gap of the middle half
            cut = (steps[at] + steps[at + 1]) / 2
            low = along <= cut
            if 0 < low.sum() < len(x):
                return direction, cut, self._grown(x[low], wanted * low.mean()), self._grown(x[~low], wanted * (1 - low.mean()))
        self.centers.append(center)
        self.dims.append(x.shape[1])
        return len(self.centers) - 1

    def dealt(self, vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """(shard, distance from its center, rounded up) of each vector; -1 and infinite for lengths that the sample lacks."""
        shard, distance = np.full(len(vectors), -1, np.int32), np.full(len(vectors), np.inf)
        sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))

        def go(node, x: np.ndarray, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, tuple):
                low = x @ node[0] <= node[1]
                go(node[2], x[low], at[low])
                go(node[3], x[~low], at[~low])
                return
            shard[at] = node
            away = x - self.centers[node]
            distance[at] = np.sqrt((away * away).sum(axis=1)) * (1 + 1e-9) + 1e-6

        for d, tree in self.trees.items():
            at = np.flatnonzero(sizes == d)
            if len(at):
                go(tree, np.array([vectors[i] for i in at], np.float64).reshape(len(at), d), at)
        return shard, distance

    def bounds(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shards of q's length, upper bound of q's scores in each, of each row of q)."""
        of = np.flatnonzero(np.array(self.dims, np.int64) == q.shape[1])
        if not len(of):
            return of, np.zeros((len(q), 0))
        centers = np.array([self.centers[i] for i in of]).reshape(len(of), q.shape[1])
        norm = np.sqrt((q * q).sum(axis=1))[:, None]
        slack = norm * (np.sqrt((centers * centers).sum(axis=1)) + np.where(np.isfinite(radius[of]), radius[of], 0))[None] * 1e-9 + 1e-6
        return of, q @ centers.T + norm * radius[of][None] + slack


def _largest(x: np.ndarray) -> int:
    """The largest absolute value, as a number without bounds."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _scores(q: np.ndarray, qf: np.ndarray, leaf: np.ndarray, own: np.ndarray, largest: int) -> np.ndarray:
    """Inner products as longs, in the fastest numbers that hold what ``largest`` bounds; own pairs do not count."""
    if largest < 1 << 53:
        return (qf @ leaf.T.astype(np.float64)).astype(np.int64)
    if largest < 1 << 63:
        return q.astype(np.int64) @ leaf.T.astype(np.int64)
    score = q.astype(object) @ leaf.T.astype(object)
    score[own] = 0
    if not ((score >= LOWEST) & (score <= HIGHEST)).all():
        raise OverflowError("a score does not fit a long")
    return score.astype(np.int64)


class BallTree:
    """Balls over the rows of a matrix; a leaf's rows are in order of their ids."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.most = _largest(rows)
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(ids)))

    def _grow(self, at: np.ndarray) -> int:
        x = self.rows[at].astype(np.float64)
        center = x.mean(axis=0)
        away = ((x - center) ** 2).sum(axis=1)
        me = len(self.nodes)
        self.nodes.append(None)
        kids = None
        if len(at) > LEAF:
            order = np.argsort(_halves(x, away)[1], kind="stable")
            half = len(at) // 2
            kids = (self._grow(at[order[:half]]), self._grow(at[order[half:]]))
        else:
            at = at[np.argsort(self.ids[at], kind="stable")]
        self.nodes[me] = (center, float(np.sqrt(away.max(initial=0))), kids, at)
        return me

    def bound(self, node: int, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        center, radius, _, _ = self.nodes[node]
        return q @ center + norm * radius + norm * (np.sqrt(center @ center) + radius) * 1e-9 + 1e-6

    def search(self, q: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best (score, id, whether there is one) of each query among the rows that reach its kth; kth is raised in place."""
        n, qf = len(q), q.astype(np.float64)
        norm = np.sqrt((qf * qf).sum(axis=1))
        top, who, none = np.full((n, k), LOWEST, np.int64), np.zeros((n, k), np.int64), np.ones((n, k), bool)
        largest = q.shape[1] * self.most * _largest(q)
        everyone = np.arange(n)
        first = self.bound(0, qf, norm)
        heap = [(-float((first - kth).max()), 0, everyone, first)]
        while heap:
            _, node, active, upper = heapq.heappop(heap)
            keep = upper >= kth[active]
            if not keep.any():
                continue
            active = active[keep]
            _, _, kids, at = self.nodes[node]
            if kids is not None:
                for kid in kids:
                    upper = self.bound(kid, qf[active], norm[active])
                    keep = upper >= kth[active]
                    if keep.any():
                        heapq.heappush(heap, (-float((upper - kth[active])[keep].max()), kid, active[keep], upper[keep]))
                continue
            leaf, ids = self.rows[at], self.ids[at]
            same = own[active][:, None] == ids[None, :]
            score = _scores(q[active], qf[active], leaf, same, largest)
            score[same] = LOWEST
            some = ((score >= kth[active][:, None]) & ~same).any(axis=1)
            if not some.any():
                continue
            active, score, same = active[some], score[some], same[some]
            # ~x falls as x rises, and unlike -x it holds the lowest long
            best = np.lexsort((~score, same), axis=1)[:, :k]
            scores = np.concatenate([top[active], np.take_along_axis(score, best, 1)], axis=1)
            names = np.concatenate([who[active], ids[best]], axis=1)
            absent = np.concatenate([none[active], np.take_along_axis(same, best, 1)], axis=1)
            order = np.lexsort((names, ~scores, absent), axis=1)[:, :k]
            top[active], who[active], none[active] = (np.take_along_axis(x, order, 1) for x in (scores, names, absent))
            kth[active] = np.maximum(kth[active], np.where(none[active, k - 1], LOWEST, top[active, k - 1]))
        return top, who, ~none


def _searcher(k: int):
    """Over rows sorted by (cell, kind): vectors (kind 0) become trees, then queries pass by in blocks."""

    def search(batches):
        cell, parts, trees = None, [], None
        raised: dict[tuple[int, int], int] = {}

        def grown():
            by_dim: dict[int, list] = {}
            for ids, vecs in parts:
                for i, v in zip(ids, vecs, strict=True):
                    by_dim.setdefault(len(v), []).append((i, v))
            return {d: BallTree(np.array([v for _, v in rows], np.int64).reshape(len(rows), d), np.array([i for i, _ in rows], np.int64)) for d, rows in by_dim.items()}

        for batch in batches:
            for (s, kind), part in batch.groupby(["cell", "kind"], sort=True):
                if s != cell:
                    cell, parts, trees = s, [], None
                if kind == 0:
                    parts.append((part["vec_id"].to_numpy(), part["v"].tolist()))
                    continue
                if trees is None:
                    trees, parts = grown(), []
                for at in range(0, len(part), BLOCK):
                    block = part.iloc[at : at + BLOCK]
                    sizes = block["v"].map(len)
                    for d in sizes.unique():
                        rows = block[sizes == d]
                        own, copy = rows["vec_id"].to_numpy(np.int64), rows["copy"].to_numpy(np.int64)
                        kth = rows["kth"].to_numpy(np.int64).copy()
                        for j, key in enumerate(zip(own, copy, strict=True)):
                            kth[j] = max(kth[j], raised.get(key, LOWEST))
                        q = np.array(rows["v"].tolist(), np.int64).reshape(len(rows), d)
                        if d in trees:
                            top, who, real = trees[d].search(q, own, k, kth)
                        else:
                            top, who, real = (np.zeros((len(rows), k), kind) for kind in (np.int64, np.int64, bool))
                        if len(raised) > 1_000_000:
                            raised.clear()
                        raised.update(zip(zip(own, copy, strict=True), kth.tolist(), strict=True))
                        yield pd.DataFrame({
                            "vec_id": own, "copy": copy,
                            "hit_ids": [w[r].tolist() for w, r in zip(who, real, strict=True)],
                            "hit_scores": [t[r].tolist() for t, r in zip(top, real, strict=True)],
                        })

    return search


FOUND = "vec_id long, copy long, hit_ids array<long>, hit_scores array<long>"


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_components: int = 1 << 23, least_shards: int = 12, report: dict | None = None) -> DataFrame:
    """The k vectors with the highest inner product for each query, exactly.

    vectors: (vec_id, v array<long>); queries: the same. A candidate is any vector whose vec_id is
    not the query's; ties go to the smaller vec_id; fewer candidates than k give fewer rows.
    Only vectors as long as the query are compared. Rows with equal vec_id are separate candidates;
    equal query rows are answered once, different vectors under one query id each on their own.
    An empty table of vectors or queries gives no rows; further columns are not looked at.
    Scores are longs; one that is no long is an error. Returns (query_id, copy, rank, vec_id, score); copy tells vectors
    of one query id apart. report gets the number of (query, shard) pairs in all and of those searched.
    """
    spark = vectors.sparkSession
    vectors, queries = (x.select("vec_id", F.col("v").cast("array<long>").alias("v")) for x in (vectors, queries))
    n, size = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    wanted = min(max(-(-size // shard_components), min(least_shards, -(-n // 1024)), 1), MOST_SHARDS)
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_COMPONENTS * n // max(size, 1)))
    sample = [np.array(r["v"], np.int64) for r in thinned(vectors, ["vec_id", "v"], rows, n).limit(2 * rows).select("v").collect()]
    shards = Shards(sample, min(SHARDS_A_TASK * wanted, MOST_SHARDS) if wanted > 1 else 1)
    sent = spark.sparkContext.broadcast(shards)

    def deal(batches):
        for batch in batches:
            shard, distance = sent.value.dealt(batch["v"].tolist())
            yield batch.assign(shard=shard, distance=distance)

    dealt = vectors.mapInPandas(deal, "vec_id long, v array<long>, shard int, distance double").withColumn("row", F.monotonically_increasing_id())
    dealt = materialize(dealt)  # row numbers stay as they are from here on
    balls = dealt.groupBy("shard").agg(F.max("distance").alias("radius"), F.sum(F.size("v")).alias("size"))
    known = {r["shard"]: r for r in balls.collect()}  # MOST_SHARDS + 1 rows at most
    parts = {s: max(1, -(-r["size"] // shard_components)) for s, r in known.items()}
    radius = np.array([known[i]["radius"] if i in known else -np.inf for i in range(len(shards.centers))])
    several = spark.createDataFrame([(s, n) for s, n in parts.items() if n > 1], "shard int, number int")  # a row a shard at most
    cell = F.col("shard").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), F.coalesce("number", F.lit(1)))
    data = dealt.join(F.broadcast(several), "shard", "left").select(cell.alias("cell"), F.lit(0).alias("kind"), "vec_id", F.lit(0).cast("long").alias("copy"), "v", F.lit(LOWEST).alias("kth"))
    tasks = max(wanted, -(-sum(parts.values()) // SHARDS_A_TASK))
    extents = spark.sparkContext.broadcast((radius, parts))

    def routed(batches):
        """The cells of each query: of its home shard where kth is null, else of all others that can reach kth."""
        shards, (radius, parts) = sent.value, extents.value
        for batch in batches:
            out = []
            sizes = batch["v"].map(len)
            for d in sizes.unique():
                some = batch[sizes == d]
                of, upper = shards.bounds(np.array(some["v"].tolist(), np.float64).reshape(len(some), d), radius)
                alive = np.array([i in parts for i in of], bool)
                of, upper = of[alive], upper[:, alive]
                home = upper.argmax(axis=1) if len(of) else None
                for j, (vec_id, copy, v, kth, again) in enumerate(some[["vec_id", "copy", "v", "kth", "again"]].itertuples(index=False, name=None)):
                    if not again:
                        chosen = [of[home[j]]] if len(of) else []
                    else:
                        chosen = [s for i, s in enumerate(of) if i != home[j] and upper[j, i] >= kth]
                        chosen += [-1] if -1 in parts else []
                    out += [(int(s) * (1 << 32) + p, 1, vec_id, copy, v, kth) for s in chosen for p in range(parts[s])]
            yield pd.DataFrame(out, columns=["cell", "kind", "vec_id", "copy", "v", "kth"])

    def searched(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        to = asked.mapInPandas(routed, "cell long, kind int, vec_id long, copy long, v array<long>, kth long")
        both = data.unionByName(to).repartition(tasks, "cell").sortWithinPartitions("cell", "kind")
        return both.mapInPandas(_searcher(k), FOUND), to

    asked = queries.select("vec_id", F.xxhash64("v").alias("copy"), "v").distinct()
    asked = materialize(asked.select("vec_id", "copy", "v", F.lit(LOWEST).alias("kth"), F.lit(False).alias("again")))
    found, to = searched(asked)
    first = materialize(found)
    best = first.select("vec_id", "copy", F.explode("hit_scores").alias("score")).groupBy("vec_id", "copy").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, k).alias("best"))
    kth = F.when(F.size("best") == k, F.array_min("best")).otherwise(F.lit(LOWEST))
    again = asked.select("vec_id", "copy", "v").join(best, ["vec_id", "copy"], "left").select("vec_id", "copy", "v", F.coalesce(kth, F.lit(LOWEST)).alias("kth"), F.lit(True).alias("again"))
    found, then = searched(again)
    if report is not None:
        report |= {"pairs": asked.count() * sum(parts.values()), "searched": to.count() + then.count()}
    hits = first.unionByName(found)
    flat = hits.select(F.col("vec_id").alias("query_id"), "copy", F.inline(F.arrays_zip(F.col("hit_ids").alias("vec_id"), F.col("hit_scores").alias("score"))))
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "copy", "rank", "vec_id", "score")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding whose vec_id is divisible by 50 against all others, 5 best."""
    vectors = quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0)).drop("copy")


SQL = {
    "op1_exact_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum([CAST(q.v[i] AS HUGEINT) * c.v[i] FOR i IN range(1, len(q.v) + 1)]), 0) AS BIGINT) AS score
  FROM (SELECT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
QUERIES = {"op1_exact_top_k": op1_exact_top_k}
