"""SimHash near-duplicates by vantage-point trees.

Fingerprints are computed where the text is read. Distinct fingerprints are then dealt to shards: the bits
are cut into radius + 1 runs, and two fingerprints that differ in radius bits at most agree on one run, so
each goes to radius + 1 shards, one for each run's value, and every link lies inside a shard. That many copies of
each, whatever the data. A shard of more than SHARD_ROWS is dealt again, by its other bits, in the same way.
Inside a shard the fingerprints are parted by their Hamming distance from vantage points into a tree; where the
triangle bound lets a partner lie beyond a ball's boundary, a fingerprint also visits the other side. A shard
returns a spanning forest of its links, never all pairs; the forests are joined into components by alternating
star contraction.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import materialize, steps, table, unused, utf8

SEED = 42
#: Distinct fingerprints in a shard at most.
SHARD_ROWS = 1 << 13
#: Points below which a leaf's own tree compares all.
SMALL = 128
#: Rows up to which the keys of chosen documents go to all tasks, so that no text is shuffled.
FEW = 1 << 20
#: Fingerprints compared with others in one step.
CHUNK = 1 << 21


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, as unsigned number."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < 4:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = [0, *(ends[:-3].tolist())]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist(), strict=True)), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set where they are in over half of the unsigned hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text and with fp, the fingerprint as signed long; one row for each row of docs."""
    kept = [c for c in docs.columns if c != text_col]
    schema = docs.select(*kept).schema.add("fp", "long")

    def run(batches):
        for batch in batches:
            texts = utf8(batch[text_col])
            found = [fingerprint(texts[i]) for a, b in steps(texts) for i in range(a, b)]
            yield batch[kept].assign(fp=np.array(found, np.uint64).view(np.int64))

    return docs.mapInPandas(run, schema)


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """The vantage point and its ball's radius that part the points with the thinnest boundary."""
    best = None
    sample = points if len(points) <= 2048 else points[rng.choice(len(points), 2048, replace=False)]
    for v in sample[rng.choice(len(sample), min(8, len(sample)), replace=False)]:
        counts = np.bincount(_distance(sample, v), minlength=66)
        inner = np.cumsum(counts)
        for mu in range(64):
            if min(inner[mu], len(sample) - inner[mu]) < 0.25 * len(sample):
                continue
            edge = counts[max(0, mu - radius + 1) : mu + radius + 1].sum() / len(sample)
            cost = edge + 0.2 * abs(inner[mu] / len(sample) - 0.5)
            if best is None or cost < best[0]:
                best = (cost, v, mu)
    return None if best is None else best[1:]


def _route(node, points: np.ndarray, at: np.ndarray, home: np.ndarray, radius: int, out: list) -> None:
    """Appends (leaf, positions, home or visitor) for each leaf that the points reach.

    A visitor goes wherever a home point within the radius may be; a home point also visits the
    outer side if its partner may be there. One direction is enough to see each pair.
    """
    if not len(at):
        return
    if not isinstance(node, tuple):
        out.append((node, at, home))
        return
    vantage, mu, inner, outer = node
    d = _distance(points[at], np.uint64(vantage))
    inside = np.where(home, d <= mu, d <= mu + radius)
    own_outside = home & (d > mu)
    visits = np.where(home, (d <= mu) & (d > mu - radius), d > mu - radius)
    _route(inner, points, at[inside], home[inside], radius, out)
    beyond = own_outside | visits
    _route(outer, points, at[beyond], own_outside[beyond], radius, out)


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i]; label[x] is the smallest member of x's component."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        low, high = np.minimum(la[open_], lb[open_]), np.maximum(la[open_], lb[open_])
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link(points: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the components that home-home and home-visitor links make of distinct points."""
    rng = np.random.default_rng(1)
    label = np.arange(len(points))

    def search(at: np.ndarray, own: np.ndarray) -> None:
        homes = at[own]
        if not len(homes):
            return
        cut = _split(points[homes], radius, rng) if len(homes) > SMALL else None
        if cut is None:
            rows = max(1, CHUNK // len(at))
            for i in range(0, len(homes), rows):
                part = homes[i : i + rows]
                x, y = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[at][None, :]) <= radius)
                apart = part[x] != at[y]
                _union(label, part[x[apart]], at[y[apart]])
            return
        parts: list = []
        _route((*cut, 0, 1), points, at, own, radius, parts)
        for _, a, h in parts:
            search(a, h)

    search(np.arange(len(points)), home)
    return label


def runs(mask: int, parts: int) -> list[int]:
    """The mask with one of so many runs of the other bits added: each of the runs in turn."""
    free = [i for i in range(64) if not mask >> i & 1]
    ends = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(ends, ends[1:]) if a < b]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _searched(batches, radius: int):
    """(a, b), a > b: a spanning forest of the links of each shard; rows (mask, value, fp) come sorted by shard."""

    def forest(fp: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
        starts = np.cumsum(sizes) - sizes
        two = starts[sizes == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius
        found = [(np.maximum(fp[two], fp[two + 1])[near], np.minimum(fp[two], fp[two + 1])[near])]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            own = np.sort(fp[at : at + n])
            label = link(own.view(np.uint64), np.ones(n, bool), radius)
            joined = label != np.arange(n)
            found.append((own[joined], own[label[joined]]))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([x for _, x in found])})

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        new = np.flatnonzero((np.diff(rows["mask"]) != 0) | (np.diff(rows["value"]) != 0)) + 1
        if len(new):
            yield forest(rows["fp"].to_numpy(np.int64)[: new[-1]], np.diff(np.concatenate([[0], new])))
        held = rows.iloc[new[-1] if len(new) else 0 :].reset_index(drop=True)
    if held is not None:
        yield forest(held["fp"].to_numpy(np.int64), np.array([len(held)]))


def links(fps: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, a > b, that connect all within the radius."""
    open_, masks, out = fps.select("fp", F.lit(0).cast("long").alias("mask")), [0], None
    while masks:
        further = {m: runs(m, radius + 1) for m in masks}
        choice = F.create_map(*[x for m, to in further.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(t)).cast("long") for t in to]))])
        dealt = open_.select("fp", F.explode(choice[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        shared = materialize(dealt.groupBy("mask", "value").count().filter("count > 1"))
        dealt = dealt.join(shared, ["mask", "value"])
        large = shared.filter(F.col("count") > shard_rows).limit(1).count() > 0
        dealt = materialize(dealt) if large else dealt
        small = dealt.filter(F.col("count") <= shard_rows).select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
        found = small.mapInPandas(lambda b: _searched(b, radius), "a long, b long")
        out = found if out is None else out.union(found)
        open_ = dealt.filter(F.col("count") > shard_rows).select("fp", "mask")
        # the bits that are left shrink each time by a third at least, and a few bits have few values
        masks = [t for to in further.values() for t in to if t != (1 << 64) - 1] if large else []
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a > b), root the smallest node that it reaches.

    Alternates large-star and small-star steps, each written to the shared folder, until the
    edges stay the same; they number at most those given and are stars then.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour above a node goes to the smallest of the node and its neighbours
            both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            return both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a")
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(low.select("a", F.col("m").alias("b"))).distinct()

    edges = materialize(edges.distinct())
    before = state(edges)
    while before[0]:
        edges = materialize(star(star(edges, True), False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, fp, component_id, root) of every row of docs.

    component_id is the smallest id that links of at most radius differing bits reach, the row's
    own included; root names the component, also where ids repeat. Null and blank texts have fingerprint zero and link like any other. Rows with
    a null id take part; a component of such rows alone has a null component_id. Repeated rows
    come back as often as they came. An empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs.select(id_col, text_col, *keep), text_col))
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(distinct.select("fp"), radius)).toDF("fp", "root")
    rooted = materialize(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fp", "component_id", "root"))
    return marked.join(named, "fp").select(id_col, *keep, "fp", "component_id", "root")


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """The rows of docs that stay: of each component, as find has them, the one with the smallest id.

    Of several rows of a component with that id, which one stays is settled by their other columns' hash; rows of
    that id in other components are documents of their own. Components of null ids alone keep one row.
    """
    keys = [unused(docs, "row1"), unused(docs, "row2")]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(k), *docs.columns) for k in keys})
    own = keyed.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(keys[0]).alias("key0"), F.col(keys[1]).alias("key1"))
    found = find(own, "id", "text", keep=("key0", "key1"))
    first = found.filter(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = first.groupBy("root").agg(F.min(F.struct("key0", "key1")).alias("row")).select("row.*").distinct()
    chosen = materialize(chosen.toDF(*keys))
    kept = keyed.join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, keys, "left_semi")
    # only rows that come more than once are brought together; all others stay where they are
    several = materialize(kept.groupBy(*keys).count().filter("count > 1").select(*keys))
    n = several.count()
    if not n:
        return kept.select(*docs.columns)
    several = F.broadcast(several) if n <= FEW else several
    turn = unused(keyed, "turn")
    once = kept.join(several, keys, "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).filter(F.col(turn) == 1)
    return kept.join(several, keys, "left_anti").select(*docs.columns).union(once.select(*docs.columns))


QUERIES = {"op9_simhash_near_duplicates": op9_simhash_near_duplicates}
SQL: dict[str, str] = {}
