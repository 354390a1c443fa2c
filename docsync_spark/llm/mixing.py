"""Mixing sources to target weights by a low-discrepancy schedule.

The words of each source's documents, in an order shuffled by hash, make one stream that is cut into
blocks of equal numbers of words. The mix is a row of slots of one block each. Slot i has the golden
ratio point frac(i * phi); the sources' targets, laid end to end, say whose slot it is, so that
any run of slots holds the sources in near their shares. The r-th slot of a source takes its r-th
block, and begins anew after the last one. Only DataFrame functions are used.

Positions in a stream, ranks of slots and sources' places are prefix sums over rows that are sorted across all
tasks (``common.in_order``), so that neither one large source nor all sources are ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import in_order, materialize, table, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
#: The golden ratio's fraction, times 2^32; points are exact in integers.
GOLDEN, ONE = 2654435769, 1 << 32
#: The points' cells have 2^CELL_BITS points each, 4096 cells in all.
CELL_BITS = 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(sid, source, source_size, weight, target, ahead, below) from (source, source_size), one row a source; sid numbers them.

    ahead and below are the sums of source_size and of target over the sources before.

    Sources in the order of their code points, null last, take the weights in turn and share
    ``share`` times all words; a target stops at ``most`` times its source's size, and what is over
    goes to the others by weight. That is min(cap, level * weight) for one level, found by
    sorting the sources by the level at which they are full.
    """
    rows = in_order(sizes, [F.col("source").isNull(), F.col("source").cast("binary")], {"ahead": "source_size"}).withColumnRenamed("place", "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = rows.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double")).withColumn("full", F.col("cap") / F.col("weight"))
    rows = in_order(rows, [F.col("full"), F.col("sid")], {"caps": "cap", "weights": "weight"}).drop("place")
    whole = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))  # one row
    level = (F.col("words") * share - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    levels = rows.join(F.broadcast(whole), how="cross").withColumn("level", level)
    # the first level that does not fill its own source holds for it and all after it
    found = levels.agg(F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("full", "sid", "level"))).alias("found"))
    target = F.coalesce(F.least("cap", F.col("found.level") * F.col("weight")), F.col("cap"))
    rows = rows.join(F.broadcast(found), how="cross").withColumn("target", target)
    return in_order(rows, [F.col("sid")], {"below": "target"}).select("sid", "source", "source_size", "weight", "target", "ahead", "below")


def streams(rows: DataFrame) -> DataFrame:
    """rows (sid, ahead, size, h, doc_id, ...) with start, the words before a row in its source's shuffled stream."""
    placed = in_order(rows, [F.col("sid"), F.col("h"), F.col("doc_id"), F.col("size")], {"start": "size"})
    return placed.withColumn("start", F.col("start") - F.col("ahead")).drop("place", "h", "ahead")


def golden_point(slot: Column) -> Column:
    """slot * GOLDEN modulo 2^32, in two halves so that nothing overflows."""
    low, high = slot.bitwiseAND(0xFFFF), F.shiftright(slot, 16).bitwiseAND(0xFFFF)
    return (low * GOLDEN + F.shiftleft((high * GOLDEN).bitwiseAND(0xFFFF), 16)).bitwiseAND(ONE - 1)


def schedule(goals: DataFrame, block_words: int) -> DataFrame:
    """(slot, sid, rank) of every slot: whose it is and how many slots that source had before."""
    total = goals.agg(F.sum("target").alias("total"))  # one row
    ends = goals.join(F.broadcast(total), how="cross")
    share = lambda x: F.round(x / F.col("total") * ONE).cast("long")
    ends = ends.withColumns({"lower": share(F.col("below")), "upper": share(F.col("below") + F.col("target"))})
    words = goals.agg(F.sum("target")).first()[0] or 0
    slots = goals.sparkSession.range(int(-(-words // block_words))).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
    # A source's interval is cut at fixed cells of the points, so that a slot looks in one cell only.
    cells = ends.filter("upper > lower").select("sid", "lower", "upper", F.explode(F.sequence(F.shiftright("lower", CELL_BITS), F.shiftright(F.col("upper") - 1, CELL_BITS))).alias("cell"))
    slots = slots.withColumn("cell", F.shiftright("point", CELL_BITS)).join(cells, "cell").filter("lower <= point and point < upper")
    slots = slots.select("slot", "sid")
    ranked = materialize(in_order(slots, [F.col("sid"), F.col("slot")], {}))
    first = ranked.groupBy("sid").agg(F.min("place").alias("first"))
    return ranked.join(first, "sid").select("slot", "sid", (F.col("place") - F.col("first")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, size, source, source_size, target, taken) of every row of docs.

    size counts words; taken those that the mix takes, repeats counted. Each source's sum of
    taken is within a few blocks of its target. A source's blocks are used ``MOST`` times at most,
    slots beyond stay empty. Empty and null texts have size and taken 0; null sources are a source.
    Which words of a document at a block's border are taken depends on the shuffled order alone, so
    reruns agree. Repeated rows are documents of their own. An empty table gives an empty result. Columns of keep may
    have any names; where one clashes with a column of the result, the result's wins.
    """
    h = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    kept = F.struct(*[F.col(k) for k in keep] or [F.lit(1).alias("one")]).alias("kept")
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), h.alias("h"), kept))
    goals = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    named = rows.join(goals.select(F.col("source").alias("s"), "sid", "ahead"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    placed = materialize(streams(named))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")

    # The n-th use of a block is a slot; a block's uses are counted, then joined to the pieces of documents in it.
    taken = schedule(goals, block_words).join(goals.select("sid", blocks.alias("blocks")), "sid").filter(F.col("rank") < MOST * F.col("blocks"))
    uses = taken.groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))
    first, last = (F.col("start") / block_words).cast("long"), ((F.col("start") + F.col("size") - 1) / block_words).cast("long")
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    pieces = pieces.withColumn("words", words).join(uses, ["sid", "block"], "left")
    key = ["sid", "start", "doc_id", "size", "kept"]
    whole = pieces.groupBy(*key).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).alias("taken"))
    whole = whole.unionByName(placed.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken")))
    own = ("doc_id", "size", "source", "source_size", "target", "taken")
    return whole.join(goals.drop("ahead", "below"), "sid").select("doc_id", *[F.col("kept")[k].alias(k) for k in keep if k not in own], *own[1:])


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of docs as often as the mix takes them: whole texts, taken / size times, rounded half up.

    Empty texts hold no words and are not taken. Repeated rows are taken each on its own.
    """
    keys = [unused(docs, "row1"), unused(docs, "row2")]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(k), *docs.columns) for k in keys})
    own = keyed.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])
    found = mix(own, keep=("key0", "key1")).filter("size > 0")
    times = F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).cast("int")
    found = found.select("key0", "key1", times.alias("times"))
    found = found.withColumn("turn0", F.row_number().over(Window.partitionBy("key0", "key1").orderBy(F.desc("times")))).filter("times > 0")
    turn, times = unused(keyed, "turn"), unused(keyed, "times_")
    found = found.toDF(*(f"{c}_of_mix" for c in found.columns))
    rows = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    same = (F.col(keys[0]) == F.col("key0_of_mix")) & (F.col(keys[1]) == F.col("key1_of_mix")) & (F.col(turn) == F.col("turn0_of_mix"))
    joined = rows.join(found, same)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1), F.col("times_of_mix")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op8_mixing": op8_mixing}
SQL: dict[str, str] = {}
