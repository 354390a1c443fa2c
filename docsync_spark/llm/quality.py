"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets integer measures. Their distribution is kept per language and source, per
language, and over all, as a sketch: counts of logarithmic buckets, 32 for each power of two, so that
a quantile is right to one part in 32. Sketches merge by adding counts, which is what the
partial aggregation does; a third of all documents in one source is a few hundred rows from each
task. A group's thresholds are its quartiles widened by a multiple of their distance; a group with
too few documents takes its language's, or else everyone's. Documents outside are rejected.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import BLANK, let, materialize, table, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Measures in thousandths of words or characters, with the least distance from the quartiles that counts as outside.
MEASURES = {"symbols": 100, "dup_lines": 300, "repeats": 300, "word_length": 2500}
WIDTH = 3
LEAST_GROUP = 100
#: Measures that can also be too small.
BOTH_SIDES = ("word_length",)


def _repeated(ws: Column) -> Column:
    """How many words stand in windows of WINDOW words that the text holds twice or more.

    Windows are compared by 64-bit hashes; texts without equal ones, most, end there.
    """
    last = F.size(ws) - WINDOW

    def counted(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            n = F.size(p)
            same = lambda x, i, d: F.coalesce(F.get(p, i + d)["h"] == x["h"], F.lit(False))
            kept = F.filter(F.transform(p, lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["i"])), lambda x: x.isNotNull())
            return F.when(n > 0, F.array_sort(kept))

        covered = lambda at: F.aggregate(
            at,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )
        return let(placed, lambda p: let(positions(p), covered))

    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(ws, i + 1, WINDOW)))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted(h)))
    return F.when(last < 1, F.lit(0)).otherwise(some).cast("long")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def line_counts(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    own = let(words(text), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), _repeated(ws).alias("n_repeat_words")))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rest = docs.drop(*names, "__own")
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")
    out = rest.withColumns({"__own": own, "n_symbols": symbols, "n_dup_lines": let(lines, line_counts)})
    out = out.withColumns({x: F.col("__own")[x] for x in ("n_words", "word_chars", "n_repeat_words")})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__own")


def bucket(v: Column) -> Column:
    """The sketch's bucket of a whole number from 0 on: exact below 64, then 32 to a power of two."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (64 * shift + F.call_function("shiftright", v, shift)).cast("long")


def lowest(b: Column) -> Column:
    """The least number of a bucket."""
    shift = F.greatest(F.floor((b - 32) / 64), F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - 64 * shift, shift).cast("long")


def _sketches(long: DataFrame) -> DataFrame:
    """(level, lang, source, measure, bucket, n): level 0 by language and source, 1 by language, 2 over all."""
    fine = long.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    level = lambda i, lang, source: fine.select(F.lit(i).alias("level"), lang.alias("lang"), source.alias("source"), "measure", "bucket", "n")
    none = F.lit(None).cast("string")
    merged = level(0, F.col("lang"), F.col("source")).union(level(1, F.col("lang"), none)).union(level(2, none, none))
    return merged.groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketches: DataFrame, width: float = WIDTH) -> DataFrame:
    """(level, lang, source, measure, docs, low, high) of each sketch: the quartiles' buckets widened."""
    own = Window.partitionBy("level", "lang", "source", "measure")
    below = F.sum("n").over(own.orderBy("bucket"))
    ranked = sketches.withColumns({"upto": below, "docs": F.sum("n").over(own)})
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bucket")))
    found = ranked.groupBy("level", "lang", "source", "measure").agg(F.max("docs").alias("docs"), lowest(quartile(1)).alias("q1"), lowest(quartile(3)).alias("q3"))
    least = F.create_map(*[F.lit(x) for kv in MEASURES.items() for x in kv])[F.col("measure")]
    reach = F.greatest(width * (F.col("q3") - F.col("q1")), least)
    return found.select("level", "lang", "source", "measure", "docs", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """The columns keep of docs with the base measures, base_failed, kept and failed, the measures outside their thresholds.

    Thresholds come from documents that pass the base rules; with none, only the base rules hold.
    kept is false for base_failed. Null languages and sources are groups of their own. Null and
    empty texts have zero words and fail. There is one result row for each row of docs.
    """
    base = measured(docs.select(F.struct(*keep).alias("__keep"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source")))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1
    scaled = {
        "symbols": F.col("n_symbols") * 1000 / chars, "dup_lines": F.col("n_dup_lines") * 1000 / F.coalesce(lines, F.lit(1)),
        "repeats": F.col("n_repeat_words") * 1000 / n, "word_length": F.col("word_chars") * 1000 / n,
    }
    rows = materialize(base.withColumns({f"__{m}": F.floor(x).cast("long") for m, x in scaled.items()}).drop("text"))

    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(f"__{m}")).alias("bucket")) for m in MEASURES])
    limits = materialize(thresholds(_sketches(rows.filter(~F.col("base_failed")).select(F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.inline(pairs)))))
    ends = [(F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}")) for m in MEASURES for e in ("low", "high")]
    names = F.struct(*[f"{m}_{e}" for m in MEASURES for e in ("low", "high")])
    enough = limits.filter(F.col("docs") >= least_group)
    fine = enough.filter("level = 0").groupBy("lang", "source").agg(*ends).select(F.col("lang").alias("l0"), F.col("source").alias("s0"), names.alias("t0"))
    lang = enough.filter("level = 1").groupBy("lang").agg(*ends).select(F.col("lang").alias("l1"), names.alias("t1"))
    whole = limits.filter("level = 2").agg(*ends).select(names.alias("t2"))  # one row
    joined = rows.join(fine, F.col("__lang").eqNullSafe(F.col("l0")) & F.col("__source").eqNullSafe(F.col("s0")), "left")
    joined = joined.join(lang, F.col("__lang").eqNullSafe(F.col("l1")), "left").crossJoin(F.broadcast(whole)).withColumn("__t", F.coalesce("t0", "t1", "t2"))
    seen = {m: lowest(bucket(F.col(f"__{m}"))) for m in MEASURES}
    outside = [F.when((seen[m] > F.col("__t")[f"{m}_high"]) | ((seen[m] < F.col("__t")[f"{m}_low"]) if m in BOTH_SIDES else F.lit(False)), F.lit(m)) for m in MEASURES]
    verdict = joined.withColumn("failed", F.array_compact(F.array(*outside)))
    return verdict.select("__keep.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), "failed")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality(table(spark, sf_dir, "documents")).drop("failed")


_SCALED = {"symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "dup_lines": "n_dup_lines * 1000 // n_lines", "repeats": "n_repeat_words * 1000 // greatest(n_words, 1)", "word_length": "word_chars * 1000 // greatest(n_words, 1)"}
_OUTSIDE = " AND ".join(
    f"NOT max(CASE WHEN measure = '{m}' THEN coalesce(x > coalesce(h0, h1, h2)" + (" OR x < coalesce(b0, b1, b2)" if m in BOTH_SIDES else "") + ", false) ELSE false END)" for m in MEASURES
)
SQL = {
    "op6_quality_rules": r"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(string_split(text, chr(10))) AS n_lines
  FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
"""
    + "l AS ("
    + " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {x} AS v, {MEASURES[m]} AS least FROM b" for m, x in _SCALED.items())
    + """),
s AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS sh FROM l),
k AS (SELECT *, (v >> sh) << sh AS x FROM s),
lim AS (
  SELECT g, lang, source, measure, count(*) AS docs, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3, max(least) AS least
  FROM (SELECT 0 AS g, lang, source, measure, x, least FROM k WHERE NOT base_failed
        UNION ALL SELECT 1, lang, NULL, measure, x, least FROM k WHERE NOT base_failed
        UNION ALL SELECT 2, NULL, NULL, measure, x, least FROM k WHERE NOT base_failed)
  GROUP BY g, lang, source, measure),
e AS (SELECT *, q1 - greatest(3 * (q3 - q1), least) AS lo, q3 + greatest(3 * (q3 - q1), least) AS hi FROM lim),
v AS (
  SELECT k.*, a.lo AS b0, a.hi AS h0, c.lo AS b1, c.hi AS h1, z.lo AS b2, z.hi AS h2
  FROM k
  LEFT JOIN e a ON a.g = 0 AND a.docs >= 100 AND a.measure = k.measure AND a.lang IS NOT DISTINCT FROM k.lang AND a.source IS NOT DISTINCT FROM k.source
  LEFT JOIN e c ON c.g = 1 AND c.docs >= 100 AND c.measure = k.measure AND c.lang IS NOT DISTINCT FROM k.lang
  LEFT JOIN e z ON z.g = 2 AND z.measure = k.measure),
o AS (SELECT doc_id, """
    + _OUTSIDE
    + """ AS fine FROM v GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept
FROM b JOIN o USING (doc_id)
""",
}
QUERIES = {"op6_quality_rules": op6_quality_rules}
