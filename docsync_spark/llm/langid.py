"""Language identification by Bayesian evidence fusion.

For each language l the posterior of a document is proportional to

    P(text | l)^TEMPER * P(declared markup language | l) * P(address suffix | l) * P(l | host)

The text's likelihood comes from letter trigrams of its words. The other factors are grouped
aggregations of the soft counts that text alone gives: for each declared language, for each suffix,
and for hosts, whose prior is smoothed towards their domain's and that towards everyone's, so
that a host with few documents says little. A row's own soft count is taken out of its host's and
domain's first. Counts are whole millionths, so results don't depend on the order of rows.

The trigrams are fitted in one task to a bounded sample of labelled rows: an equal share of ``fit_rows`` for
each language that any labelled row has, ``LEAST_ROWS`` at least, those of smallest hash, equal rows once; all else covers all
rows. No language is left out; the model takes 128 KB for each.
"""

from __future__ import annotations

import bisect
import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import materialize, table
from docsync_spark.llm.urlfilter import parts

SLOTS = 1 << 15
KNOWN_WORDS = 1 << 18
TEMPER = 0.3
FLOOR = -40.0
SMOOTHING = 5.0
UNIT = 1_000_000
#: Rows that a language has in the sample at least, if there are so many.
LEAST_ROWS = 40
WORD = re.compile(r"[^\W\d_]+")
#: What hides text: comments, and these elements.
OPENS = re.compile(r"<(?:!--|(script|style|nav|head|template)\b)", re.I)
CLOSES = re.compile(r"</(script|style|nav|head|template)\s*>", re.I)
TAG = re.compile(r"<[^<>]*>")


def shown(page: str) -> str:
    """The page with a blank for each comment and each hidden element, up to the first end that fits; one without an end hides nothing.

    One pass finds all ends, so that a page of a thousand unclosed tags takes no longer than any other.
    """
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in CLOSES.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.span())
    ends["comment"] = [(m.start(), m.end()) for m in re.finditer("-->", page)]
    out, at = [], 0
    while m := OPENS.search(page, at):
        known = ends.get((m[1] or "comment").lower(), [])
        i = bisect.bisect_left(known, (m.end(), 0))
        if i < len(known):
            out += [page[at : m.start()], " "]
            at = known[i][1]
        else:
            out.append(page[at : m.end()])
            at = m.end()
    return "".join([*out, page[at:]])


def page_text(page: str) -> str:
    """What a page shows, without scripts, navigation and tags."""
    plain = TAG.sub(" ", shown(page))
    return html.unescape(re.sub(r"&#([1-9][0-9]{7,});?", "\ufffd", re.sub(r"&#0++(?=[0-9])", "&#", plain)))


def trigrams(word: str) -> list[int]:
    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode("utf-8", "surrogatepass")) % SLOTS for i in range(len(w) - 2)]


def fit(texts: list[str], langs: list[str], languages: list[str]) -> np.ndarray:
    """Log-probabilities of trigrams for each language, SLOTS x languages."""
    place = {x: i for i, x in enumerate(languages)}
    counts = np.full((SLOTS, len(languages)), 0.02)
    for text, lang in zip(texts, langs, strict=True):
        at = [t for w in WORD.findall(text.lower()) for t in trigrams(w)]
        np.add.at(counts[:, place[lang]], at, 1.0)
    return np.log(counts / counts.sum(axis=0))


class Scorer:
    """Tempered log-likelihoods of texts, highest at 0, none below FLOOR."""

    def __init__(self, logs: np.ndarray):
        self.rows = np.zeros((1 << 12, logs.shape[1]))
        outer = self

        class Known(dict):
            def __missing__(self, word: str) -> int:
                i = self[word] = len(self)
                if i >= len(outer.rows):
                    outer.rows = np.concatenate([outer.rows, np.zeros_like(outer.rows)])
                outer.rows[i] = logs[trigrams(word)].sum(axis=0)
                return i

        self.known = Known()

    def score(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        total = np.zeros(self.rows.shape[1])
        for at in range(0, len(words), 1 << 16):
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            places = np.fromiter(map(self.known.__getitem__, words[at : at + (1 << 16)]), np.int64)
            total += np.bincount(places, minlength=1) @ self.rows[: places.max() + 1]
        total *= TEMPER
        return np.maximum(total - total.max(), FLOOR)


def train(labelled: DataFrame, fit_rows: int = 8000, fit_chars: int = 20_000) -> tuple[list[str], np.ndarray]:
    """Languages and their trigrams, from (doc_id, text, lang)."""
    usable = labelled.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= fit_chars))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # a row a language
    share = max(LEAST_ROWS, fit_rows // max(1, len(counts)))
    # a hash leaves about the share of each language, then a sort of these few settles it
    odds = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 1.0 if n <= share else min(1.0, 1.25 * share / n + 64 / n))] or [F.lit(""), F.lit(1.0)])
    row = [F.xxhash64("doc_id", "text"), F.xxhash64("text", "lang", "doc_id")]
    keyed = usable.withColumns({"row1": row[0], "row2": row[1]}).filter(F.pmod("row1", F.lit(1 << 31)) < (1 << 31) * F.element_at(odds, F.col("lang")))
    # equal rows are one, before any are gathered: rows are bounded, not ids
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("row1", "row2"))
    picked = keyed.select("lang", "row1", "row2").distinct().withColumn("turn", turn).filter(F.col("turn") <= share).drop("turn")
    sample = keyed.join(picked, ["lang", "row1", "row2"]).groupBy("lang", "row1", "row2").agg(F.min("text").alias("text")).select("text", "lang")

    def learn(batches):
        frames = [b for b in batches if len(b)]
        if frames:
            rows = pd.concat(frames).sort_values(["lang", "text"], kind="stable")
            languages = sorted(rows["lang"].unique().tolist())
            yield pd.DataFrame({"languages": [languages], "logs": [fit(rows["text"].tolist(), rows["lang"].tolist(), languages).ravel()]})

    model = sample.repartition(1).mapInPandas(learn, "languages array<string>, logs array<float>").first()
    if model is None:
        return ["und"], np.zeros((SLOTS, 1))
    return list(model["languages"]), np.array(model["logs"]).reshape(SLOTS, -1)


def evidence(rows: DataFrame, keep: list[str], languages: list[str], logs: np.ndarray) -> DataFrame:
    """(*keep, host, domain, suffix, declared, like array<double>, p array<long>) from keep, text, html, host and suffix."""
    sent = rows.sparkSession.sparkContext.broadcast(logs)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", like array<double>, p array<long>"

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in batches:
            like = [scorer.score(t if isinstance(t, str) else page_text(h) if isinstance(h, str) else "") for t, h in zip(batch["text"], batch["html"], strict=True)]
            p = [np.rint(np.exp(x) / np.exp(x).sum() * UNIT).astype(np.int64) for x in like]
            yield batch[keep].assign(like=like, p=p)

    return rows.mapInPandas(run, schema)


def identify(rows: DataFrame, labelled: DataFrame, keep: tuple[str, ...], **limits) -> DataFrame:
    """(*keep, lang, score) of every row of rows (text, html, url, host, *keep).

    A row has a text, or html whose visible text counts. host and suffix come from the URL; where that
    is null, the column host is taken as it is and no suffix speaks. Null evidence says nothing; with
    none at all the most frequent language wins. Ties go to the smaller language code. score
    is the posterior. Without labelled rows the language is 'und'. Repeated rows come back as often as they
    came and count as often in their host's prior; an empty table gives an empty result. Columns of rows
    other than these are not looked at, whatever their names.
    """
    languages, logs = train(labelled, **limits)
    n = len(languages)
    address = parts(F.col("url"))
    host = F.coalesce(address["host"], F.col("host").cast("string"))
    # the tag first, up to the next bracket, so that a page of unclosed tags is read once
    declared = F.lower(F.regexp_extract(F.regexp_extract(F.col("html"), "(?i)<html(?![a-z0-9])[^<>]*+", 0), "(?i)\\blang\\s*+=\\s*+[\"']?([a-z]{2,3})", 1))
    named = rows.select(
        F.struct(*keep).alias("keep"), "text", "html", host.alias("host"),
        F.coalesce(F.regexp_extract(address["host"], "[^.]+\\.[^.]+$", 0), host).alias("domain"),
        F.regexp_extract(address["host"], "[^.]+$", 0).alias("suffix"), F.when(declared.isin(languages), declared).otherwise(F.when(declared != "", F.lit("other"))).alias("declared"),
    )
    scored = materialize(evidence(named, ["keep", "host", "domain", "suffix", "declared"], languages, logs))

    total = F.array(*[F.sum(F.col("p")[i]) for i in range(n)])
    hosts = materialize(scored.groupBy("host", "domain").agg(total.alias("host_n")))
    again = F.array(*[F.sum(F.col("host_n")[i]) for i in range(n)])
    domains = hosts.groupBy("domain").agg(again.alias("domain_n"))
    everyone = hosts.agg(again.alias("all_n"))  # one row
    by_host = materialize(hosts.join(domains, F.col("host").isNotNull() & (hosts["domain"] == domains["domain"]), "left").select("host", "host_n", "domain_n"))
    suffixes = materialize(scored.filter("suffix is not null").groupBy("suffix").agg(total.alias("suffix_n")))
    markups = scored.filter("declared is not null").groupBy("declared").agg(total.alias("declared_n"))  # a row a language

    joined = scored.join(by_host.filter("host is not null"), "host", "left").join(suffixes, "suffix", "left").join(markups, "declared", "left").crossJoin(F.broadcast(everyone))
    kappa = SMOOTHING * UNIT
    zero = F.array(*[F.lit(0).cast("long")] * n)
    counts = lambda c: F.coalesce(c, zero)
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    own = lambda c: F.transform(F.arrays_zip(counts(F.col(c)).alias("n"), F.col("p").alias("p")), lambda x: F.greatest(x["n"] - x["p"], F.lit(0)).cast("long"))
    smooth = lambda c, below: F.zip_with(c, below, lambda a, b: (a + kappa * b) / (whole(c) + kappa))

    def given(c: str) -> Column:
        """Log of P(this value | l), up to a factor, from soft counts of the value and of all rows."""
        rate = F.zip_with(counts(F.col(c)), F.col("all_n"), lambda a, b: F.log((a + UNIT * F.lit(0.5)) / (b + UNIT * F.lit(1.0))))
        return F.when(F.col(c).isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(rate)

    base = joined.withColumn("overall", F.transform("all_n", lambda x: (x + kappa / n) / (whole(F.col("all_n")) + kappa)))
    base = base.withColumns({"h": own("host_n"), "d": own("domain_n")}).withColumn("at_domain", smooth(F.col("d"), F.col("overall")))
    base = base.withColumn("prior", smooth(F.col("h"), F.col("at_domain"))).withColumns({"by_markup": given("declared_n"), "by_suffix": given("suffix_n")})
    logs_of = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("like", i) + F.get("by_markup", i) + F.get("by_suffix", i) + F.log(F.get("prior", i)))
    base = base.withColumn("z", logs_of).withColumn("most", F.array_max("z"))
    base = base.withColumn("score", 1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most"))))
    lang = F.element_at(F.array(*map(F.lit, languages)), F.array_position("z", F.col("most")).cast("int"))
    return base.select("keep.*", lang.alias("lang"), F.round("score", 6).alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, and of every document with its source as host; one of doc_id and page_id is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = lambda kind: F.lit(None).cast(kind)
    rows = docs.select("doc_id", none("long").alias("page_id"), "text", none("string").alias("html"), none("string").alias("url"), F.col("source").alias("host"))
    rows = rows.union(pages.select(none("long"), "page_id", none("string"), "html", "url", none("string")))
    return identify(rows, docs.select("doc_id", "text", "lang"), ("doc_id", "page_id"))


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
