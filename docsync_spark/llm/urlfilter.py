"""URL filters by a temporal list join.

A block list is a log of dated entries: a pattern was added or removed on a day. Per pattern the
entries become validity intervals, from each addition to the next removal. A capture is judged by
the entries that were active when it was fetched: its URL yields candidate patterns (the host and
its parent domains, each alone and with the path's prefixes) of every depth that the list has,
these are joined to the intervals by pattern, and the as-of condition keeps those whose interval holds the fetch time. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.llm.common import let, table


def parts(url: Column) -> Column:
    """(host, path) of a URL in lower case host, without user, port, query and fragment; null where there is no host."""
    rest = F.regexp_replace(F.btrim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), "(:\\d*)?\\.?$", ""))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(host != "", F.struct(host.alias("host"), path.alias("path")))


def patterns(url: Column, depths: Column) -> Column:
    """The patterns that a URL falls under: of its host and each parent domain, alone (0) and with the path's first segments, those of the given depths.

    depths: an array of structs (labels, segments), each depth that a list has entries of.
    """

    def made(p: Column) -> Column:
        labels, segments = F.split(p["host"], "\\."), F.filter(F.split(p["path"], "/"), lambda x: x != "")
        n, m = F.size(labels), F.size(segments)
        own = F.filter(depths, lambda d: (d["labels"] <= n) & (d["segments"] <= m))
        domain = lambda d: F.array_join(F.slice(labels, n - d["labels"] + 1, d["labels"]), ".")
        named = lambda d: F.when(d["segments"] == 0, domain(d)).otherwise(F.concat_ws("/", domain(d), F.array_join(F.slice(segments, F.lit(1), d["segments"]), "/")))
        return F.array_distinct(F.transform(own, named))

    return let(parts(url), lambda p: F.when(p.isNotNull(), made(p)))


def depths(entries: DataFrame) -> DataFrame:
    """One row (depths): the distinct (labels, segments) of the listed patterns."""
    host, path = F.substring_index("pattern", "/", 1), F.split("pattern", "/")
    depth = F.struct(F.size(F.split(host, "\\.")).alias("labels"), (F.size(path) - 1).alias("segments"))
    return entries.filter("pattern is not null").select(depth.alias("d")).distinct().agg(F.collect_list("d").alias("depths"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from (pattern, day, action 'add' or 'remove'); valid_to null while it holds.

    Of entries of one pattern and day, removal counts last; additions of what is listed and
    removals of what isn't change nothing. Entries with nulls or other actions are passed over.
    """
    clean = entries.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = clean.groupBy("pattern", "day").agg(F.max("action").alias("action"))
    own = Window.partitionBy("pattern").orderBy("day")
    changes = daily.filter(F.col("action").isNotNull()).withColumn("before", F.lag("action").over(own)).filter("not (action <=> before)")
    spans = changes.withColumn("valid_to", F.lead("day").over(own))
    return spans.filter("action = 'add'").select("pattern", F.col("day").alias("valid_from"), "valid_to")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, fetched, blocked, n_rules, rule) of every row of captures.

    rule is the longest active pattern, ties to the smaller one. Captures with null or hostless
    URLs or null times are not blocked. Rows are told apart by all three columns; equal rows get
    equal results, each of them. An interval holds from its first day on, without its last.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(time_col).alias("fetched"))
    counted = rows.groupBy("id", "url", "fetched").agg(F.count("*").alias("copies"))
    valid = intervals(entries)
    # A pattern is looked up once for each day, however many captures of a host that day has.
    # Only depths that the list has are looked up: a table of one row, however long the list is.
    asked = counted.select("url", "fetched").distinct().crossJoin(F.broadcast(depths(entries)))
    asked = asked.select("url", "fetched", F.explode(patterns(F.col("url"), F.col("depths"))).alias("pattern"))
    keys = asked.select("pattern", "fetched").distinct()
    active = keys.join(valid, "pattern").filter("valid_from <= fetched and (valid_to is null or fetched < valid_to)").select("pattern", "fetched")
    hits = asked.join(active, ["pattern", "fetched"]).groupBy("url", "fetched").agg(
        F.count("*").alias("n_rules"), F.min(F.struct(-F.length("pattern"), "pattern")).alias("best")
    )
    out = counted.join(hits, ["url", "fetched"], "left")
    out = out.select("id", "fetched", F.col("n_rules").isNotNull().alias("blocked"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.col("best")["pattern"].alias("rule"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return out.drop("copy").withColumnsRenamed({"id": id_col, "fetched": time_col})


def list_of(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts: (pattern, day, action), days from 0 to 999.

    Hosts whose number (from their MD5) is divisible by 5 are added on day number mod 400, removed
    300 days later and, if it is divisible by 10, added again 100 days after that; sections
    (host/language) likewise by 7 and 14.
    """
    host = parts(F.col("url"))
    named = pages.select(host.alias("p")).filter("p is not null").select(F.col("p.host").alias("host"), F.regexp_extract(F.col("p.path"), "^/([^/]+)", 1).alias("first"))
    seen = named.distinct()
    marked = seen.select(F.explode(F.array(F.struct(F.col("host").alias("pattern"), F.lit(5).alias("by")), F.struct(F.concat_ws("/", "host", "first").alias("pattern"), F.lit(7).alias("by")))).alias("x")).select("x.*").distinct()
    listed = marked.withColumn("number", F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 8), 16, 10).cast("long")).filter("number % by = 0")
    day = (F.col("number") % 400).cast("int")
    log = F.array(F.struct(day.alias("day"), F.lit("add").alias("action")), F.struct((day + 300).alias("day"), F.lit("remove").alias("action")), F.when(F.col("number") % (2 * F.col("by")) == 0, F.struct((day + 400).alias("day"), F.lit("add").alias("action"))))
    return listed.select("pattern", F.inline(F.array_compact(log)))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list as it was on the page's day (its id times 37, modulo 1000)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.pmod(F.col("page_id") * 37, F.lit(1000)).cast("int"))
    return url_filter(captures, list_of(pages))


SQL = {
    "op7_url_filters": r"""
WITH p AS (
  SELECT page_id, url, CAST((page_id * 37) % 1000 AS INTEGER) AS fetched,
         lower(regexp_replace(regexp_replace(regexp_extract(r, '^[^/?#]*'), '^.*@', ''), '(:\d*)?\.?$', '')) AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM pages)),
seen AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS first FROM p WHERE host <> ''),
marked AS (SELECT DISTINCT host AS pattern, 5 AS every FROM seen UNION SELECT DISTINCT host || '/' || first, 7 FROM seen),
listed AS (SELECT pattern, every, CAST('0x' || substr(md5(pattern), 1, 8) AS BIGINT) AS number FROM marked),
spans AS (
  SELECT pattern, number % 400 AS valid_from, number % 400 + 300 AS valid_to FROM listed WHERE number % every = 0
  UNION ALL SELECT pattern, number % 400 + 400, NULL FROM listed WHERE number % (2 * every) = 0),
c AS (
  SELECT page_id, url, fetched, unnest(list_distinct(list_concat(
    [array_to_string(l[len(l) - k + 1:], '.') FOR k IN range(1, least(len(l), 6) + 1)], [host],
    [host || '/' || array_to_string(s[:k], '/') FOR k IN range(1, least(len(s), 3) + 1)]))) AS pattern
  FROM (SELECT *, string_split(host, '.') AS l, [x FOR x IN string_split(path, '/') IF x <> ''] AS s FROM p WHERE host <> '')),
h AS (
  SELECT page_id, count(*) AS n, arg_min(pattern, (-length(pattern), pattern)) AS rule
  FROM c JOIN spans USING (pattern) WHERE valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY page_id)
SELECT p.page_id, p.fetched, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_rules, rule
FROM p LEFT JOIN h USING (page_id)
"""
}
QUERIES = {"op7_url_filters": op7_url_filters}
