from pyspark.sql import functions as F

from docsync_spark.llm import urlfilter

ENTRIES = [
    ("bad.org", 10, "add"), ("bad.org", 20, "remove"), ("bad.org", 30, "add"), ("bad.org", 31, "add"), ("a.bad.org", 5, "remove"), ("a.bad.org", 12, "add"),
    ("ok.com/x", 0, "add"), ("ok.com/x", 0, "remove"), ("ok.com/y/z", 1, "add"), ("com", 100, "add"), (None, 1, "add"), ("n", None, "add"), ("n", 1, None), ("n", 1, "other"),
]
URLS = [None, "", "://", "http://BAD.org", "https://user@a.bad.org:80/p?q#f", "bad.org/", "http://ok.com/x/1", "http://ok.com/y/z/w", "http://ok.com/y", "http://notbad.org", "http://bad.org./", "http://[::1]/", "x" * 5000, "http://" + "s." * 50 + "bad.org/" + "d/" * 500]


def brute(url, day):
    spans = {"bad.org": [(10, 20), (30, 10**9)], "a.bad.org": [(12, 10**9)], "ok.com/y/z": [(1, 10**9)], "com": [(100, 10**9)]}
    if url is None or day is None:
        return False, 0, None
    rest = url.split("://", 1)[-1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].lower()
    host = host.rsplit(":", 1)[0] if host.rpartition(":")[2].isdigit() else host
    host = host.removesuffix(".")
    path = [p for p in rest.partition("/")[2].split("?")[0].split("#")[0].split("/") if p]
    labels = host.split(".")
    found = {".".join(labels[-k:]) for k in range(1, min(6, len(labels)) + 1)} | {host} | {"/".join([host, *path[:k]]) for k in range(1, min(3, len(path)) + 1)}
    hit = sorted((-len(p), p) for p in found if any(a <= day < b for a, b in spans.get(p, [])))
    return bool(hit), len(hit), hit[0][1] if hit else None


def test_matches_brute_force(spark):
    rows = [(i, u, d) for i, u in enumerate(URLS) for d in (None, 0, 9, 10, 19, 20, 29, 30, 99, 100)]
    rows += [rows[15], rows[15], (None, "http://bad.org", 10)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched int").withColumns({"pattern": F.lit("x"), "copies": F.lit(1), "id": F.lit(2)})
    got = urlfilter.url_filter(captures, spark.createDataFrame(ENTRIES, "pattern string, day int, action string")).collect()
    want = [(i, d, *brute(u, d)) for i, u, d in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_intervals(spark):
    got = urlfilter.intervals(spark.createDataFrame(ENTRIES, "pattern string, day int, action string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("bad.org", 10, 20), ("bad.org", 30, None), ("a.bad.org", 12, None), ("ok.com/y/z", 1, None), ("com", 100, None)], key=repr)


def test_empty_tables_and_plan(spark):
    captures = spark.createDataFrame([(1, "http://a.b", 3)], "page_id long, url string, fetched int")
    none = spark.createDataFrame([], "pattern string, day int, action string")
    out = urlfilter.url_filter(captures, none)
    assert [tuple(r) for r in out.collect()] == [(1, 3, False, 0, None)]
    assert urlfilter.url_filter(captures.limit(0), none).collect() == []
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
