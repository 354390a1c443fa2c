from docsync_spark.llm import urlfilter

DEEP = "a.b.c.d.e.f.bad.org"


def test_entries_of_any_depth_block(spark):
    listed = [DEEP, "ok.com/a/b/c/d/e", "ok.com/x"]
    entries = spark.createDataFrame([(p, 0, "add") for p in listed], "pattern string, day int, action string")
    urls = [f"http://z.y.{DEEP}/p", f"http://{DEEP}", "http://b.c.d.e.f.bad.org", "http://ok.com/a/b/c/d/e/f", "http://ok.com/a/b/c/d", "http://www.sub.ok.com/x/1", "http://www.ok.com/a/b/c/d/e", "http://ok.com/xy", "ok.com/x"]
    captures = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, fetched int")
    got = {r["page_id"]: r["rule"] for r in urlfilter.url_filter(captures, entries).collect()}
    assert [got[i] for i in range(len(urls))] == [DEEP, DEEP, None, "ok.com/a/b/c/d/e", None, "ok.com/x", "ok.com/a/b/c/d/e", None, "ok.com/x"]
