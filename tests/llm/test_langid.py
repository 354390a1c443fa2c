import random

from pyspark.sql import functions as F

from docsync_spark.llm import langid

SYLLABLES = {"xa": ["kor", "tum", "bal", "dro"], "yb": ["lei", "mia", "seo", "nua"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def tables(spark):
    rng = random.Random(4)
    labelled = [(i, text(rng, lang, 40), lang) for i in range(60) for lang in [("xa", "yb")[i % 2]]]
    labelled += [(None, "x", "xa"), (70, None, "xa"), (71, "y", None)]
    pages = []
    for i in range(120):
        lang = ("xa", "yb")[i % 3 == 0]
        page = f'<html lang="{lang}"><script>{text(rng, "yb", 30)}</script><body><p>{text(rng, lang, 12)}</p></body></html>'
        pages.append((i, None, page, f"http://www.site{i % 3}.{lang}z/{i}", None))
    return labelled, pages


def run(spark, labelled, rows):
    kind = "page_id long, text string, html string, url string, host string"
    docs = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    frame = spark.createDataFrame(rows, kind).withColumns({"p": F.lit(1), "like": F.lit("x"), "all_n": F.lit(2), "suffix": F.lit(3)})
    return [tuple(r) for r in langid.identify(frame, docs, ("page_id",)).collect()]


def test_accuracy_and_weak_texts_follow_other_evidence(spark):
    labelled, pages = tables(spark)
    odd = [
        (1000, None, "<html lang=xa><p>123</p></html>", "http://new.example", None), (1001, None, "<html lang='yb'></html>", None, None), (1002, "", None, "http://www.site0.ybz/1", None),
        (1003, None, None, None, None), (None, "kor tum bal", None, None, "h"), (1004, "kortum " * 50000, None, None, None), (1005, "lei mia seo nua", "<html lang=zz>", "notaurl", "x"),
    ]
    got = {r[0]: r for r in run(spark, labelled, pages + odd + [pages[0]])}
    assert all(got[i][1] == ("xa", "yb")[i % 3 == 0] for i in range(120))
    assert got[1000][1] == "xa" and got[1001][1] == "yb" and got[1002][1] == "yb"
    assert got[None][1] == "xa" and got[1004][1] == "xa" and got[1005][1] == "yb"
    assert all(0 < r[2] <= 1 for r in got.values()) and len(got) == 127


def test_host_prior_is_smoothed(spark):
    labelled, pages = tables(spark)
    same = [(i, text(random.Random(i), "yb", 10), None, None, "big") for i in range(200, 240)]
    got = {r[0]: r for r in run(spark, labelled, pages + same + [(300, "", None, None, "big"), (301, "", None, None, "unseen")])}
    assert got[300][1] == "yb" and got[300][2] > 0.8
    assert got[301][2] < got[300][2]


def test_empty_tables(spark):
    labelled, pages = tables(spark)
    assert run(spark, labelled, []) == []
    assert {r[1] for r in run(spark, [], pages[:5])} == {"und"}


def test_page_text():
    assert langid.page_text("<p>a&amp;b<!-- c --><SCRIPT>x</script ><b>d").split() == ["a&b", "d"]
