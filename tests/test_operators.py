import pytest
from pyspark.sql import functions as F

from docsync_spark.functions import scalars as S
from docsync_spark.functions import text as T
from docsync_spark.operators import hierarchy, memo, pages, selection, state

LISTING = "id string, name string, parent string, doc_type string, hash string, file_type string, ord long"
FOLDERS = [("f1", " Work ", "", "CollectionType", "", None, 0), ("f2", "Inner", "f1", "CollectionType", "", None, 1), ("f3", "Bin", "trash", "CollectionType", "", None, 2),
           ("x", "X", "y", "CollectionType", "", None, 3), ("y", "Y", "x", "CollectionType", "", None, 4)]


def doc(i, parent="", name=None, hash_="h", file_type=None):
    return (f"d{i}", name if name is not None else f"Doc {i}", parent, "DocumentType", hash_, file_type, 10 + i)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_folders_trash_unknown_parents_and_cycles(spark):
    rows = [*FOLDERS, doc(1, "f2"), doc(2, "f3"), doc(3, "trash"), doc(4, "gone"), doc(5, "x"), doc(6)]
    got = {r["id"]: (r["folder_parts"], r["in_cycle"]) for r in hierarchy.with_folders(spark.createDataFrame(rows, LISTING)).collect()}
    assert got == {"d1": (["Work", "Inner"], False), "d2": (["[TRASH]", "Bin"], False), "d3": (["[TRASH]"], False), "d4": ([], False), "d5": ([], True), "d6": ([], False)}


def test_folders_of_any_depth_and_repeated_ids(spark):
    rows = [(f"f{i}", f"F{i}", f"f{i - 1}" if i else "trash", "CollectionType", "", None, i) for i in range(150)]
    rows += [(f"c{i}", "C", f"c{(i + 1) % 5}", "CollectionType", "", None, i) for i in range(5)] + [("under", "U", "c0", "CollectionType", "", None, 0), ("f3", "Z", "", "CollectionType", "", None, 0)]
    rows += [doc(1, "f149"), doc(2, "under"), doc(3, "f2"), doc(3, "f2"), doc(4, None)]
    got = hierarchy.with_folders(spark.createDataFrame(rows, LISTING)).collect()
    found = {r["id"]: (r["folder_parts"], r["in_cycle"]) for r in got}
    assert len(got) == 5 and found["d1"] == (["[TRASH]", *(f"F{i}" for i in range(150))], False)
    assert found["d2"] == ([], True) and found["d3"] == (["[TRASH]", "F0", "F1", "F2"], False) and found["d4"] == ([], False)
    assert hierarchy.resolve_folders(spark.createDataFrame([], LISTING)).collect() == []


@pytest.fixture(scope="module")
def world(spark):
    rows = [*FOLDERS, doc(1), doc(2, "f3"), doc(3, "f1"), doc(4, file_type="pdf"), doc(5), doc(6), doc(7), doc(8), doc(9, name=" "), doc(10)]
    listing = spark.createDataFrame(rows, LISTING)
    destinations = spark.createDataFrame([("a", True)], "destination string, enabled boolean")
    recipes = spark.createDataFrame([(s, "a", "r1") for s in ("notebook", "pdf")], "source string, destination string, recipe string")
    kind = "doc_id string, destination string, profile string, version string, recipe string, pages_failed int, target string"
    publications = spark.createDataFrame([("d5", "a", "default", "h", "r1", 0, "t"), ("d6", "a", "default", "h", "r0", 0, "t"), ("d7", "a", "default", "h", "r1", 1, "t"), ("d8", "a", "other", "h", "r1", 0, "t"), ("d10", "a", "default", None, "r1", 0, "t")], kind)
    tags = spark.createDataFrame([("d1", ["Red"]), ("d6", ["blue"]), ("d7", None)], "doc_id string, tags array<string>")
    return listing, destinations, publications, recipes, tags


def decide(world, **criteria):
    listing, destinations, publications, recipes, tags = world
    rows = selection.select_documents(listing, selection.Criteria(**criteria), destinations, publications, recipes, tags).collect()
    return {r["doc_id"]: r["decision"] for r in rows}


def test_reasons_in_order(world):
    got = decide(world, excluded=("work",), types=("notebook",), tags=("red",))
    assert got == {"d1": "process", "d2": "trash", "d3": "excluded", "d4": "wrong_type", "d5": "unchanged", "d6": "no_matching_tag", "d7": "process", "d8": "process", "d10": "process"}


def test_target_overrides_filters_and_limit_but_not_trash(world):
    got = decide(world, target="doc", excluded=("work",), types=("epub",), limit=1)
    assert got == {"d2": "trash"} | {f"d{i}": "process" for i in (1, 3, 4, 5, 6, 7, 8, 10)}
    assert decide(world, target="d4")["d1"] == "not_targeted"


def test_limit_in_listing_order_and_force(world):
    got = decide(world, limit=2, force=True)
    assert [d for d, r in got.items() if r == "process"] == ["d1", "d3"] or {d for d, r in got.items() if r == "process"} == {"d1", "d3"}
    assert sum(r == "deferred" for r in got.values()) == 6


def test_no_destination_leaves_all_unchanged(spark, world):
    listing, destinations, publications, recipes, tags = world
    got = selection.select_documents(listing, selection.Criteria(), destinations.limit(0), publications, recipes).collect()
    assert {r["decision"] for r in got} == {"trash", "unchanged"}


def test_path_filters_exclude_each_other():
    with pytest.raises(ValueError):
        S.path_filter(None, "a", "b")


def test_orphans_need_a_listing(spark, world):
    listing, _, publications, _, _ = world
    assert {r["doc_id"] for r in selection.orphans(publications, listing.filter("id <> 'd5'")).collect()} == {"d5"}
    assert selection.orphans(publications, listing.limit(0)).collect() == []


def test_find_documents_prefers_the_id(spark):
    docs = spark.createDataFrame([("n", "x", ""), ("m", "n", ""), ("k", "n", "Top")], "id string, name string, folder string")
    assert [r["id"] for r in selection.find_documents(docs, "n").collect()] == ["n"]
    assert {r["id"] for r in selection.find_documents(docs, "/top/N/").collect()} == {"k"}


def test_upserts_keep_and_fill(spark):
    kind = "doc_id string, destination string, profile string, version string, external_id string, target string, first_published_at int"
    old = spark.createDataFrame([("a", "x", "default", "1", "e", "t", 1), ("b", "x", "default", "1", None, None, 1)], kind)
    new = spark.createDataFrame([("a", "x", "default", "2", None, None, 5), ("c", "x", "default", "1", "n", "m", 7)], kind)
    got = sorted(tuple(r) for r in state.upsert_publications(old, new).collect())
    assert got == [("a", "x", "default", "2", "e", "t", 1), ("b", "x", "default", "1", None, None, 1), ("c", "x", "default", "1", "n", "m", 7)]


def test_pending_and_overview_read_missing_versions_differently(spark):
    docs = spark.createDataFrame([("a", "A", None, None)], "id string, name string, version string, last_error string")
    publications = spark.createDataFrame([("a", "x", "default", None)], "doc_id string, destination string, profile string, version string")
    destinations = spark.createDataFrame([("x", True)], "destination string, enabled boolean")
    assert state.sync_overview(docs, publications, destinations).first()["status"] == "up_to_date"
    assert state.sync_overview(docs, publications.limit(0), destinations).first()["status"] == "up_to_date"


def test_redaction_is_sequential(spark):
    assert value(spark, S.redact(F.lit("key=secretsecret and secretse"), ["secretse", "secretsecret", "short"])) == "key=***redacted*** and ***redacted***"
    assert value(spark, S.redact(F.lit("abcdefghij"), ["redacted", "abcdefghij"])) == "***" + S.MASK + "***"


def test_dates(spark):
    cases = {"1700000000": "2023-11-14", "1700000000000": "2023-11-14", " 2024-02-03T04:05:06Z ": "2024-02-03", "": None, "soon": None, "1e300": None}
    for text, want in cases.items():
        assert value(spark, S.to_iso_date(F.lit(text))) == want, text


def test_tags_and_names(spark):
    assert value(spark, S.normalize_tag(F.lit(" ##Été  à la mer! "))) == "Été-à-la-mer"
    assert value(spark, S.sanitize_filename(F.lit(" -a/b::c- "))) == "a-b-c"
    assert value(spark, selection.extract_tags(F.lit('{"tags":["A b",{"name":"x"}],"pageTags":[{"name":"a-B"},7]}'))) == ["A-b", "x"]
    assert value(spark, selection.extract_tags(F.lit("no json"))) == []


def test_page_lists(spark):
    rows = [(1, '{"pages":["a",{"id":"b","deleted":1},{"id":null},{"id":"c","deleted":{"timestamp":"1","value":0}}]}'), (2, '{"cPages":{"pages":[{"id":"z","deleted":true,"redir":{"value":4}}]},"pages":["no"]}'), (3, "broken"), (4, None), (5, "{}")]
    got = [tuple(r) for r in pages.flatten_page_list(spark.createDataFrame(rows, "doc_id long, content string")).collect()]
    assert sorted(got, key=repr) == [(1, 0, "a", False, None), (1, 1, "b", True, None), (1, 3, "c", False, None), (2, 0, "z", True, 4)]


def test_breadcrumbs_against_a_stack(spark):
    import random

    rng = random.Random(1)
    toc = [(d, i, rng.randint(1, 4), rng.choice(["t1", "t2", "", "t3"]), rng.randint(1, 9)) for d in range(8) for i in range(rng.randint(0, 12))]
    asked = [(d, p) for d in range(9) for p in range(1, 11)]
    got = pages.breadcrumbs(spark.createDataFrame(asked, "doc_id long, page int"), spark.createDataFrame(toc, "doc_id long, ord int, level int, title string, page int")).collect()

    def stack(d, page):
        trail = {}
        for _, _, level, title, p in sorted(x for x in toc if x[0] == d):
            if p > page:
                break
            trail = {k: v for k, v in trail.items() if k < level} | {level: title}
        return [trail[k] for k in sorted(trail) if trail[k]]

    assert {(r["doc_id"], r["page"]): r["breadcrumbs"] for r in got} == {x: stack(*x) for x in asked}


def test_memo_computes_each_content_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, " "), (4, "boom"), (5, "hit"), (6, None)], "id long, text string")
    cache = spark.createDataFrame([("hit",), ("empty",)], "text string").select(S.content_key(F.col("text"), F.lit("f")).alias("key"), F.when(F.col("text") == "hit", "cached").otherwise("").alias("payload"))

    def fn(text):
        if text == "boom":
            raise RuntimeError("said supersecret")
        return text * 2

    def save(new):
        new.write.mode("overwrite").parquet(f"{tmp_path}/new")
        return new.sparkSession.read.parquet(f"{tmp_path}/new")

    got = {r["id"]: (r["result"], r["source"], r["error"]) for r in memo.apply_memoized(docs, F.lit("f"), fn, cache, save, ["supersecret"]).collect()}
    assert got == {1: ("aa", "computed", None), 2: ("aa", "computed", None), 3: ("", "blank", None), 4: ("", "error", "RuntimeError: said ***redacted***"), 5: ("cached", "cache", None), 6: ("", "blank", None)}
    assert spark.read.parquet(f"{tmp_path}/new").count() == 2


def test_front_matter(spark):
    note = "---\nTags:\n  - a\n  - 'b c'\nmine: x\n  more\nsource: docsync/x\n---\n\n\nbody\n---\n"
    split = T.split_frontmatter(F.lit(note))
    assert value(spark, split["body"]) == "body\n---\n"
    assert value(spark, T.frontmatter_list(split["front"], "tags")) == ["a", "b c"]
    assert value(spark, T.foreign_frontmatter(split["front"])) == ["mine: x", "  more"]
    for text in ("--- \nopen", "no fence", "", "---x\n---\n"):
        assert value(spark, T.split_frontmatter(F.lit(text)))["body"] == text


def test_callouts(spark):
    text = "```markdown\nintro\n**Boxed text:**\nline\n\n> kept\n[Margin note]\nside\n### Next\nplain\n```"
    assert value(spark, T.normalize_callouts(F.lit(text))) == "intro\n> [!example] Boxed Passage\n> line\n>\n> kept\n\n> [!note] Margin Note\n> side\n### Next\nplain"
    assert value(spark, T.normalize_callouts(F.lit("  plain > text "))) == "plain > text"


def test_plans_broadcast_configuration_and_use_no_python(world):
    listing, destinations, publications, recipes, _ = world
    matrix = selection.pending_matrix(listing.select(F.col("id").alias("doc_id"), F.col("hash").alias("version"), F.lit("pdf").alias("source")), destinations, publications, recipes)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_one_digit_is_rounded_from_the_exact_value(spark):
    """As printf does it: a size of petabytes that looks like a tie in 17 digits lies above or below of it."""
    sizes = [1023, 1024, 1075, 1076, 1280, 1792, (1 << 20) - 1, 35272419737, 1085 * 2**30 // 100 + 1, (1 << 53) + 1, (1 << 63) - 1] + [(20 * k + 1) * 2**30 // 20 + d for k in range(1000, 90000, 997) for d in (0, 1)]
    sizes += [int((k + d / 20) * 2**30) for k in range(1 << 24, 1 << 32, 1 << 29) for d in range(1, 20, 2)]
    unit = lambda n: f"{n} B" if n < 1024 else next(f"{n / 1024**i:.1f} {u}" for i, u in enumerate(("KB", "MB", "GB"), 1) if u == "GB" or n < 1024 ** (i + 1))
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", S.format_size(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in got} == {n: unit(n) for n in sizes}
    seconds = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.45, 9.949999, 9.95, 9.96, 1e-300]
    got = spark.createDataFrame([(x,) for x in seconds], "n double").select("n", S.humanize_duration(F.col("n")).alias("x")).collect()
    assert {r["n"]: r["x"] for r in got} == {x: f"{x:.1f}s" for x in seconds}


def test_lists_of_pages_are_not_broadcast(spark):
    members = spark.createDataFrame([(1, "a", "a.rm"), (1, "b", "b.rm"), (1, "z", "z.rm")], "doc_id long, page_id string, member string")
    listed = pages.flatten_page_list(spark.createDataFrame([(1, '{"pages":["b","a"]}')], "doc_id long, content string"))
    for made, want in (
        (pages.annotated_pages(listed, members).select("idx", "page_id"), [(0, "b"), (1, "a"), (2, "z")]),
        (pages.ordered_pages(listed, members).select("ordinal", "page_id"), [(0, "b"), (1, "a"), (2, "z")]),
        (pages.pages_per_document(listed, members), [(1, 3)]),
    ):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, made.collect())) == want
