import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from docsync_spark.operators import notes

LINES = st.sampled_from(["# Title", "text", "more text", "", "- item", "  - inner", "    - deep", "- [ ] todo", "- [x] done", "1. one", "3) three", "> quote", "> [!note] Call", "> - in it", "```", "```py", "$$", "---", "| a | b |", "***", "  > odd"])


def written(rows, depth=0, owner=None):
    """What render_blocks does, in plain Python."""
    marks = {"heading": lambda r: "#" * r[3] + " " + r[2], "divider": lambda r: "---", "math": lambda r: f"$$\n{r[2]}\n$$"}
    out, last = [], None
    for r in (r for r in rows if r[5] == owner):
        pos, kind, text, level, _, _, _, attrs = r
        if kind in ("list", "task_list"):
            mark = f"{attrs['number']}." if attrs.get("ordered") == "true" else "-" if kind == "list" else f"- [{'x' if attrs['checked'] == 'true' else ' '}]"
            shown, tight = "  " * level + f"{mark} {text}", kind + attrs.get("ordered", "false")
        else:
            tight = None
            if kind == "quote":
                shown = "\n".join(f"> {x}" for x in text.split("\n"))
            elif kind == "code":
                shown = f"```{attrs['language']}\n{text}\n```"
            elif kind == "callout":
                inner = written(rows, depth + 1, pos)
                shown = f"> [!{attrs['callout_type']}]" + (f" {text}" if text else "") + "\n" + "\n".join(f"> {x}" if x else ">" for x in inner.split("\n"))
            else:
                shown = marks.get(kind, lambda r: r[2])(r)
        if shown.strip():
            out.append(("\n" if tight and tight == last else "\n\n") + shown if out else shown)
            last = tight
    return "".join(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(LINES, max_size=14))
def test_blocks_written_and_read_again_stay(lines):
    once = notes.blocks_of("\n".join(lines))
    twice = notes.blocks_of(written(once))
    assert [r[1:4] for r in notes.blocks_of(written(twice))] == [r[1:4] for r in twice]


def test_blocks_of_each_kind():
    text = "# H\npara\nline\n\n- a\n  - b\n1. c\n- [x] t\n> q\n> r\n\n> [!Tip] T\n> in\n\n```py\ncode\n```\n$$\nx\n$$\n---\n| a |\n| b |\n```\nopen"
    rows = notes.blocks_of(text)
    assert [(r[1], r[2]) for r in rows] == [("heading", "H"), ("paragraph", "para\nline"), ("list", "a"), ("list", "b"), ("list", "c"), ("task_list", "t"), ("quote", "q\nr"), ("callout", "T"), ("paragraph", "in"), ("code", "code"), ("math", "x"), ("divider", ""), ("table", "| a |\n| b |"), ("code", "open")]
    assert rows[3][4] == 2 and rows[8][5] == 7 and rows[7][7] == {"callout_type": "tip"}


def test_render_blocks_as_plain_python(spark):
    texts = [(1, "# H\npara\n\n- a\n  - b\n- [x] t\n> q\n\n> [!tip] T\n> in\n> > [!note]\n> > deep\n\n---"), (2, ""), (3, "1. a\n2. b\n\n- c")]
    blocks = notes.extract_blocks(spark.createDataFrame([*texts, (4, None)], "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in notes.render_blocks(blocks).collect()}
    assert got == {i: written(notes.blocks_of(t)) for i, t in texts if t}


def parts(text):
    return notes.segments_of(text)


def block(name, text, digest=True):
    return f"<!-- docsync:begin {name}{' h=' + notes.digest(text) if digest else ''} -->\n{text}\n<!-- docsync:end {name} -->"


def test_segments():
    text = "mine\n" + block("page-1", "one") + "\nyours\n<!-- docsync:begin page-2 -->\nnever closed"
    assert parts(text) == [("mine" and None, "mine", None), ("page-1", "one", notes.digest("one")), (None, "yours\n<!-- docsync:begin page-2 -->\nnever closed", None)]


def test_merge_keeps_edits_and_words_between():
    have = parts("top\n" + block("page-1", "one") + "\nabout one\n" + block("page-2", "two").replace("two\n", "two, edited\n") + "\n" + block("page-9", "nine"))
    out, warnings = notes.merged(have, [("page-1", "one!"), ("page-1b", "new"), ("page-2", "two!")])
    assert [b for b, _, _ in out] == [None, "page-1", None, "page-1b", "page-2", None, "page-9"]
    assert "two, edited" in out[5][1] and out[4][1] == "two!" and len(warnings) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "d"]), unique=True), st.lists(st.sampled_from(["a", "b", "c", "e"]), unique=True), st.booleans())
def test_merge_twice_is_merge_once(have, want, edited):
    segments = [(b, f"old {b}", notes.digest("else" if edited else f"old {b}")) for b in have]
    generated = [(b, f"new {b}") for b in want]
    once, _ = notes.merged(segments, generated)
    assert notes.merged(once, generated)[0] == once
    assert {b for b, _, _ in once if b} == set(have) | set(want)


def test_merge_tables_and_diff(spark):
    note = "x\n" + block("p", "same") + "\n" + block("q", "old") + "\n" + block("p", "copy")
    segments = notes.parse_segments(spark.createDataFrame([(1, note), (2, None)], "note_id long, body string"))
    fresh = spark.createDataFrame([(1, 0, "p", "same"), (1, 1, "q", "new"), (3, 0, "z", "only")], "note_id long, pos int, block_id string, content string")
    states = {(r["note_id"], r["block_id"], r["state"]) for r in notes.block_diff(segments, fresh).collect()}
    assert states == {(1, "p", "same"), (1, "p", "duplicate"), (1, "q", "replaced"), (3, "z", "new")}
    out = notes.merge_notes(segments, fresh).collect()
    assert sorted((r["note_id"], r["pos"], r["block_id"], r["content"]) for r in out if r["block_id"])[-1] == (3, 0, "z", "only")


def test_claims(spark):
    docs = spark.createDataFrame([("d1", "x", "A:", 1), ("d2", "x", "A?", 2), ("d3", "x", "A", 3), ("d4", "y", "A", 4)], "doc_id string, dir string, base string, ord long")
    held = spark.createDataFrame([("x", "A", "d3", True), ("x", "A (2)", None, False)], "dir string, name string, owner string, readable boolean")
    got = {r["doc_id"]: r["name"] for r in notes.claim_names(docs, held).collect()}
    assert got == {"d1": "A (3)", "d2": "A (4)", "d3": "A", "d4": "A"}
    assert isinstance(pd.DataFrame(), pd.DataFrame)


def in_turn(docs, held, most=99, sentinel=None):
    """Names one after another; docs: (doc_id, dir, base, ord), held: (dir, name, owner, readable)."""
    taken = {(d, n): (o, r) for d, n, o, r in held}
    out = {}
    for doc, where, base, _ in sorted(docs, key=lambda d: (d[3], d[0])):
        base = f"{base} (2)" if base == sentinel else base
        for name in [base, *(f"{base} ({i})" for i in range(2, most + 1))]:
            owner, readable = taken.get((where, name), (None, True))
            if readable and owner in (None, doc):
                break
        else:
            name = f"{base} ({most + 1})"
        taken[where, name] = (doc, True)
        out[doc] = name
    return out


def named(spark, docs, held, **more):
    docs = spark.createDataFrame(docs, "doc_id string, dir string, base string, ord long")
    held = spark.createDataFrame(held, "dir string, name string, owner string, readable boolean")
    got = notes.claim_names(docs, held, **more).collect()
    assert len(got) == docs.count()
    return {r["doc_id"]: r["name"] for r in got}, {r["doc_id"]: r["warnings"] for r in got}


def test_counted_names_do_not_clash(spark):
    docs = [("a", "d", "x", 1), ("b", "d", "x", 2), ("c", "d", "x (2)", 3), ("e", "d", "y (2)", 4), ("f", "d", "Sync failed", 5), ("g", "e", "z", 6)]
    held = [("d", "y (2)", "other", True), ("e", "z", None, False)]
    got, warnings = named(spark, docs, held, sentinel="Sync failed")
    assert got == {"a": "x", "b": "x (2)", "c": "x (2) (2)", "e": "y (2) (2)", "f": "Sync failed (2)", "g": "z (2)"} == in_turn(docs, held, sentinel="Sync failed")
    assert len(warnings["g"]) == 1 and not warnings["a"]


def test_names_as_if_given_one_after_another(spark):
    rng = random.Random(7)
    for most in (3, 99):
        bases = ["x", "x (2)", "x (3)", "x (2) (2)", "y", "y (9)"]
        docs = [(f"d{i}", rng.choice("pq"), rng.choice(bases) if rng.random() < 0.8 else f"own {i} ({i})", i) for i in range(120)]
        held = {(rng.choice("pq"), rng.choice([*bases, "x (4)", "y (2)"])): (rng.choice([None, "other", f"d{rng.randrange(120)}"]), rng.random() < 0.8) for _ in range(14)}
        held = [(d, n, o if r else None, r) for (d, n), (o, r) in held.items()]
        got, warnings = named(spark, docs, held, most=most)
        assert got == in_turn(docs, held, most)
        assert all(len(warnings[d]) > 0 for d, n in got.items() if n.endswith(f"({most + 1})") and not n.startswith("own"))


def test_callouts_of_any_depth_are_written(spark):
    text = "\n".join("> " * i + f"[!note] level {i}" for i in range(1, 8)) + "\n" + "> " * 7 + "at the bottom"
    blocks = notes.extract_blocks(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in notes.render_blocks(blocks).collect()}
    assert got == {1: written(notes.blocks_of(text)), 2: "plain"} and "at the bottom" in got[1]


def test_notes_are_merged_into_what_is_there(spark):
    docs = spark.createDataFrame([("1", "T", ["a"], None), ("2", "U", [], "body text"), ("3", "V", None, " ")], "doc_id string, title string, tags array<string>, body_text string")
    pages = spark.createDataFrame([("1", 0, "one", None, "p1.png"), ("1", 1, "", "HTTP 429", None), ("9", 0, "no such document", None, None)], "doc_id string, idx int, text string, error string, image string")
    first = {r["doc_id"]: r["note"] for r in notes.build_notes(docs, pages, "2024-01-01").collect()}
    assert set(first) == {"1", "2", "3"} and "![[p1.png]]" in first["1"] and "begin body" in first["2"] and first["3"].endswith("---\n")
    edited = first["1"].replace("\none\n", "\none, by hand\n").replace("---\n<!--", "mood: good\n---\nmy words\n<!--", 1)
    old = spark.createDataFrame([("1", edited), ("2", "somebody's own\n"), ("3", None)], "doc_id string, text string")
    made = {r["doc_id"]: (r["note"], r["warnings"]) for r in notes.build_notes(docs, pages, "2024-02-02", old).collect()}
    note, warnings = made["1"]
    assert "mood: good" in note and "my words" in note and "one, by hand" in note and "created: 2024-01-01" in note and "synced: 2024-02-02" in note and len(warnings) == 1
    assert made["2"][0].index("somebody's own") < made["2"][0].index("body text") and made["3"][0].endswith("---\n")
    again = spark.createDataFrame([(d, n) for d, (n, _) in made.items()], "doc_id string, text string")
    third = {r["doc_id"]: (r["note"], r["warnings"]) for r in notes.build_notes(docs, pages, "2024-02-02", again).collect()}
    assert {d: n for d, (n, _) in third.items()} == {d: n for d, (n, _) in made.items()} and not any(w for _, w in third.values())


def test_callouts_three_hundred_deep_are_written_at_once(spark):
    deep = "\n".join("> " * i + f"> [!note] level {i}" for i in range(300)) + "\n" + "> " * 300 + "bottom\n" + "> " * 299 + ">\n" + "> " * 299 + "> up again\n\nend"
    pages = spark.createDataFrame([(1, deep), (None, "> [!tip] alone"), (3, "\n")], "doc_id int, text string")
    once = notes.render_blocks(notes.extract_blocks(pages))
    got = {r["doc_id"]: r["text"] for r in once.collect()}
    assert got[1].startswith("> [!note] level 0\n> > [!note] level 1\n") and got[1].endswith("\n\nend") and "> " * 300 + "bottom" in got[1]
    assert got[None] == "> [!tip] alone\n>"
    again = {r["doc_id"]: r["text"] for r in notes.render_blocks(notes.extract_blocks(once)).collect()}
    assert again == got
