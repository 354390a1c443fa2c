"""Callouts against a plain walk over the lines."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docsync_spark.functions import text as T

HEADS = [(re.compile(rf"(?:\[\s*{w}.*\]:?|\*{{0,2}}{v}.*)\s*", re.I), h) for w, v, h in (("boxed", "boxed", "> [!example] Boxed Passage"), ("highlight", "highlight", "> [!quote] Highlight"), ("margin", r"margin\s+(?:annotation|note)", "> [!note] Margin Note"))]
LINES = ["[Boxed passage]:", "**Highlight**", "highlighted text", "Margin note: x", "[ margin ]", "margin of error", "[boxed] and more", "plain", "  indented", "", "  ", "> quoted", ">", "> [!tip] own", "---", "### Head", "<span>", "ends with >", "***"]
cases: list[str] = []


def walked(text):
    if not text.strip():
        return text
    s = text.strip()
    if s.startswith("```"):
        s = re.sub(r"^```(?:markdown)?[\r\n]*", "", s)
        s = s[:-3].rstrip() if s.endswith("```") else s
    if not any(re.match(r"\*{0,2}(?:boxed|highlight|margin)", x, re.I) or any(p.fullmatch(x) for p, _ in HEADS) for x in s.split("\n")):
        return s
    out, inside, fresh = [], False, False
    for line in s.split("\n"):
        x = line.strip()
        head = next((h for p, h in HEADS if p.fullmatch(line)), None)
        if head:
            out += ["", head] if inside else [head]
            inside = fresh = True
            continue
        if fresh and not x:
            continue
        fresh = False
        if inside and x.startswith(("---", "<span", "###")):
            inside = False
        out.append(line if not inside or x.startswith(">") else f"> {line}" if x else ">")
    return re.sub(r">\s*\n(?=> \[!)", "\n\n", "\n".join(out)).strip()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(LINES), max_size=12), st.sampled_from(["", "```\n", "```markdown\n"]))
def test_collect(lines, fence):
    cases.append(fence + "\n".join(lines) + ("\n```" if fence else ""))


def test_as_walked(spark):
    texts = [*dict.fromkeys(cases), None, "", "\n" * 20000 + "x", "[boxed]\n" + "\n" * 50000 + "y", "[boxed" * 2000, "[boxed]\n" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", T.normalize_callouts(T.F.col("text")).alias("x")).collect()
    for r in rows:
        want = None if texts[r["i"]] is None else walked(texts[r["i"]])
        assert r["x"] == want, texts[r["i"]][:200]
