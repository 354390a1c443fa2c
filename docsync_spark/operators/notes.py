"""Notes: blocks, segments, merging into what people have edited, names, moves and removals."""

from __future__ import annotations

import bisect
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync_spark.functions import scalars as S
from docsync_spark.functions import text as T
from docsync_spark.operators.selection import merge_tags
from docsync_spark.sources.scratch import text_parts, written

MARKER = "docsync"
SEGMENT = "pos int, block_id string, content string, written_hash string"
SEGMENTS = "array<struct<pos:bigint,block_id:string,content:string,written_hash:string>>"
_INDENT = 2
def segments_of(body: str, marker: str = MARKER) -> list[tuple[str | None, str, str | None]]:
    """(block_id, content, written_hash) of a note body in order; a begin without a later end is text.

    All marker lines are found first and each begin is given the next end of its id; what stands between the
    blocks so made is free text.
    """
    blank = r"[^\S\n]*"
    lines = re.compile(rf"^{blank}<!--(?:{blank}{re.escape(marker)}:begin[^\S\n]+([A-Za-z0-9][\w.\-]*)(?:[^\S\n]+h=([0-9a-f]+))?{blank}| {re.escape(marker)}:end ([A-Za-z0-9][\w.\-]*) )-->{blank}$", re.A | re.M)
    marks = list(lines.finditer(body))
    ends: dict[str, list[re.Match]] = {}
    for m in marks:
        if m[3]:
            ends.setdefault(m[3], []).append(m)
    out: list[tuple[str | None, str, str | None]] = []
    at = 0  # where the next line begins that is not yet dealt with
    for m in marks:
        if not m[1] or m.start() < at:
            continue
        own = ends.get(m[1], [])
        k = bisect.bisect_right(own, m.start(), key=lambda e: e.start())
        if k == len(own):
            continue
        if m.start() > at:
            out.append((None, body[at : m.start() - 1], None))
        out.append((m[1], body[m.end() + 1 : own[k].start()].strip(), m[2]))
        at = own[k].end() + 1
    return [*out, (None, body[at:], None)] if at <= len(body) else out


def parse_segments(notes: DataFrame, key: str = "note_id", body: str = "body", marker: str = MARKER, generated: str | None = None) -> DataFrame:
    """(note_id, pos, block_id, content, written_hash): the segments of each note body; null bodies have none.

    generated names a boolean column. With it, a note without a block of ours has none if that is true, since an older
    version wrote it and it can be written anew, or if it is blank; else it is somebody's own and is one free segment.
    """
    asked = [key, body, *([generated] if generated else [])]

    def of(text: str, ours: bool):
        found = segments_of(text, marker)
        if not generated or any(s[0] is not None for s in found):
            return found
        return [] if ours or not text.strip() else [(None, text.rstrip("\n") + "\n", None)]

    def run(batches):
        for batch in batches:
            ours = batch[generated].fillna(False).astype(bool) if generated else [False] * len(batch)
            rows = [(k, i, *s) for k, b, o in zip(batch[key], batch[body], ours, strict=True) if isinstance(b, str) for i, s in enumerate(of(b, o))]
            yield pd.DataFrame(rows, columns=[key, "pos", "block_id", "content", "written_hash"])

    return notes.select(*asked).mapInPandas(run, f"{key} {notes.schema[key].dataType.simpleString()}, {SEGMENT}")


def register_segments(spark: SparkSession, name: str = "note_segments", marker: str = MARKER) -> None:
    """A table function for SQL: name(body) has (pos, block_id, content, written_hash) of one note body, as parse_segments has them; to be joined laterally."""

    class Segments:
        def eval(self, body: str):
            for i, s in enumerate(segments_of(body, marker) if body is not None else []):
                yield (i, *s)

    spark.udtf.register(name, F.udtf(Segments, returnType=SEGMENT, useArrow=True))


def digest(content: str) -> str:
    return hashlib.sha256(content.strip().encode()).hexdigest()[:8]


def merged(segments: list[tuple], generated: list[tuple[str, str]], marker: str = MARKER) -> tuple[list[tuple], list[str]]:
    """This run's blocks put into a note's segments, and what was surprising.

    The first copy of an id is rewritten; if its text no longer had the digest that was written, the
    old text is parked as free text behind it. A block that the note lacks comes before the next block after the last one placed.
    """
    notes: list[list[tuple]] = [[s] for s in segments]  # each place may grow: before, itself, after
    first: dict[str, int] = {}
    warnings = []
    for i, (b, _, _) in enumerate(segments):
        if b is not None and b in first:
            warnings.append(f"block {b} is in the note twice; the later copy stays as it is")
        elif b is not None:
            first[b] = i
    blocks = [i for i, s in enumerate(segments) if s[0] is not None]
    before: dict[int, list[tuple]] = {}
    at, done = -1, set()
    for b, content in generated:
        new = (b, content.strip(), digest(content))
        if b in first and b not in done:
            at = first[b]
            _, old, written = segments[at]
            notes[at] = [new]
            if written is not None and digest(old) != written:
                gap = "\n\n" if re.match(T.RULE, old.lstrip()) else "\n"
                notes[at].append((None, f"\n<!-- {marker}: what was changed in {b} by hand -->{gap}{old}", None))
                warnings.append(f"block {b} had been changed by hand; it is new now, with the changed text behind it")
        else:
            place = next((i for i in blocks if i > at), len(segments))
            before.setdefault(place, []).append(new)
        done.add(b)
    out = [s for i in range(len(segments) + 1) for s in [*before.get(i, []), *(notes[i] if i < len(segments) else [])]]
    known = {b for b, _ in generated}
    warnings += [f"block {b} is no longer made; the note keeps it" for b, _, _ in out if b is not None and b not in known]
    return out, warnings


def merge_notes(segments: DataFrame, generated: DataFrame, key: str = "note_id", marker: str = MARKER) -> DataFrame:
    """(note_id, pos, block_id, content, written_hash, warnings) of merged notes; warnings stand at pos 0.

    segments as from parse_segments; generated: (note_id, pos, block_id, content). A group is one note.
    """

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        some = new if len(new) else old
        plain = lambda x: x if isinstance(x, str) else None
        have = [(plain(b), c, plain(h)) for b, c, h in old.sort_values("pos")[["block_id", "content", "written_hash"]].itertuples(index=False, name=None)]
        want = list(new.sort_values("pos")[["block_id", "content"]].itertuples(index=False, name=None))
        out, warnings = merged(have, want, marker)
        return pd.DataFrame([(some[key].iloc[0], i, *s, warnings if i == 0 else []) for i, s in enumerate(out)], columns=[key, "pos", "block_id", "content", "written_hash", "warnings"])

    schema = f"{key} {generated.schema[key].dataType.simpleString()}, {SEGMENT}, warnings array<string>"
    return segments.groupBy(key).cogroup(generated.groupBy(key)).applyInPandas(run, schema)


def block_diff(segments: DataFrame, generated: DataFrame, key: str = "note_id") -> DataFrame:
    """(note_id, block_id, state): new, same, edited, replaced, kept or duplicate for each block; native."""
    blocks = segments.filter("block_id is not null")
    old = blocks.groupBy(key, "block_id").agg(F.min_by(F.struct("content", "written_hash"), "pos").alias("old"), F.count("*").alias("copies"))
    new = generated.select(key, "block_id", F.col("content").alias("fresh"))
    both = old.join(new, [key, "block_id"], "full_outer")
    had, written = S.block_digest(F.col("old")["content"]), F.col("old")["written_hash"]
    state = (
        F.when(F.col("old").isNull(), "new").when(F.col("fresh").isNull(), "kept").when(written.isNotNull() & (had != written), "edited")
        .when(had == S.block_digest(F.col("fresh")), "same").otherwise("replaced")
    )
    main = both.select(key, "block_id", state.alias("state"))
    extra = old.filter("copies > 1").select(key, "block_id", F.lit("duplicate").alias("state"))
    return main.union(extra)


def _kind(line: str) -> tuple[str, tuple]:
    """Which block a line begins, by what it starts with, and what the line itself says of it: a fence's language; a
    heading's level and text; an item's indent, its mark or number, and its text."""
    body, shown = line.lstrip(), line.strip()
    if not shown:
        return "blank", ()
    indent, sign = len(line) - len(body), shown[0]
    same = len(shown) - len(shown.lstrip(sign))
    if sign in "`~" and same > 2 and indent < 4 and len(shown[same:].split()) < 2:
        return "code", (shown[same:].strip(),)
    if shown == "$$":
        return "math", ()
    if sign in "-*_" and indent < 4 and "".join(shown.split()) == sign * shown.count(sign) and shown.count(sign) > 2:
        return "divider", ()
    if sign == "#" and not indent and same < 7 and line[same:][:1].isspace():
        return "heading", (same, line[same:].strip())
    if sign == ">":
        return "quote", ()
    digits = len(body) - len(body.lstrip("".join({x for x in body if x.isdecimal()}))) if sign.isdecimal() else 0
    mark = 1 if sign in "-*+" else digits + 1 if digits and body[digits : digits + 1] in (".", ")") else 0
    if mark and body[mark : mark + 1].isspace():
        item = body[mark:].lstrip()
        if not digits and item[:1] == "[" and item[2:3] == "]" and item[1] in " xX" and item[3:4].isspace():
            return "task_list", (indent, item[1], item[4:].strip())
        return "list", (indent, body[:digits], item.strip())
    if sign == "|" and len(shown) > 1 and shown[-1] == "|":
        return "table", ()
    return "paragraph", ()


def _unquoted(line: str) -> str:
    """A quoted line without its sign and one blank after it."""
    rest = line.lstrip()[1:]
    return rest[1:] if rest[:1].isspace() else rest


def _callout(line: str) -> tuple[str, str] | None:
    """(type, title) where a quoted line opens a callout: the type in brackets after an exclamation mark, a fold sign or two, a title."""
    rest = line.lstrip()[1:].lstrip()
    end = rest.find("]")
    if not rest.startswith("[!") or end < 3:
        return None
    return rest[2:end].strip().lower(), rest[end + 1 :].removeprefix("-").removeprefix("+").strip()


def _taken(lines: list[str], i: int, kind: str) -> tuple[int, list[str]]:
    """(where the next block begins, the lines of the block of that kind that begins at i)."""
    j = i + 1
    if kind in ("code", "math"):
        closes = (lambda x: x.strip().startswith(lines[i].strip()[0] * 3)) if kind == "code" else (lambda x: x.strip() == "$$")
        while j < len(lines) and not closes(lines[j]):
            j += 1
        return j + 1, lines[i + 1 : j]
    if kind in ("paragraph", "quote", "table"):
        while j < len(lines) and _kind(lines[j])[0] == kind:
            j += 1
    return j, lines[i:j]


def blocks_of(text: str) -> list[tuple]:
    """(pos, kind, text, level, parent_pos, owner, depth, attrs): the Markdown blocks of a page in reading order.

    owner is the callout that a block is in, depth how many callouts; parent_pos its list item or callout. A callout's
    lines are put aside as a text of their own, which is read before what follows, however deep it goes.
    """
    rows: list[tuple] = []
    open_ = [(text.replace("\r\n", "\n").split("\n"), 0, 0, None)]  # texts that are not read to the end: lines, the next one, depth, owner
    while open_:
        lines, i, depth, owner = open_.pop()
        items: list[tuple[int, int]] = []  # open list items: level, pos
        while i < len(lines):
            kind, said = _kind(lines[i])
            after, own = _taken(lines, i, kind)
            body, level, parent, attrs = "\n".join(own), 0, owner, {}
            if kind not in ("list", "task_list"):
                items = []
            if kind in ("paragraph", "math"):
                body = body.strip()
                attrs = {"display": "true"} if kind == "math" else {}
            elif kind == "code":
                attrs = {"language": said[0]}
            elif kind == "divider":
                body = ""
            elif kind == "heading":
                level, body = said
            elif kind == "table":
                body = "\n".join(x.strip() for x in own)
            elif kind == "quote":
                named = _callout(own[0])
                body = "\n".join(map(_unquoted, own)).strip()
                if named:
                    kind, body, attrs = "callout", named[1], {"callout_type": named[0]}
            elif kind in ("list", "task_list"):
                indent, mark, body = said
                level = indent // _INDENT
                while items and items[-1][0] >= level:
                    items.pop()
                parent = items[-1][1] if items else owner
                items.append((level, len(rows)))
                attrs = {"checked": str(mark in "xX").lower()} if kind == "task_list" else {"ordered": "true", "number": mark.lstrip("0") or "0"} if mark else {"ordered": "false"}
            i = after
            if kind != "blank" and (body or kind != "paragraph"):
                rows.append((len(rows), kind, body, level, parent, owner, depth, attrs))
            if kind == "callout":
                open_ += [(lines, i, depth, owner), ([_unquoted(x) for x in own[1:]], 0, depth + 1, len(rows) - 1)]
                break
    return rows


def extract_blocks(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(*keys, pos, kind, text, level, parent_pos, owner, depth, attrs): flat block rows of each text."""
    schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys) + ", pos int, kind string, text string, level int, parent_pos int, owner int, depth int, attrs map<string,string>"
    made = {"pos": pa.int32(), "kind": pa.string(), "text": pa.string(), "level": pa.int32(), "parent_pos": pa.int32(), "owner": pa.int32(), "depth": pa.int32(), "attrs": pa.map_(pa.string(), pa.string())}

    def out(part: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        """The blocks of the texts at these places of part, each with its text's keys."""
        fresh = zip(*rows, strict=True) if rows else [()] * len(made)
        arrays = [pa.array([list(x.items()) for x in values] if name == "attrs" else values, kind) for values, (name, kind) in zip(fresh, made.items(), strict=True)]
        return pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at, pa.int64())) for k in keys), *arrays], names=[*keys, *made])

    def run(batches):
        for batch in batches:
            for part in text_parts(batch, text_col):
                at, rows = [], []
                for i, text in enumerate(part.column(text_col).to_pylist()):
                    if text is not None:
                        found = blocks_of(text)
                        at += [i] * len(found)
                        rows += found
                yield out(part, at, rows)

    return pages.select(*keys, text_col).mapInArrow(run, schema)


def line_kinds(text: Column) -> Column:
    """Counts of heading, list and task lines of a text: a native map for when no blocks are needed."""
    item, blanks = "^\\s*([-+*]|[0-9]+[.)])\\s+", F.array(*map(F.lit, " \t\r\x0b\x0c"))

    def of(line: Column) -> Column:
        rest = F.regexp_replace(line, item, "")
        box = F.lower(F.substring(rest, 1, 3)).isin("[ ]", "[x]") & F.array_contains(blanks, F.substring(rest, 4, 1)) & ~F.ltrim(line).rlike("^[0-9]")
        return F.when(F.rlike(line, F.lit("^#{1,6}\\s")), "heading").when(rest != line, F.when(box, "task_list").otherwise("list"))

    kinds = F.transform(F.split(text, "\n"), of)
    return F.create_map(*[x for k in ("heading", "task_list", "list") for x in (F.lit(k), F.size(F.filter(kinds, lambda found: found == k)).cast("long"))])


def _indent(level: Column) -> Column:
    return F.repeat(F.lit(" " * _INDENT), level)


#: How each kind is written; a kind that is absent is written as its text.
WRITERS = {
    "heading": lambda b: F.concat(F.repeat(F.lit("#"), F.least(F.greatest(b["level"], F.lit(1)), F.lit(6))), F.lit(" "), b["text"]),
    "paragraph": lambda b: b["text"],
    "list": lambda b: F.concat(_indent(b["level"]), F.when(b["attrs"]["ordered"] == "true", F.concat(b["attrs"]["number"], F.lit("."))).otherwise("-"), F.lit(" "), b["text"]),
    "task_list": lambda b: F.concat(_indent(b["level"]), F.lit("- ["), F.when(b["attrs"]["checked"] == "true", "x").otherwise(" "), F.lit("] "), b["text"]),
    "quote": lambda b: F.array_join(F.transform(F.split(b["text"], "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"),
    "code": lambda b: F.concat(F.lit("```"), F.coalesce(b["attrs"]["language"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n```")),
    "math": lambda b: F.when(b["attrs"]["display"] == "true", F.concat(F.lit("$$\n"), b["text"], F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), b["text"], F.lit("$"))),
    "divider": lambda b: F.lit("---"),
    "table": lambda b: b["text"],
}


def render_blocks(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",), writers: dict = WRITERS) -> DataFrame:
    """(*keys, text): blocks as Markdown. Items of one list are joined by a line end, all else by a blank line.

    A block in callouts is its own text with a sign of quotation for each of them before every line, and what stands between
    two blocks depends on the one before it in the same callout alone. So blocks are written each on its own, however deep they are, and put together once.
    """
    b = {c: F.col(c) for c in ("text", "level", "attrs")}
    shown = None
    for kind, write in writers.items():
        shown = F.when(F.col("kind") == kind, write(b)) if shown is None else shown.when(F.col("kind") == kind, write(b))
    head = F.concat(F.lit("> [!"), F.coalesce(F.nullif(F.col("attrs")["callout_type"], F.lit("")), F.lit("note")), F.lit("]"), F.when(F.col("text") != "", F.concat(F.lit(" "), F.col("text"))).otherwise(""))
    tight = F.when(F.col("kind").isin("list", "task_list"), F.concat("kind", F.coalesce(F.col("attrs")["ordered"], F.lit("false"))))
    rows = blocks.withColumn("__shown", F.when(F.col("kind") == "callout", head).otherwise(shown.otherwise(F.col("text")))).withColumn("__tight", tight)
    rows = rows.filter(F.trim("__shown") != "")

    before = Window.partitionBy(*keys, "owner").orderBy("pos")
    along = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumns({"__first": F.lag("pos").over(before).isNull(), "__last": F.lag("__tight").over(before), "__next": F.lead("owner").over(along)})
    quoted = lambda line: F.when(line == "", F.rtrim(F.repeat(F.lit("> "), F.col("depth")))).otherwise(F.concat(F.repeat(F.lit("> "), F.col("depth")), line))
    gap = F.when(F.col("__last").isNotNull() & F.col("__last").eqNullSafe(F.col("__tight")), "\n").otherwise(F.concat(F.lit("\n"), quoted(F.lit("")), F.lit("\n")))
    gap = F.when(F.col("__first"), F.when(F.col("owner").isNull(), "").otherwise("\n")).otherwise(gap)
    hollow = (F.col("kind") == "callout") & ~F.col("__next").eqNullSafe(F.col("pos"))  # nothing stands in it
    piece = F.concat(gap, F.array_join(F.transform(F.split("__shown", "\n"), quoted), "\n"), F.when(hollow, F.concat(F.lit("\n"), quoted(F.lit(">")))).otherwise(""))
    pieces = rows.select(*keys, F.struct("pos", piece.alias("piece")).alias("one"))
    pieces = pieces.union(blocks.select(*keys, F.lit(None).cast(pieces.schema["one"].dataType)))  # texts whose blocks are all blank are empty
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["piece"]), "").alias("text"))


def claim_names(docs: DataFrame, notes: DataFrame, most: int = 99, sentinel: str | None = None) -> DataFrame:
    """(doc_id, dir, name, warnings): for each document in order the first name that is free or its own already.

    docs: (doc_id, dir, base, ord); notes: (dir, name, owner, readable). 'x', 'x (2)' … 'x (99)', then
    'x (100)' unchecked, with a warning. An unreadable note is never free and gets a warning; one without owner is free.
    A document named as the sentinel begins at 'sentinel (2)'.

    A document that owns the note of its first name has it. So has one whose name nobody else wants, no note bears
    and no other document can reach by counting up. The others are settled in order, in groups of names with one stem. Of the
    documents that want the same name only the first most + 1 and owners of notes can get anything but the last name,
    so only they go into a group, with the notes that they may meet; a thousand 'Untitled' more are named at once.
    """
    stem = lambda x: F.regexp_replace(x, r"(?: \(\d+\))+$", "")
    shorter = lambda x: F.regexp_extract(x, r"^(.*) \(\d+\)$", 1)
    number = lambda x: F.regexp_extract(x, r" \((\d{1,4})\)$", 1).try_cast("int")
    base = S.sanitize_filename(F.col("base"))
    base = F.when(base == sentinel, F.concat(base, F.lit(" (2)"))).otherwise(base) if sentinel else base
    wants = written(docs.select("doc_id", "dir", base.alias("base"), "ord"))
    held = notes.select("dir", "name", "owner", F.coalesce("readable", F.lit(False)).alias("readable"))
    wanted = wants.groupBy("dir", "base").agg(F.count("*").alias("n"))

    first = held.groupBy("dir", F.col("name").alias("base")).agg(F.max(F.when(F.col("readable"), F.col("owner"))).alias("owner"), F.lit(True).alias("taken"))
    reach = wanted.select("dir", F.col("base").alias("below"), F.lit(True).alias("reached"))
    marked = wants.join(wanted, ["dir", "base"]).join(first, ["dir", "base"], "left").withColumn("below", shorter(F.col("base"))).join(reach, ["dir", "below"], "left")
    own = F.coalesce(F.col("owner") == F.col("doc_id"), F.lit(False))
    marked = written(marked.select("doc_id", "dir", "base", "ord", (own | ((F.col("n") == 1) & F.col("taken").isNull() & F.col("reached").isNull())).alias("settled")))
    none = F.array().cast("array<string>")
    settled = marked.filter("settled").select("doc_id", "dir", F.col("base").alias("name"), none.alias("warnings"))

    rest = marked.filter("not settled").drop("settled")
    bases = rest.select("dir", "base").distinct()
    meets = held.withColumn("base", F.col("name")).union(held.filter(number(F.col("name")).between(2, most + 1)).withColumn("base", shorter(F.col("name"))))
    meets = meets.join(bases, ["dir", "base"], "left_semi").drop("base").distinct()
    owners = meets.filter("owner is not null").select(F.col("owner").alias("doc_id")).distinct()
    turn = F.row_number().over(Window.partitionBy("dir", "base").orderBy("ord", "doc_id"))
    rest = rest.withColumn("turn", turn).join(owners.withColumn("owns", F.lit(True)), "doc_id", "left")
    rest = written(rest.select("doc_id", "dir", "base", "ord", ((F.col("turn") > most + 1) & F.col("owns").isNull()).alias("late")))
    full = lambda b: F.concat(F.lit("no name like "), b, F.lit(" is free; the last one is shared"))
    late = rest.filter("late").select("doc_id", "dir", F.concat("base", F.lit(f" ({most + 1})")).alias("name"), F.array(full(F.col("base"))).alias("warnings"))

    def run(want: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        held = {n: (o if isinstance(o, str) else None, bool(r)) for n, o, r in have[["name", "owner", "readable"]].itertuples(index=False, name=None)}
        rows = []
        for doc, where, base in want.sort_values(["ord", "doc_id"])[["doc_id", "dir", "base"]].itertuples(index=False, name=None):
            warnings = []
            for name in [base, *(f"{base} ({i})" for i in range(2, most + 1))]:
                owner, readable = held.get(name, (None, True))
                if readable and owner in (None, doc):
                    break
                if not readable:
                    warnings.append(f"{name} can't be read and stays; the document went beside it")
            else:
                name = f"{base} ({most + 1})"
                warnings.append(f"no name like {base} is free; the last one is shared")
            held[name] = (doc, True)
            rows.append((doc, where, name, warnings))
        return pd.DataFrame(rows, columns=["doc_id", "dir", "name", "warnings"])

    few = rest.filter("not late").withColumn("stem", stem(F.col("base")))
    met = meets.select(F.col("dir").alias("__dir"), stem(F.col("name")).alias("__stem"), "name", "owner", "readable")
    hard = few.groupBy("dir", "stem").cogroup(met.groupBy("__dir", "__stem")).applyInPandas(run, "doc_id string, dir string, name string, warnings array<string>")
    return settled.union(late).union(hard)


def prune_orphans(orphans: DataFrame, publications: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, destination, target, action): delete notes that carry the document's id, keep others; state is forgotten either way."""
    rows = orphans.select("doc_id").join(publications.select("doc_id", "destination", "target"), "doc_id")
    seen = notes.select("destination", "target", "owner")
    return rows.join(seen, ["destination", "target"], "left").select("doc_id", "destination", "target", F.when(F.col("owner") == F.col("doc_id"), "delete").otherwise("keep").alias("action"))


def relocations(docs: DataFrame, publications: DataFrame, notes: DataFrame) -> DataFrame:
    """(doc_id, destination, old, new): notes to move: at a new path, the old one there and ours, the new one free."""
    rows = docs.select("doc_id", "path").join(publications.select("doc_id", "destination", F.col("target").alias("old")), "doc_id").filter("old <> path")
    mine = notes.select("destination", F.col("target").alias("old"), F.col("owner").alias("doc_id"))
    busy = notes.select("destination", F.col("target").alias("path"))
    return rows.join(mine, ["destination", "old", "doc_id"], "left_semi").join(busy, ["destination", "path"], "left_anti").select("doc_id", "destination", "old", F.col("path").alias("new"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, segments): a segment array 'page-N' for each page in order, from (doc_id, idx, text, error)."""
    body = S.page_body(F.col("text"), F.col("error"))
    one = F.struct("idx", F.concat(F.lit("page-"), (F.col("idx") + 1).cast("string")).alias("block_id"), body.alias("content"), S.block_digest(body).alias("written_hash"))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("segments"))


def generated_blocks(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pos, block_id, content): a block for each page; the body where there are no pages; the gallery of page images.

    docs may have body_text; pages: (doc_id, idx, text, error), and image, a link, if any.
    """
    none = F.lit(None).cast("string")
    body = F.col("body_text") if "body_text" in docs.columns else none
    image = F.col("image") if "image" in pages.columns else none
    own = pages.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    paged = own.select("doc_id", F.col("idx").cast("long").alias("pos"), F.concat(F.lit("page-"), (F.col("idx") + 1).cast("string")).alias("block_id"), S.page_body(F.col("text"), F.col("error")).alias("content"))
    alone = docs.join(own.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = alone.filter(F.coalesce(S.strip(body) != "", F.lit(False))).select("doc_id", F.lit(0).cast("long"), F.lit("body"), S.strip(body))
    shown = F.transform(F.array_sort(F.collect_list(F.when(image.isNotNull(), F.struct("idx", image.alias("image"))))), lambda x: F.concat(F.lit("![["), x["image"], F.lit("]]")))
    gallery = own.groupBy("doc_id").agg(shown.alias("shown")).filter(F.size("shown") > 0)
    gallery = gallery.select("doc_id", F.lit(1 << 40), F.lit("attachments"), F.concat(F.lit("---\n\n## Original Pages\n\n"), F.array_join("shown", "\n\n")))
    return paged.union(whole).union(gallery)


def _put_into(body: pd.Series, ours: pd.Series, made: pd.Series) -> pd.DataFrame:
    """(segments, warnings) of note bodies with the blocks made put in; nothing where the body is null."""
    rows = []
    for text, own, blocks in zip(body, ours, made, strict=True):
        if not isinstance(text, str):
            rows.append((None, None))
            continue
        found = segments_of(text)
        if all(s[0] is None for s in found):  # the mark is part of a text
            found = [] if own or not text.strip() else [(None, text.rstrip("\n") + "\n", None)]
        out, warnings = merged(found, [(b["block_id"], b["content"]) for b in blocks])
        rows.append(([{"pos": i, "block_id": b, "content": c, "written_hash": h} for i, (b, c, h) in enumerate(out)], warnings))
    return pd.DataFrame({"segments": [r[0] for r in rows], "warnings": [r[1] for r in rows]})


def build_notes(docs: DataFrame, pages: DataFrame, today: str, existing: DataFrame | None = None, base_tags: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, note, warnings): whole notes of docs, merged into the existing ones.

    docs: (doc_id, title, tags) and, if there, folder_parts, type, link, modified, first_published, body_text;
    pages as for generated_blocks; existing: (doc_id, text), at most one row a document. Of an existing note
    the first date, tags, front matter that isn't ours, text between our blocks and blocks that are no longer made stay;
    a note without our blocks stays above ours, unless an older version wrote it. Notes without a mark of ours, mostly nearly all, are
    rendered natively; the others are merged where they are, a row each. A document without pages and text has a front matter alone.
    """
    given = lambda c, kind: F.col(c) if c in docs.columns else F.lit(None).cast(kind)
    strings = F.array().cast("array<string>")
    old = existing if existing is not None else docs.select("doc_id", F.lit(None).cast("string").alias("text")).limit(0)
    old = old.filter("text is not null").select("doc_id", T.split_frontmatter(F.col("text")).alias("x")).select("doc_id", "x.front", "x.body")
    fresh = generated_blocks(docs, pages).select("doc_id", F.struct(F.col("pos").cast("long").alias("pos"), "block_id", "content", S.block_digest(F.col("content")).alias("written_hash")).alias("one"))
    bodies = fresh.groupBy("doc_id").agg(F.array_sort(F.collect_list("one")).alias("fresh"))

    # a note without a mark of ours is one free text, or nothing, and needs no merge
    ours = F.coalesce(T.looks_generated(F.col("front")), F.lit(False))
    marked = F.coalesce(F.col("body").contains(f"{MARKER}:begin"), F.lit(False))
    empty = F.array().cast(SEGMENTS)
    made = F.coalesce("fresh", empty)
    free = F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("block_id"), F.concat(F.regexp_replace("body", "\\n+\\z", ""), F.lit("\n")).alias("content"), F.lit(None).cast("string").alias("written_hash"))
    kept = F.coalesce(~ours & (S.strip(F.col("body")) != ""), F.lit(False))
    all_ = docs.join(old, "doc_id", "left").join(bodies, "doc_id", "left").withColumns({"__made": made, "__marked": marked, "__ours": ours})
    put = F.pandas_udf(_put_into, f"segments {SEGMENTS}, warnings array<string>")
    asked = [F.when(F.col("__marked"), F.col(c)) for c in ("body", "__ours", "__made")]
    all_ = all_.withColumn("__merged", put(*asked))
    all_ = all_.withColumn("segments", F.when(F.col("__marked"), F.col("__merged.segments")).when(kept, F.concat(F.array(free), "__made")).otherwise(F.col("__made")))
    all_ = all_.withColumn("warnings", F.when(F.col("__marked"), F.col("__merged.warnings")))

    front = F.coalesce("front", strings)
    modified, published = S.to_iso_date(given("modified", "string")), S.to_iso_date(given("first_published", "string"))
    kind = F.when(given("type", "string").isin("pdf", "epub"), given("type", "string"))
    path = F.array_join(F.concat(F.filter(F.transform(F.coalesce(given("folder_parts", "array<string>"), strings), S.strip), lambda x: x != ""), F.array(S.strip(F.col("title")))), "/")
    link = F.concat(F.lit('"[['), given("link", "string"), F.lit(']]"'))
    tags = merge_tags(F.array(*[F.lit(t) for t in base_tags]).cast("array<string>"), F.col("tags"), T.frontmatter_list(front, "tags"))
    values = {
        "docsync_id": F.col("doc_id").cast("string"), "created": F.coalesce(T.frontmatter_value(front, "created"), published, modified, F.lit(today)), "updated": F.coalesce(modified, F.lit(today)),
        "synced": F.lit(today), "source": F.concat(F.lit("docsync/"), path), "type": kind, "document": link,
    }
    head = F.array_join(F.concat(F.array(F.lit("---"), T.render_frontmatter(values, {"tags": tags})), T.foreign_frontmatter(front), F.array(F.lit("---"), F.lit(""))), "\n")
    note = F.concat(F.regexp_replace(F.concat(head, T.render_segments(F.col("segments"))), "\\n+\\z", ""), F.lit("\n"))
    return all_.select("doc_id", note.alias("note"), F.coalesce("warnings", strings).alias("warnings"))
