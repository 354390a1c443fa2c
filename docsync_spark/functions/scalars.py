"""Scalar rules as Column expressions. All are native; only redact_all, which takes whole tables, needs Python on the executors."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsync_spark.functions import substrings

SOURCES = (("notebook", ""), ("pdf", "pdf"), ("epub", "epub"))
#: Characters that file names can't hold.
UNSAFE = r'[/\\:*?"<>|#^\[\]]'
MASK = "***redacted***"
UNITS = ("KB", "MB", "GB")
#: How reports and notes put a run, an outcome, a page header and a page that is missing.
PHRASES = {
    "unfinished": "did not finish",
    "overlapping": "skipped · a sync was already running",
    "nothing": "nothing to do",
    "interrupted": "interrupted",
    "interrupted_after": "interrupted after ",
    "synced": "synced ",
    "failed": "failed",
    "unknown_time": "unknown time",
    "just_now": "just now",
    "unchanged": "unchanged",
    "deferred": "pending, past the limit",
    "nowhere": "nowhere",
    "missing_page": "> [!warning] Page not transcribed",
}
#: Marks of the summary table.
MARKERS = {"published": "✓", "would_publish": "✓", "failed": "✗", "skipped": "·", "deferred": "·"}
PARTIAL, DONE, PLANNED = "⚠", "→", "⇢"
#: The markup of a page header.
HEADER_OPEN = '<span style="font-size: 0.9em; color: #777777"><b>'
HEADER_TRAIL = '</b><br><span style="font-size: 0.8em; color: #aaaaaa">'


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")


def truthy(x: Column) -> Column:
    return F.coalesce(x != "", F.lit(False))


def document_version(hash_: Column, version: Column) -> Column:
    """The content hash, else the whole-number version as text, else '1'."""
    return F.coalesce(F.nullif(hash_, F.lit("")), version.try_cast("int").cast("string"), F.lit("1"))


def document_type(file_type: Column, files: Column, name: Column, sources: Iterable[tuple[str, str]] = SOURCES) -> Column:
    """The reported type if registered by suffix, else that of any listed file, else of the name, else notebook.

    'notebook' is no suffix of its own: a notebook titled x.pdf is a pdf.
    """
    sources = [(s, x) for s, x in sources if x]
    reported = F.lower(strip(file_type))
    out = F.coalesce(*[F.when(reported == x, F.lit(s)) for s, x in sources])
    ends = lambda path, x: F.endswith(F.lower(path), F.lit(f".{x}"))
    some = lambda x: F.exists(files, lambda f: F.coalesce(ends(f, x), F.lit(False)))
    listed = F.coalesce(*[F.when(some(x), F.lit(s)) for s, x in sources])
    named = F.coalesce(*[F.when(ends(strip(name), x), F.lit(s)) for s, x in sources])
    return F.coalesce(out, listed, named, F.lit("notebook"))


def to_datetime(value: Column) -> Column:
    """A timestamp from ISO text or from epoch seconds or (above 1e11) milliseconds; unreadable gives null."""
    text = strip(value.cast("string"))
    number = text.try_cast("double")
    seconds = F.when(F.abs(number) > 1e11, number / 1000).otherwise(number)
    inside = seconds.between(-62135596800, 253402300799)
    return F.coalesce(F.when(number.isNotNull() & inside, F.timestamp_millis((seconds * 1000).cast("long"))), F.when(number.isNull(), F.try_to_timestamp(text)))


def to_iso_date(value: Column) -> Column:
    return F.date_format(to_datetime(value), "yyyy-MM-dd")


def normalize_tag(tag: Column) -> Column:
    x = F.regexp_replace(strip(tag), "^#+", "")
    return F.regexp_replace(F.regexp_replace(strip(x), "(?U)\\s+", "-"), "(?U)[^\\w\\-/]", "")


def normalize_path(path: Column) -> Column:
    parts = F.transform(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: F.lower(strip(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def document_path(folder_parts: Column, name: Column) -> Column:
    return F.array_join(F.concat(folder_parts, F.array(name)), "/")


def folder_label(folder_parts: Column) -> Column:
    return F.array_join(folder_parts, " / ")


def matches_target(id_: Column, name: Column, folder_parts: Column, target: str) -> Column:
    """Blank never; the id; part of the name; or, in a folder, part of the full path. Case does not count."""
    t = target.strip().lower()
    if not t:
        return F.lit(False)
    path = normalize_path(document_path(folder_parts, name))
    wanted = "/".join(p for p in (q.strip() for q in t.replace("\\", "/").split("/")) if p)
    in_folder = (F.size(folder_parts) > 0) & F.contains(path, F.lit(wanted)) & F.lit(bool(wanted))
    return F.coalesce((F.lower(id_) == t) | F.contains(F.lower(name), F.lit(t)) | in_folder, F.lit(False))


def path_filter(path: Column, source_path: str | None = None, source_regex: str | None = None) -> Column:
    """Part of the path, whatever its case, or a Java regular expression found in it; not both."""
    if source_path and source_regex:
        raise ValueError("give source_path or source_regex, not both")
    if source_regex:
        return F.rlike(path, F.lit(source_regex))
    return F.contains(F.lower(path), F.lit(source_path.lower())) if source_path else F.lit(True)


def excluded(folder: Column, names: Iterable[str]) -> Column:
    """Whether a whole segment of a ' / ' label is one of the names."""
    wanted = sorted({n.strip().lower() for n in names} - {""})
    if not wanted:
        return F.lit(False)
    return F.arrays_overlap(F.transform(F.split(folder, " / "), lambda s: F.lower(strip(s))), F.array(*map(F.lit, wanted)))


def type_filter(doc_type: Column, types: Iterable[str]) -> Column:
    types = list(types)
    return doc_type.isin(types) if types else F.lit(True)


def is_document(doc_type: Column, name: Column) -> Column:
    return F.coalesce((doc_type == "DocumentType") & (strip(name) != ""), F.lit(False))


def is_trashed(deleted: Column, folder_parts: Column) -> Column:
    return F.coalesce(deleted, F.lit(False)) | F.startswith(folder_label(folder_parts), F.lit("[TRASH]"))


def sanitize_filename(name: Column) -> Column:
    x = F.btrim(F.regexp_replace(F.regexp_replace(name, UNSAFE, "-"), "-+", "-"), F.lit(" -"))
    return F.when(x == "", "Untitled").otherwise(x)


def path_is_contained(segments: Column) -> Column:
    bad = lambda s: s.isNull() | F.trim(s).isin("", ".", "..") | s.rlike("[/\\\\\\x00]")
    return F.forall(segments, lambda s: ~bad(s))


def _one_digit(n: Column, unit: int) -> Column:
    """n / unit, of a whole n, with one digit after the point: rounded from the exact quotient, ties to even. bround rounds the shortest decimal that names a double instead."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    rest = n % unit * 10
    tenth, over = div(rest, unit), rest % unit * 2
    tenths = div(n, unit) * 10 + tenth + ((over > unit) | (over == unit) & (tenth % 2 == 1)).cast("long")
    return F.concat(div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_size(n: Column) -> Column:
    """Whole bytes; from 2^53 on they count as the double next to them."""
    near = F.least(n.cast("long"), F.lit((1 << 63) - 1024)).cast("double").cast("long")
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(UNITS, 1):
        text = F.concat(_one_digit(near, 1024**i), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (i + 1), text) if unit != "GB" else out.otherwise(text)
    return out


def humanize_duration(seconds: Column) -> Column:
    total = F.greatest(seconds.cast("double"), F.lit(0.0))
    n = F.floor(total)
    two = lambda big, small, a, b: F.concat(F.floor(big).cast("string"), F.lit(f"{a} "), F.floor(small).cast("string"), F.lit(b))
    return (
        F.when(seconds.isNull(), None)
        .when(total < 10, F.concat(_one_digit((F.least(total, F.lit(10.0)) * 2.0**59).cast("long"), 1 << 59), F.lit("s")))
        .when(n < 60, F.concat(n.cast("string"), F.lit("s")))
        .when(n < 3600, two(n / 60, n % 60, "m", "s"))
        .when(n < 86400, two(n / 3600, n % 3600 / 60, "h", "m"))
        .otherwise(two(n / 86400, n % 86400 / 3600, "d", "h"))
    )


def humanize_ago(seconds: Column) -> Column:
    total = F.greatest(seconds.cast("double"), F.lit(0.0))
    out = F.when(seconds.isNull(), None).when(total < 90, PHRASES["just_now"])
    for size, unit in ((86400, "day"), (3600, "hour"), (60, "minute")):
        n = F.floor(total / size)
        out = out.when(total >= size, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")))
    return out


def format_moment(ts: Column, year: bool = False) -> Column:
    return F.date_format(ts, "EEE dd MMM yyyy, HH:mm" if year else "EEE dd MMM HH:mm")


def counted(n: Column, word: str = "document") -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def describe_run(outcome: Column, published: Column, failed: Column, error: Column) -> Column:
    """One phrase for a run."""
    done, missed, why = F.coalesce(published, F.lit(0)), F.coalesce(failed, F.lit(0)), strip(F.coalesce(error, F.lit("")))
    tail = F.when(why != "", F.concat(F.lit(" · "), why)).otherwise("")
    synced = F.concat(F.lit(PHRASES["synced"]), counted(done))
    return (
        F.when(outcome.isNull(), PHRASES["unfinished"])
        .when(outcome == "skipped_overlapping", PHRASES["overlapping"])
        .when(outcome == "nothing_to_do", PHRASES["nothing"])
        .when(outcome == "interrupted", F.when(done > 0, F.concat(F.lit(PHRASES["interrupted_after"]), counted(done))).otherwise(PHRASES["interrupted"]))
        .when(outcome == "success", F.when(done > 0, synced).otherwise(PHRASES["nothing"]))
        .when(outcome == "partial", F.concat(synced, F.lit(", "), missed.cast("string"), F.lit(" failed"), tail))
        .otherwise(F.concat(F.lit(PHRASES["failed"]), tail))
    )


def run_line(fire: Column, started: Column, finished: Column, phrase: Column) -> Column:
    """When, what, and how long if it finished."""
    took = F.coalesce(F.concat(F.lit("   "), humanize_duration(F.unix_micros(finished) / 1e6 - F.unix_micros(started) / 1e6)), F.lit(""))
    return F.concat(F.coalesce(format_moment(F.coalesce(fire, started)), F.lit(PHRASES["unknown_time"])), F.lit("   "), phrase, took)


def padded(x: Column, width: int) -> Column:
    return F.when(F.length(x) < width, F.rpad(x, width, " ")).otherwise(x)


def clipped(x: Column, width: int) -> Column:
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x)


def is_partial(pages_failed: Column, status: Column) -> Column:
    return (pages_failed > 0) & status.isin("published", "would_publish")


def describe_outcome(name: Column, status: Column, pages: Column, transcribed: Column, cached: Column, pages_failed: Column, destinations: Column, reason: Column) -> Column:
    """One padded line of the summary table."""
    mark = F.when(is_partial(pages_failed, status), PARTIAL).otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in MARKERS.items() for x in kv])[status], F.lit("·")))
    line = F.concat(F.lit("  "), mark, F.lit(" "), padded(clipped(name, 24), 24))
    why = F.nullif(reason, F.lit(""))
    work = F.concat(transcribed.cast("string"), F.lit(" transcribed, "), cached.cast("string"), F.lit(" cached"))
    where = F.when(F.size(destinations) > 0, F.array_join(destinations, ", ")).otherwise(PHRASES["nowhere"])
    arrow = F.when(status == "would_publish", PLANNED).otherwise(DONE)
    full = F.concat(line, F.lit(" "), padded(counted(pages, "page"), 9), F.lit(" "), padded(work, 28), F.lit(" "), arrow, F.lit(" "), where)
    missing = F.when(is_partial(pages_failed, status), F.concat(F.lit("   ("), counted(pages_failed, "page"), F.lit(" missing)"))).otherwise("")
    short = {"skipped": PHRASES["unchanged"], "deferred": PHRASES["deferred"], "failed": PHRASES["failed"]}
    out = F
    for s, text in short.items():
        out = out.when(status == s, F.concat(line, F.lit(" "), F.coalesce(why, F.lit(text))))
    return out.otherwise(F.concat(full, missing))


def comparison_row(id_: Column, name: Column, doc_type: Column, width: int = 15) -> Column:
    shown = clipped(F.coalesce(F.nullif(name, F.lit("")), id_, F.lit("")), width)
    return F.concat(padded(F.substring(F.coalesce(id_, F.lit("")), 1, 8), 8), F.lit("  "), padded(shown, width), F.lit("."), padded(F.coalesce(F.nullif(doc_type, F.lit("")), F.lit("notebook")), 8), F.lit("  "))


def page_number_of(filename: Column) -> Column:
    return F.nullif(F.regexp_extract(filename, "(?i)page-(\\d+)", 1), F.lit("")).try_cast("int")


def redact(text: Column, secrets: Iterable[str]) -> Column:
    """Secrets of 8 or more characters replaced one after another, longest first, equal lengths by value."""
    for s in sorted({s for s in secrets if s and len(s) >= 8}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(s), F.lit(MASK))
    return text


def redact_all(df: DataFrame, text_col: str, secrets: Iterable[str] | DataFrame) -> DataFrame:
    """df with the text redacted as redact() does it, for any number of secrets, a list or a table of one column: the plan holds no secret.

    Tasks look a text's places up in a table of the secrets' bits, whose size does not grow with the secrets; what seems to occur meets the secrets by a join, and
    only secrets that occur in a text are put through, in their order. A secret that could meet a mask, since an end of one is an end of the other or one is in
    the other, may appear after a replacement only; such ones, few or none, are broadcast and tried on every text.
    """
    if not isinstance(secrets, DataFrame):
        secrets = df.sparkSession.createDataFrame([(s,) for s in secrets], "s string")
    s, text = F.col("s"), F.col(text_col)
    ends = [(F.substring(s, 1, k) == MASK[-k:]) | (F.right(s, F.lit(k)) == MASK[:k]) for k in range(1, len(MASK) + 1)]
    meets = reduce(lambda a, b: a | b, ends, F.contains(s, F.lit(MASK)) | F.contains(F.lit(MASK), s))
    ordered = secrets.toDF("s").filter(F.length("s") >= 8).distinct().select(F.struct((-F.length("s")).alias("n"), "s").alias("__secret"), meets.alias("__odd"), *substrings.names(s))
    odd = ordered.filter("__odd").agg(F.collect_list("__secret").alias("__always"))
    keyed = df.withColumn("__key", F.sha2(text, 256))
    plain = ordered.filter("not __odd")
    seen = substrings.occurring(keyed.filter(text.isNotNull()).select("__key", text.alias("text")), plain.select("__secret.s"))
    found = seen.join(plain, list(substrings.NAMES)).groupBy("__key").agg(F.collect_set("__secret").alias("__tried"))
    tried = F.array_sort(F.concat("__always", F.coalesce("__tried", F.array().cast(found.schema["__tried"].dataType))))
    hidden = F.aggregate(tried, text, lambda t, x: F.replace(t, x["s"], F.lit(MASK)))
    out = keyed.join(found, "__key", "left").join(F.broadcast(odd), how="cross")
    return out.withColumn(text_col, F.when(text.isNotNull(), hidden)).select(*df.columns)


def content_key(payload: Column, fingerprint: Column) -> Column:
    return F.sha2(F.concat(payload.cast("binary"), F.lit(b"\x00"), fingerprint.cast("binary")), 256)


def block_digest(content: Column) -> Column:
    return F.substring(F.sha2(strip(content).cast("binary"), 256), 1, 8)


def fingerprint(*parts: Column) -> Column:
    """16 hex digits of the parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256), 1, 16)


def settings_digest(settings: Mapping, declared: Iterable[str]) -> str:
    """The declared settings as JSON with sorted keys, ready for a recipe table; made on the driver, once a destination."""
    return json.dumps({k: settings[k] for k in declared if k in settings}, sort_keys=True, default=str)


def document_recipe(renderer: Column, transcription: Column, settings: Column) -> Column:
    return fingerprint(renderer, transcription, settings)


def page_label(number: Column, label: Column) -> Column:
    own = strip(label)
    embedded = (own != "") & (F.lower(own) != number.cast("string"))
    return F.when(F.coalesce(embedded, F.lit(False)), F.concat(F.lit("Page "), own, F.lit(" (pdf-"), number.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("Page "), number.cast("string")))


def section_header(label: Column, breadcrumbs: Column, divider: bool = True) -> Column:
    """The divider and the styled page header: the innermost title, its parents and the label."""
    outer = F.lit(HEADER_OPEN)
    n = F.size(breadcrumbs)
    sub = F.array_join(F.concat(F.slice(breadcrumbs, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(label)), " | ")
    trail = F.concat(outer, F.element_at(breadcrumbs, F.lit(-1)), F.lit(HEADER_TRAIL), sub, F.lit("</span></span>"))
    header = F.when(n > 0, trail).otherwise(F.concat(outer, label, F.lit("</b></span>")))
    return F.concat(F.lit("---\n\n"), header) if divider else header


def created_date(own: Column, first_published: Column, modified: Column, today: Column) -> Column:
    return F.coalesce(to_iso_date(own), to_iso_date(first_published), to_iso_date(modified), today)


def gap_marker(error: Column) -> Column:
    head = F.lit(PHRASES["missing_page"])
    lines = F.transform(F.split(strip(error), "\n"), lambda x: F.regexp_replace(F.concat(F.lit("> "), x), "(?U)\\s+$", ""))
    return F.when(strip(error) == "", head).otherwise(F.concat(head, F.lit("\n"), F.array_join(lines, "\n")))


def page_body(text: Column, error: Column) -> Column:
    """A page's text; for a failed one the marker, then what was saved of its text."""
    kept = strip(F.coalesce(text, F.lit("")))
    return F.when(error.isNull(), kept).otherwise(F.concat_ws("\n\n", gap_marker(error), F.nullif(kept, F.lit(""))))


def note_path(folder_parts: Column, title: Column, root: str, mirror: bool = True) -> Column:
    safe = F.transform(F.filter(folder_parts, lambda p: strip(p) != ""), lambda p: sanitize_filename(p))
    name = sanitize_filename(title)
    if mirror:
        return F.array_join(F.concat(F.array(F.lit(root)), safe, F.array(name)), "/")
    return F.concat(F.lit(f"{root}/"), F.array_join(F.concat(safe, F.array(name)), " - "))


def parse_stored(ts: Column) -> Column:
    """A stored timestamp text, naive ones as UTC (the session zone has to be UTC); unreadable gives null."""
    return F.date_trunc("second", F.try_to_timestamp(ts))


def to_utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def watch_alert(last_outcome: Column, last_started: Column, previous_fire: Column, now: Column, grace: int = 900) -> Column:
    """Whether the last scheduled run was not healthy, or the last fire has gone unanswered for over the grace."""
    healthy = last_outcome.isin("success", "nothing_to_do", "skipped_overlapping")
    late = (F.unix_timestamp(now) - F.unix_timestamp(previous_fire) > grace) & (last_started.isNull() | (last_started < previous_fire))
    return F.when(last_started.isNotNull() & ~F.coalesce(healthy, F.lit(False)), True).otherwise(F.coalesce(late, F.lit(False)))
