"""Schedules: cron fires, as-of joins with runs, missed fires, overlapping ticks."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync_spark.operators.scan import running

_RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
_NAMES = ({}, {}, {}, {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}, {d: i for i, d in enumerate("sun mon tue wed thu fri sat".split())})

_FIELD = r"^(\*|[a-z0-9]+)(?:-([a-z0-9]+))?(?:/(\d+))?$"
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def parse_cron(expr: str) -> list[set[int]]:
    """The five fields' values; a Sunday is 0."""
    fields = expr.lower().split()
    if len(fields) != 5:
        raise ValueError(f"a cron expression has five fields: {expr!r}")
    out = []
    for text, (low, high), names in zip(fields, _RANGES, _NAMES, strict=True):
        values: set[int] = set()
        for part in text.split(","):
            m = re.match(_FIELD, part)
            if not m:
                raise ValueError(f"not a cron field: {part!r}")
            number = lambda x: names[x] if x in names else int(x)  # noqa: E731, B023
            a = low if m[1] == "*" else number(m[1])
            b = high if m[1] == "*" or m[3] and not m[2] else number(m[2]) if m[2] else a
            step = int(m[3] or 1)
            if not (low <= a <= b <= high) or not step:
                raise ValueError(f"out of range: {part!r}")
            values |= set(range(a, b + 1, step))
        out.append({v % 7 for v in values} if high == 7 else values)
    return out


def _cron_values(text: Column, low: int, high: int, names: dict[str, int]) -> Column:
    """The values of one field, as parse_cron has them; one that is none is an error."""
    number = lambda x: F.coalesce(x.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(y) for kv in names.items() for y in kv]), x)) if names else x.try_cast("int")

    def values(part: Column) -> Column:
        first, last, step = (F.regexp_extract(part, _FIELD, i) for i in (1, 2, 3))
        a = F.when(first == "*", low).otherwise(number(first))
        b = F.when((first == "*") | (last == "") & (step != ""), high).when(last != "", number(last)).otherwise(a)
        by = F.when(step == "", 1).otherwise(step.try_cast("int"))
        good = part.rlike(_FIELD) & (a >= low) & (a <= b) & (b <= high) & (by > 0)
        return F.when(good, F.sequence(a, b, by)).otherwise(F.raise_error(F.concat(F.lit("not a cron field: "), part)).cast("array<int>"))

    found = F.flatten(F.transform(F.split(text, ","), values))
    return F.array_distinct(F.transform(found, lambda v: v % 7) if high == 7 else found)


def _seconds(day: Column, seconds: Column | int = 0) -> Column:
    """Seconds of the wall clock since 1970, in no zone."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + seconds


def offsets(zone: str, first: dt.datetime, last: dt.datetime) -> list[tuple[int, int, int]]:
    """(from, until, offset) in seconds since 1970 of the stretches of one offset that make up the zone's time from first to last, in UTC.

    Steps of six hours, halved where the offset changes inside of one. Such a zone that changes and changes back within six hours is not known.
    """
    tz, at = ZoneInfo(zone), int(first.replace(tzinfo=dt.UTC).timestamp())
    end = int(last.replace(tzinfo=dt.UTC).timestamp())
    offset = lambda x: int((_EPOCH + dt.timedelta(seconds=x)).astimezone(tz).utcoffset().total_seconds())
    out, start, own = [], at, offset(at)
    while at < end:
        step = min(at + 21600, end)
        if offset(step) != own:
            low, high = at, step
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == own else (low, middle)
            out.append((start, high, own))
            start, own, step = high, offset(high), high
        at = step
    return [*out, (start, end + 1, own)]


def _instant(local: Column) -> Column:
    """The instant of the wall clock's local seconds: the first one, or the end of the gap that they fall in."""
    there = F.filter("__spans", lambda s: (local >= s["since"] + s["offset"]) & (local < s["until"] + s["offset"]))
    gone = F.filter("__spans", lambda s: s["until"] + s["offset"] <= local)
    return F.coalesce(F.array_min(F.transform(there, lambda s: local - s["offset"])), F.array_max(F.transform(gone, lambda s: s["until"])))


def fires_of(rows: DataFrame, expr: str = "expr", start: str = "start", end: str = "end", tz: str | Column = "UTC") -> DataFrame:
    """rows with fire, once for each moment in [start, end) at which the row's cron expression fires.

    start and end are local dates or times on the wall clock of tz, one zone or a column of them. A local time that is skipped fires at the first
    instant after the gap, however long that is and whenever it begins; one that comes twice fires the first time. The session's zone plays no part.
    Day of month and day of week are alternatives if both are given. Expressions are read where the rows are; one that is none is an error. The
    zones in use are read on the driver, which knows some hundreds, and their changes over the whole span go along with the rows. A row without an expression
    or a zone, or whose start isn't before its end, has no fires. Equal rows count once. Only rows are shuffled, fires are not: two local times give one instant
    only in a gap and at its end, and there a row's first one counts.
    """
    zone = F.lit(tz) if isinstance(tz, str) else tz
    asked = rows.withColumns({"__from": F.col(start).cast("timestamp_ntz"), "__to": F.col(end).cast("timestamp_ntz"), "__tz": zone})
    asked = asked.filter((F.col("__from") < F.col("__to")) & F.col(expr).isNotNull() & F.col("__tz").isNotNull())
    spans = asked.groupBy("__tz").agg(F.min("__from").alias("first"), F.max("__to").alias("last")).collect()  # a row a zone
    day = dt.timedelta(days=3)
    known = [(r["__tz"], offsets(r["__tz"], r["first"] - day, r["last"] + day)) for r in spans]
    gaps = [[(b[0] + a[2], b[0] + b[2]) for a, b in zip(x, x[1:], strict=False) if b[2] > a[2]] for _, x in known]
    zones = rows.sparkSession.createDataFrame([(*x, g) for x, g in zip(known, gaps, strict=True)], "__zone string, __spans array<struct<since:long,until:long,offset:long>>, __gaps array<struct<low:long,high:long>>")
    # a row becomes many, so that a fixed number of tasks is right however small the rows are
    asked = asked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns).distinct()
    asked = asked.join(F.broadcast(zones), F.col("__tz") == F.col("__zone"))

    fields = F.split(F.btrim(F.lower(F.col(expr))), "\\s+")
    five = F.when(F.size(fields) == 5, fields).otherwise(F.raise_error(F.concat(F.lit("a cron expression has five fields: "), F.col(expr))).cast("array<string>"))
    names = ("minute", "hour", "day", "month", "weekday")
    days = asked.withColumn("__five", five).withColumn("__either", (F.get("__five", F.lit(2)) != "*") & (F.get("__five", F.lit(4)) != "*"))
    days = days.withColumns({f"__{x}": _cron_values(F.get("__five", F.lit(i)), *_RANGES[i], _NAMES[i]) for i, x in enumerate(names)})
    days = days.withColumn("__slots", F.flatten(F.transform("__hour", lambda h: F.transform("__minute", lambda m: h * 60 + m))))

    def on(d: Column) -> Column:
        on_day, on_week = F.array_contains(F.col("__day"), F.dayofmonth(d)), F.array_contains(F.col("__weekday"), F.dayofweek(d) - 1)
        return F.array_contains(F.col("__month"), F.month(d)) & F.when(F.col("__either"), on_day | on_week).otherwise(on_day & on_week)

    days = days.withColumn("__d", F.explode(F.sequence(F.to_date("__from"), F.to_date("__to"), F.expr("interval 1 day")))).filter(on(F.col("__d")))
    # days that are far from any change have one offset
    at, margin = _seconds(F.col("__d")), 2 * 86400
    calm = F.filter("__spans", lambda s: (at >= s["since"] + s["offset"] + margin) & (at + 86400 < s["until"] + s["offset"] - margin))
    days = days.withColumn("__calm", F.get(calm, F.lit(0))["offset"])
    local = days.withColumn("__m", F.explode("__slots")).withColumn("__local", F.expr("cast(__d as timestamp_ntz) + make_dt_interval(0, 0, __m, 0)"))
    local = local.filter((F.col("__local") >= F.col("__from")) & (F.col("__local") < F.col("__to"))).withColumn("__s", _seconds(F.col("__d"), F.col("__m") * 60))
    begin = _seconds(F.to_date("__from"), F.hour("__from") * 3600 + F.minute("__from") * 60 + F.expr("extract(second from __from)"))

    def before(gap: Column) -> Column:
        """Another fire of the row lies in the gap."""
        first = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(gap["low"] / 86400).cast("int"))
        other = lambda d, m: (_seconds(d, m * 60) >= gap["low"]) & (_seconds(d, m * 60) < F.col("__s")) & (_seconds(d, m * 60) >= begin)
        return F.exists(F.sequence(first, F.col("__d"), F.expr("interval 1 day")), lambda d: on(d) & F.exists("__slots", lambda m: other(d, m)))

    again = F.exists(F.filter("__gaps", lambda g: F.col("__s").between(g["low"], g["high"])), before)
    found = local.filter(F.col("__calm").isNotNull() | ~again)
    fire = F.when(F.col("__calm").isNotNull(), F.col("__s") - F.col("__calm")).otherwise(_instant(F.col("__s")))
    return found.select(*rows.columns, F.timestamp_seconds(fire).alias("fire"))


def cron_fires(spark: SparkSession, expr: str, start: str, end: str, tz: str = "UTC") -> DataFrame:
    """(fire timestamp) of one expression, which is checked at once, as fires_of has them."""
    parse_cron(expr)
    one = spark.range(1).select(F.lit(expr).alias("expr"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    return fires_of(one, tz=tz).select("fire")


def as_of(times: DataFrame, fires: DataFrame, by: str, time_col: str = "t", fire_col: str = "fire") -> DataFrame:
    """times with last_fire (at or before) and next_fire (after), of the same ``by``.

    Both sides go through one sort by (by, time) over all tasks; there is no range join, and no ``by`` is ever gathered in a task.
    """
    kept = times.columns
    left = times.select(F.col(by).alias("by"), F.col(time_col).alias("t"), F.struct(*kept).alias("row"), F.lit(None).cast(fires.schema[fire_col].dataType).alias("fire"), F.lit(1).alias("kind"))
    right = fires.select(F.col(by).alias("by"), F.col(fire_col).alias("t"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.col(fire_col).alias("fire"), F.lit(0).alias("kind"))
    both = running(left.union(right), ["by"], [F.col("t"), F.col("kind")], {"last_fire": ("last", "fire")}, {"next_fire": ("first", "fire")})
    return both.filter("kind = 1").select("row.*", "last_fire", "next_fire")


def missed_fires(fires: DataFrame, runs: DataFrame, by: str, latest_only: bool = True) -> DataFrame:
    """(by, fire) with no run, manual too, at or after it and before the next fire; only each ``by``'s newest if latest_only.

    With latest_only a fire counts as missed only if no run started after it at all.
    """
    last = runs.groupBy(by).agg(F.max("started_at").alias("__last"))
    if latest_only:
        open_ = fires.join(last, by, "left").filter("__last is null or __last < fire")
        return open_.groupBy(by).agg(F.max("fire").alias("fire"))
    answered = as_of(runs.select(by, F.col("started_at").alias("t")), fires, by).select(by, F.col("last_fire").alias("fire")).filter("fire is not null").distinct()
    return fires.join(answered, [by, "fire"], "left_anti")


def classify_tick(runs: DataFrame, by: str) -> DataFrame:
    """runs with overlapping: an earlier run of the same ``by`` had not finished when it started. Runs of one ``by`` may lie in any number of tasks."""
    kept = runs.select(F.struct(*runs.columns).alias("row"), F.col(by).alias("by"), F.col("started_at").alias("t"), F.col("id").alias("n"), F.col("finished_at").alias("end"))
    before = running(kept, ["by"], [F.col("t"), F.col("n")], {"latest": ("max", "end")})
    return before.select("row.*", F.coalesce(F.col("latest") > F.col("t"), F.lit(False)).alias("overlapping"))


def identify_device(machines: DataFrame, hints: DataFrame) -> DataFrame:
    """(id, machine, model, recognized): the model of the longest hint in the machine string, ties to the smallest; case does not count.

    Without a match, or a machine string, the model is 'default'; an empty hint is in every string. Any number of hints will do: each is known by one of its
    windows of 1, 2, 4, ... code points, the longest such length that it has, and of those windows the one that fewest hints have. Strings
    meet the hints that have one of their windows by an equi-join, and only these are compared.
    """
    size = F.length("hint")
    one = hints.filter("hint is not null").groupBy(F.lower("hint").alias("hint")).agg(F.min("model").alias("model"))
    empty = one.filter(size == 0).select("model").first()
    width = F.pow(F.lit(2), F.floor(F.log2(size.cast("double")))).cast("int")
    one = one.filter(size > 0).withColumn("width", width)
    windows = one.withColumn("window", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("width") + 1), lambda i: F.substring("hint", i, F.col("width")))))
    usual = windows.groupBy("window").agg(F.count("*").alias("n"))
    rare = windows.join(usual, "window").groupBy("hint", "model").agg(F.min_by("window", F.struct("n", "window")).alias("window"))
    widths = sorted(r["width"] for r in one.select("width").distinct().collect())  # a number for each power of two

    named = machines.withColumn("__m", F.lower("machine"))
    texts = named.select("__m").filter("__m is not null").distinct()
    own = F.flatten(F.transform(F.array(*map(F.lit, widths)).cast("array<int>"), lambda w: F.when(w <= F.length("__m"), F.transform(F.sequence(F.lit(1), F.length("__m") - w + 1), lambda i: F.substring("__m", i, w))).otherwise(F.array().cast("array<string>"))))
    asked = texts.select("__m", F.explode(F.array_distinct(own)).alias("window"))
    met = asked.join(rare, "window").filter(F.contains("__m", "hint"))
    best = met.groupBy("__m").agg(F.min(F.struct((-size).alias("n"), "model")).alias("b")).select(F.col("__m").alias("__found"), F.col("b.model").alias("__model"))
    otherwise = F.lit(empty["model"] if empty else None).cast("string")
    model = F.coalesce("__model", F.when(F.col("__m").isNotNull(), otherwise))
    known = F.col("__found").isNotNull() | (F.col("__m").isNotNull() & F.lit(empty is not None))
    return named.join(best, F.col("__m") == F.col("__found"), "left").select("id", "machine", F.coalesce(model, F.lit("default")).alias("model"), known.alias("recognized"))


def resolve_device(live, remembered, default: str = "default"):
    """(model, provenance) from a live reading, else the remembered one, else the default."""
    return F.struct(F.coalesce(live, remembered, F.lit(default)).alias("model"), F.when(live.isNotNull(), "live").when(remembered.isNotNull(), "remembered").otherwise("default").alias("provenance"))
