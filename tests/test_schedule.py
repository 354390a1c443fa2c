import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from pyspark.sql import functions as F

from docsync_spark.operators import scan, schedule


def expected(minute, hour, start, end, zone):
    """Fires of 'minute hour * * *' by the standard library."""
    out, tz, day = set(), ZoneInfo(zone), start
    while day < end:
        local = dt.datetime(day.year, day.month, day.day, hour, minute)
        utc = local.replace(tzinfo=tz, fold=0).astimezone(dt.UTC)
        while utc.astimezone(tz).replace(tzinfo=None) > local:  # skipped: back to the first instant after the gap
            before = (utc - dt.timedelta(minutes=1)).astimezone(tz)
            if before.replace(tzinfo=None) < local:
                break
            utc -= dt.timedelta(minutes=1)
        out.add(utc.replace(tzinfo=None))
        day += dt.timedelta(days=1)
    return out


@pytest.mark.parametrize("minute,hour", [(30, 2), (0, 2), (59, 1), (0, 3), (30, 3)])
@pytest.mark.parametrize("zone,start", [("Pacific/Apia", dt.date(2011, 12, 28)), ("America/St_Johns", dt.date(2010, 3, 12)), ("Australia/Lord_Howe", dt.date(2026, 10, 2)), ("Europe/Madrid", dt.date(2026, 3, 27)), ("Europe/Madrid", dt.date(2026, 10, 23)), ("America/New_York", dt.date(2026, 3, 6))])
def test_clock_changes(spark, minute, hour, zone, start):
    end = start + dt.timedelta(days=4)
    got = schedule.cron_fires(spark, f"{minute} {hour} * * *", str(start), str(end), zone).selectExpr("cast(fire as timestamp_ntz) as fire").collect()
    assert {r["fire"] for r in got} == expected(minute, hour, start, end, zone)


def test_fields():
    assert schedule.parse_cron("*/20 1-3 1,15 jan-feb sun,7")[4] == {0}
    for bad in ("* * * *", "61 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedule.parse_cron(bad)


def test_day_of_month_or_week(spark):
    got = schedule.cron_fires(spark, "0 0 13 * fri", "2024-09-01", "2024-10-01").collect()
    assert sorted(r["fire"].day for r in got) == [6, 13, 20, 27]


def test_as_of_at_the_same_moment(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    times = spark.createDataFrame([("a", t(9)), ("a", t(8)), ("b", t(9))], "k string, t timestamp_ntz")
    fires = spark.createDataFrame([("a", t(9)), ("a", t(10))], "k string, fire timestamp_ntz")
    got = {(r["k"], r["t"].hour): (r["last_fire"], r["next_fire"]) for r in schedule.as_of(times, fires, "k").collect()}
    assert got == {("a", 9): (t(9), t(10)), ("a", 8): (None, t(9)), ("b", 9): (None, None)}


def test_fires_of_gaps_that_begin_off_the_hour_or_last_a_day(spark):
    at = lambda zone, expr, day: [r["fire"] for r in schedule.cron_fires(spark, expr, day, f"{day[:8]}{int(day[8:]) + 1:02}", zone).selectExpr("cast(fire as timestamp_ntz) as fire").collect()]
    assert at("Pacific/Apia", "15 10 * * *", "2011-12-30") == [dt.datetime(2011, 12, 30, 10)]
    assert at("America/St_Johns", "30 0 * * *", "2010-03-14") == [dt.datetime(2010, 3, 14, 3, 31)]
    assert at("Australia/Lord_Howe", "10 2 * * *", "2024-10-06") == [dt.datetime(2024, 10, 5, 15, 30)]


def test_the_sessions_zone_plays_no_part(spark):
    rows = spark.createDataFrame([("30 2 * * *", "2024-03-30", "2024-04-02", z) for z in ("Europe/Madrid", "UTC", "Asia/Kathmandu", None)] + [(None, "2024-03-30", "2024-04-02", "UTC"), ("0 0 * * *", "2024-03-30", "2024-03-30", "UTC")], "expr string, start string, end string, zone string")
    fires = lambda: sorted((r["zone"], r["at"]) for r in schedule.fires_of(rows, tz=rows["zone"]).selectExpr("zone", "unix_seconds(fire) as at").collect())
    first = fires()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert fires() == first
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert ("Europe/Madrid", int(dt.datetime(2024, 3, 31, 1, tzinfo=dt.UTC).timestamp())) in first and len(first) == 9


def test_many_expressions_and_ones_that_are_none(spark):
    exprs = [f"{m} {h} {d} * *" for m in range(60) for h in range(24) for d in range(1, 9)]  # more than go to a driver
    rows = spark.createDataFrame([(e, "2024-01-01", "2024-01-09") for e in exprs], "expr string, start string, end string")
    got = schedule.fires_of(rows)
    assert got.count() == len(exprs)
    names = ["*/20 1-3 1,15 jan-feb sun,7", "0 0 1 */3 mon-fri/2", "5/20 * * * 0", "59 23 31 dec sat"]
    for e in names:
        want = schedule.parse_cron(e)
        row = spark.createDataFrame([(e,)], "e string").select(*[schedule._cron_values(schedule.F.split("e", " ")[i], *schedule._RANGES[i], schedule._NAMES[i]).alias(f"f{i}") for i in range(5)]).first()
        assert [set(x) for x in row] == want
    for bad in ("* * * *", "61 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(Exception, match="cron"):
            schedule.fires_of(spark.createDataFrame([(bad, "2024-01-01", "2024-01-02")], "expr string, start string, end string")).collect()


def brute_running(rows):
    """rows (by, t, v): the last value before, the first after and the largest before, in the order of (by, t)."""
    out = []
    for by, t, v in rows:
        before = sorted((r for r in rows if r[0] == by and r[1] < t), key=lambda r: r[1])
        after = sorted((r for r in rows if r[0] == by and r[1] > t), key=lambda r: r[1])
        known = [r[2] for r in before if r[2] is not None]
        out.append((by, t, v, known[-1] if known else None, next((r[2] for r in after if r[2] is not None), None), max(known, default=None)))
    return sorted(out, key=repr)


def test_running_values_of_a_key_that_holds_most_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), t, rng.choice([None, None, rng.randint(0, 99)])) for t in range(600)]
    rows += [("quiet", t, None) for t in range(600, 700)]  # a key without any value
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, v int")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        out = scan.running(df, ["k"], [schedule.F.col("t")], {"last": ("last", "v"), "most": ("max", "v")}, {"next": ("first", "v")})
        assert sorted((tuple(r) for r in out.select("k", "t", "v", "last", "next", "most").collect()), key=repr) == brute_running(rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    # windows go by task and key, but for those over what each task's first and last key add up to
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert len(windows) == 3 or all("__part" in x or "__sum_" in x for x in windows)
    assert all("__part" in x for x in windows if "__sum_" not in x)
    folder = max((f for f in out.inputFiles()), key=len).rpartition("/")[0]
    per_file = spark.read.parquet(folder).filter("k = 'hot'").groupBy(schedule.F.shiftright("__at", 33)).count().collect()
    assert len(per_file) >= 5 and max(r["count"] for r in per_file) < 300


def test_running_values_of_no_rows(spark):
    assert scan.running(spark.createDataFrame([], "k string, t int, v int"), ["k"], [schedule.F.col("t")], {"last": ("last", "v")}).collect() == []


def test_hints_against_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abÉ-") for _ in range(n))
    for empty in (False, True):
        hints = [(word(rng.randint(1, 6)), f"m{rng.randint(0, 9)}") for _ in range(60)] + [(None, "m0"), ("AB", "m9"), ("ab", "m1")] + [("", "any")] * empty
        machines = [(i, word(rng.randint(0, 12))) for i in range(80)] + [(900, None), (901, ""), (5, "ab"), (5, "ab")]
        got = schedule.identify_device(spark.createDataFrame(machines, "id int, machine string"), spark.createDataFrame(hints, "hint string, model string"))
        want = []
        for i, m in machines:
            met = [(-len(h), model) for h, model in hints if h is not None and m is not None and h.lower() in m.lower()]
            want.append((i, m, min(met)[1] if met else "default", bool(met)))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hundred_thousand_hints_without_a_nested_loop(spark):
    hints = spark.range(100_000).selectExpr("format_string('device-%06d', id) as hint", "concat('model', id % 1000) as model")
    machines = spark.range(300).selectExpr("id", "concat('the DEVICE-', lpad(id * 331, 6, '0'), ' at home') as machine")
    got = schedule.identify_device(machines, hints)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r["id"], r["model"]) for r in got.collect()} == {(i, f"model{i * 331 % 1000}") for i in range(300)}


def test_fires_are_not_shuffled_and_come_once_in_a_gap(spark):
    """Kiritimati and Apia skipped whole days: fires of the day before and of the gap, at its end once."""
    rows = spark.createDataFrame([(1, "*/30 * * * *", "Pacific/Apia", "2011-12-29", "2012-01-01"), (1, "*/30 * * * *", "Pacific/Apia", "2011-12-29", "2012-01-01"), (2, "0 12 * * *", "Pacific/Apia", "2011-12-30 11:00:00.5", "2012-01-01"),
                                  (3, "0,15,30 2,3 * * *", "Europe/Madrid", "2024-03-31 02:10:00", "2024-04-01"), (4, "30 2 * * *", "Europe/Madrid", "2024-10-27", "2024-10-28")], "id int, expr string, zone string, start string, end string")
    made = schedule.fires_of(rows, tz=rows["zone"]).select("id", F.unix_seconds("fire").alias("at"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") > plan.rindex("Generate") and plan.count("Exchange hashpartitioning") == 1
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got))
    assert sum(i == 1 for i, _ in got) == 96  # two days that there were
    assert [i for i, _ in got if i > 1].count(2) == 2
    assert sorted(at for i, at in got if i == 3) == [1711846800 + 900 * k for k in range(3)]
    assert [at for i, at in got if i == 4] == [1729989000]
