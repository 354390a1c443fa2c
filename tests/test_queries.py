"""Each registered query against its SQL on the smallest tables, and what their plans must not hold."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from docsync_spark.plans import queries

FOLDER = "/root/testdata/sf0.001"
PYTHON = {"h06_h07_blocks_round_trip", "d14_block_stats", "h03_apply_memoized", "h03_memo_stats", "d14_degradations", "h04_block_diff", "h05_segments_in_sql", "h05_parse_segments", "h04_merge_notes", "h08_build_notes", "e02_claim_names", "a07_html_to_text", "a06_a09_notes"}
#: Without rows on so small a table.
NONE_HERE = {"c11_page_drift", "g05_prune_cache"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert name in PYTHON or "Python" not in plan and "Pandas" not in plan
    assert got or name in NONE_HERE
    if name in queries.SQL:
        out = duck.execute(queries.SQL[name])
        columns = [d[0] for d in out.description]
        assert sorted(columns) == names
        want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in out.fetchall()), key=repr)
        assert got == want
