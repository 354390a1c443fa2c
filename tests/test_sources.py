import json
import os
import struct
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docsync_spark.operators import notes
from docsync_spark.sources import files, sinks


def png(path, pixel, n=4):
    raw = b"".join(b"\x00" + b"".join(bytes(pixel(x, y)) for x in range(n)) for y in range(n))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, n, 8, len(pixel(0, 0)) // 4 * 4 + 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_blob_index(spark, tmp_path):
    (tmp_path / "a.idx").write_text("3\nh1:0:a/b.rm:0:12\nshort:line\nh2:0:a/c.rm:1:7\n")
    (tmp_path / "b.idx").write_text("3\nh3:0:x:0:big\nh4:0:y:0:1\n")
    got = [tuple(r) for r in files.read_blob_index(spark, str(tmp_path)).collect()]
    assert sorted(got) == [("a", "h1", "0", "a/b.rm", 0, 12), ("a", "h2", "0", "a/c.rm", 1, 7)]


def test_listing(spark, tmp_path):
    for name, body in {"a": {"visibleName": "A", "lastModified": "1700000000000", "type": "CollectionType"}, "b": {"deleted": True}, "c": {"hash": "hh", "parent": "a"}}.items():
        (tmp_path / f"{name}.metadata").write_text(json.dumps(body))
    (tmp_path / "d.metadata").write_text("{broken")
    got = {r["id"]: r for r in files.read_listing(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "c"} and got["c"]["hash"] == "hh" and got["c"]["name"] == "c" and got["c"]["doc_type"] == "DocumentType" and got["a"]["last_modified"].year == 2023
    assert {r["id"]: r["hash"] for r in files.read_listing(spark, str(tmp_path), "ssh").collect()} == {"a": "1700000000000", "c": "c"}
    assert [r["id"] for r in files.read_listing(spark, str(tmp_path), limit=1).collect()] == ["a"]


def test_many_small_files_go_to_few_tasks(spark, tmp_path):
    bodies = spark.range(300).select(F.format_string("%02x/%d.metadata", F.col("id") % 40, "id").alias("path"), F.lit('{"hash":"x"}').alias("text"))
    sinks.write_notes(bodies.coalesce(1), str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        rows = files.read_listing(spark, f"{tmp_path}/*")
        assert rows.rdd.getNumPartitions() == 16 and sorted(int(r["id"]) for r in rows.collect()) == list(range(300))
        assert files.read_notes(spark, str(tmp_path)).rdd.getNumPartitions() == 16
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_delimited(spark, tmp_path):
    (tmp_path / "x").write_text('===FILE===id1\n{"fileType":"pdf"}\n===FILE===\nid2\nnot json\n')
    docs = files.read_delimited_documents(spark, str(tmp_path / "x"))
    assert {r["id"]: r["file_type"] for r in files.file_types(docs).collect()} == {"id1": "pdf", "id2": None}


def test_archives_and_books(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, body in {"1.xhtml": "<p>one<b>two</b>", "../evil.html": "x", "2.HTML": "<i> three </i><br>", "c.css": "p{}"}.items():
            z.writestr(name, body)
    (tmp_path / "b.zip").write_text("no archive")
    members = files.explode_archives(spark, str(tmp_path / "*.zip"))
    assert {r["member"] for r in members.collect()} == {"1.xhtml", "2.HTML", "c.css"}
    assert {r["member"] for r in files.explode_archives(spark, str(tmp_path / "*.zip"), (".html",)).collect()} == {"2.HTML"}
    assert [r["text"] for r in files.epub_text(members).collect()] == ["one\ntwo\n\nthree"]


def test_notes_in_three_states(spark, tmp_path):
    (tmp_path / "a.md").write_text("é")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    found = files.read_notes(spark, str(tmp_path))
    wanted = found.select("path").union(spark.createDataFrame([("file:/gone",)], "path string"))
    got = {os.path.basename(r["path"]): (r["text"], r["state"]) for r in files.read_notes(spark, str(tmp_path), wanted).collect()}
    assert got == {"a.md": ("é", "text"), "b.md": (None, "unreadable"), "gone": (None, "absent")}


def test_blank_images(spark, tmp_path):
    png(tmp_path / "white.png", lambda x, y: (255, 254, 255))
    png(tmp_path / "ink.png", lambda x, y: (0, 0, 0) if x == y else (255, 255, 255))
    (tmp_path / "bad.png").write_text("no image")
    got = {os.path.basename(r["origin"]): r["blank"] for r in files.scan_blank_images(spark, str(tmp_path)).collect()}
    assert got == {"white.png": True, "ink.png": False, "bad.png": False}
    assert files.is_blank_image(1, 1, 4, bytes([0, 0, 0, 0]))


def test_write_notes(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "one"), ("c.md", "two")], "path string, text string")
    for _ in range(2):
        sinks.write_notes(rows, str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/b.md", "c.md"]
    with pytest.raises(ValueError):
        sinks.write_notes(spark.createDataFrame([("../x", "no")], "path string, text string"), str(tmp_path))


def test_snapshots(spark, tmp_path):
    tables = sinks.StateTables(spark, str(tmp_path))
    assert tables.load("runs") is None
    tables.save("runs", spark.range(3))
    first = tables.load("runs")
    tables.save("runs", first.union(spark.range(2)))
    assert first.count() == 3 and tables.counts(["runs", "none"]) == {"runs": 5}


def test_html_to_text(spark):
    pages = spark.createDataFrame([(1, "<p> a <b>b</b></p>"), (2, None), (3, "")], "id long, html string").withColumn("text", F.lit(1))
    assert {r["id"]: r["text"] for r in files.html_to_text(pages, "html").collect()} == {1: "a\nb", 2: "", 3: ""}


def test_python_holds_few_long_texts_at_once(spark, monkeypatch):
    rows = pa.record_batch({"id": list(range(12)), "text": [*["<p>x</p>" * 40000] * 10, None, "<b>y</b>"]})
    df = spark.createDataFrame([], "id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    for run in (files.html_to_text(df, "text", "out"), notes.extract_blocks(df, ("id",))):
        out = list(run([rows]))
        assert max(len(set(b.column("id").to_pylist())) for b in out) <= 4
        assert {i for b in out for i in b.column("id").to_pylist()} >= {*range(10), 11}


def test_the_driver_keeps_no_record_of_files(spark, tmp_path):
    """Tasks list and read the folders: Spark's index of files, which its driver holds, is not made for them."""
    bodies = spark.range(50).select(F.format_string("%02x/a %d.metadata", F.col("id") % 4, "id").alias("path"), F.lit('{"hash":"x"}').alias("text"))
    sinks.write_notes(bodies, str(tmp_path))
    (tmp_path / "01" / "_hidden.metadata").write_text("{}")
    (tmp_path / "01" / "sub").mkdir()
    (tmp_path / "01" / "sub" / "deep.metadata").write_text("{}")
    (tmp_path / "01" / "b.metadata.gz").write_text('{"hash":"y"}')
    rows = files.read_listing(spark, f"{tmp_path}/*")
    assert rows.inputFiles() == [] and sorted(r["id"] for r in rows.collect()) == sorted([*(f"a {i}" for i in range(50)), "b.metadata"])
    for path, recursive in ((f"{tmp_path}/*", False), (f"{tmp_path}/*/*", False), (f"{tmp_path}/*/a*", False), (str(tmp_path), True)):
        got, want = (sorted(map(tuple, found.collect())) for found in (files._whole_files(spark, path, recursive), files._by_spark(spark, path, recursive, 4)))
        assert got == want and len(got) >= 50
    assert len(list(files._read(iter([pa.record_batch({"path": [f"{tmp_path}/01/b.metadata.gz"] * 5000})])))) == 2
    (tmp_path / "none").mkdir()
    assert files.read_listing(spark, f"{tmp_path}/none").count() == 0
