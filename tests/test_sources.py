"""Folders of files, sinks and streams."""

import datetime
import os
import struct
import wave
import zlib

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import audio, library
from cuesheet.sources import files, shared, sinks
from cuesheet.streaming import windows


def test_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("b.txt", " two \n"), ("a.TXT", "one"), ("c.png", "x")):
        (tmp_path / "in" / name).write_text(body)
    with wave.open(str(tmp_path / "in" / "d.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(100)
        w.writeframes(b"\x00\x40\x00\x00" * 5)
    found = files.file_listing(spark, str(tmp_path / "in"), library.TEXTS)
    assert sorted(r.name for r in found.collect()) == ["a.TXT", "b.txt"]
    assert sorted((r.name, r.text) for r in files.text_files(spark, str(tmp_path / "in")).collect()) == [("a.TXT", "one"), ("b.txt", "two")]
    got = audio.decode_wav(files.binary_files(spark, str(tmp_path / "in"), library.AUDIO)).first()
    assert (got.sample_rate, got.n_samples, got.samples) == (100, 5, [0.25] * 5)
    rel = spark.createDataFrame([("file:/x/in/sub\\a.wav",)], "path string").select(files.relative_path("path", "/x/in")).first()[0]
    assert rel == "sub/a.wav"


def png(width, rows):
    """A picture of red, green and blue bytes as PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b"")


def test_pictures_as_rgb(spark, tmp_path):
    (tmp_path / "p.png").write_bytes(png(2, [[255, 0, 51, 0, 102, 0], [1, 2, 3, 4, 5, 6]]))
    (tmp_path / "q.png").write_bytes(b"no picture")
    got = files.rgb(files.images(spark, str(tmp_path))).collect()
    assert len(got) == 1 and (got[0].height, got[0].width) == (2, 2)
    assert got[0].pixels == pytest.approx([x / 255 for x in (255, 0, 51, 0, 102, 0, 1, 2, 3, 4, 5, 6)])
    odd = spark.createDataFrame([(bytearray(b"\x33"), 1), (bytearray(b"\1\2\3\xff"), 4), (None, 3)], "data binary, n_channels int")
    assert [r.pixels for r in files.rgb(odd).collect()] == [pytest.approx([0.2] * 3), pytest.approx([3 / 255, 2 / 255, 1 / 255]), None]


def test_rows_are_numbered_within_groups(spark):
    df = spark.range(3000).selectExpr("id", "hash(id) % 7 as h", "if(id % 3 = 0, null, string(id % 2)) as s").repartition(5)
    got = sorted((r.s or "", r.pos, r.h) for r in shared.numbered(df, ["s", "h"], within="s").collect())
    want = {}
    for k, pos, h in got:
        assert pos == want.setdefault(k, [0, -9])[0] and h >= want[k][1]
        want[k] = [pos + 1, h]
    assert shared.numbered(df.limit(0), "h").count() == 0


def test_intermediate_tables_are_removed(spark):
    before = len(shared._PATHS)
    table = shared.cut(spark.range(5), "x")
    path = shared._PATHS[table]
    assert os.path.isdir(path) and len(shared._PATHS) == before + 1
    shared.discard(table)
    assert not os.path.exists(path)
    other = shared.cut(spark.range(5), "x")
    path = shared._PATHS[other]
    shared.release(spark)
    assert not os.path.exists(path)


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("a.txt", "one"), (None, "no")], "saved_as string, content string")
    sinks.write_prompts(p, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["one"]
    t = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "k long, pos long, text string")
    assert sinks.to_json_table(t, ["k"], "pos", "text").first().json == '[["a"],["b"]]'


def test_stream_equals_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=17 * i), i % 3, float(i - 20)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = windows.windowed_peaks(windows.read_stream(spark, str(tmp_path / "events"), events.schema), late="2 days")
    run = stream.writeStream.format("memory").queryName("peaks").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination(120)
    got = sorted(map(tuple, spark.table("peaks").collect()))
    assert got == sorted(map(tuple, windows.windowed_peaks(events).collect())) and got
    assert sum(r[2] for r in got) == events.agg(F.count("*")).first()[0]
