"""WAV files read by ranges, and files written in two phases."""

import os
import random
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from cuesheet.operators import audio
from cuesheet.sources import file_sink, files, wav


def write(path, data, rate=100, width=2, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)


@pytest.fixture
def folder(tmp_path):
    r = random.Random(4)
    out = tmp_path / "wavs"
    out.mkdir()
    for k, (width, channels, n) in enumerate([(1, 1, 999), (2, 2, 3000), (3, 1, 501), (4, 3, 100), (2, 1, 1)]):
        write(out / f"{k}.wav", r.randbytes(width * channels * n), 100 + k, width, channels)
    (out / "note.txt").write_text("x")
    return out


@pytest.mark.parametrize("split", [97, 1 << 26])
def test_parts_give_all_samples_once(spark, folder, split):
    got = wav.read_wav(spark, str(folder), splitBytes=split).orderBy("path", "sample_idx").toPandas()
    want = audio.decode_wav(files.binary_files(spark, str(folder), (".wav",))).orderBy("path").collect()
    assert got.path.nunique() == len(want) == 5
    for x in want:
        mine = got[got.path == x.path.removeprefix("file:")]
        assert mine.sample_idx.tolist() == list(range(x.n_samples)) and mine.value.tolist() == x.samples
        assert (mine.second == mine.sample_idx / x.sample_rate).all() and set(mine.sample_rate) == {x.sample_rate}
    every = wav.read_wav(spark, str(folder / "1.wav"), mono=False, splitBytes=split)
    assert every.count() == 6000 and every.where("channel = 1 and sample_idx = 7").count() == 1


def test_filters_are_pushed_and_exact(spark, folder):
    all_ = wav.read_wav(spark, f"file://{folder}", splitBytes=500, mono=False)
    kept = spark.createDataFrame(all_.collect(), all_.schema)
    for cond in ("second >= 1.5 and second < 2.25", "sample_idx > 10 and sample_idx <= 12", "sample_idx = 40 and channel = 0", "second > 1e9", "value > 0.5 and second < 0.5", f"path = 'file://{folder}/3.wav' and second >= 0.3"):
        plan = all_.where(cond)._jdf.queryExecution().executedPlan().toString()
        assert " Filter " not in plan or "value" in cond, plan
        want = sorted(map(tuple, kept.where(cond).collect()))
        assert sorted(map(tuple, wav.read_wav(spark, f"file://{folder}", splitBytes=500, mono=False).where(cond).collect())) == want


class Counting:
    """A file system that counts the bytes read."""

    def __init__(self, system):
        self.system, self.bytes = system, 0

    def __getattr__(self, name):
        return getattr(self.system, name)

    def open_input_file(self, path):
        f, outer = self.system.open_input_file(path), self

        class File:
            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

            def seek(self, at):
                f.seek(at)

            def read(self, n):
                outer.bytes += n
                return f.read(n)

        return File()


def test_only_bytes_asked_for_are_read(tmp_path, monkeypatch):
    write(tmp_path / "long.wav", bytes(2_000_000), rate=1000)
    write(tmp_path / "other.wav", bytes(2_000_000), rate=1000)
    system = Counting(pa.fs.LocalFileSystem())
    monkeypatch.setattr(wav, "located", lambda uri: (system, uri))

    def rows(filters, **options):
        system.bytes = 0
        reader = wav.WavReader({"path": str(tmp_path), "splitBytes": "100000", **options})
        left = list(reader.pushFilters(filters))
        parts = reader.partitions()
        return sum(b.num_rows for p in parts for b in reader.read(p)), left, parts

    heads = lambda parts: 100 * len(parts)  # noqa: E731 - what is read of each part's file to find its samples
    n, left, parts = rows([])
    assert n == 2_000_000 and system.bytes >= 4_000_000 and len(parts) == 42
    n, left, parts = rows([GreaterThanOrEqual(("second",), 500.0), LessThan(("second",), 500.1), StringContains(("path",), "x")])
    assert n == 200 and system.bytes <= 2 * 2 * 104 + heads(parts) and [type(f) for f in left] == [StringContains]
    n, left, parts = rows([In(("path",), (f"{tmp_path}/long.wav", "elsewhere")), EqualTo(("sample_idx",), 7)])
    assert n == 1 and system.bytes <= 8 + heads(parts) and len(parts) == 21 and not left
    n, left, parts = rows([], start="999.5", duration="3")
    assert n == 1000 and system.bytes <= 2000 + heads(parts)


def test_trimmed_reads(spark, folder):
    read = lambda **o: sorted(x.sample_idx for x in wav.read_wav(spark, str(folder / "0.wav"), **o).collect())
    assert read(start=1.239, duration=0.5) == list(range(123, 173))
    assert read(start=9.5, duration=5) == list(range(950, 999)) and read(start=9.5) == list(range(950, 999)) and read(start=-1, duration=0.02) == [0, 1]
    with pytest.raises(PySparkException, match="no samples are left"):
        read(start=50)


def test_files_that_are_none(spark, tmp_path):
    (tmp_path / "bad.wav").write_bytes(b"RIFF0000WAVEjunk")
    (tmp_path / "empty.wav").write_bytes(b"")
    write(tmp_path / "none.wav", b"")
    with pytest.raises(PySparkException, match="no (WAV file|samples)"):
        wav.read_wav(spark, str(tmp_path)).collect()
    assert wav.read_wav(spark, str(tmp_path), invalid="skip").count() == 0
    with pytest.raises(PySparkException):
        wav.read_wav(spark, str(tmp_path / "absent")).collect()
    # a chunk of odd length before the samples, a size that the file doesn't reach, and an extended header
    body = b"WAVE" + b"LIST\x03\0\0\0abc\0" + b"fmt \x10\0\0\0" + np.array([0xFFFE, 1], "<u2").tobytes() + np.array([100, 200], "<u4").tobytes() + np.array([2, 16], "<u2").tobytes() + b"data\xff\xff\xff\0" + b"\0\x40" * 5 + b"\1"
    (tmp_path / "odd.wav").write_bytes(b"RIFF" + len(body).to_bytes(4, "little") + body)
    assert [x.value for x in wav.read_wav(spark, str(tmp_path / "odd.wav")).collect()] == [0.5] * 5


def names(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_files_are_written_as_one(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{k % 3}", f"{k:03d}.bin", bytearray([k] * k)) for k in range(20)], "folder string, name string, content binary").repartition(4)
    file_sink.write_files(rows, out)
    assert names(out) == sorted(f"f{k % 3}/{k:03d}.bin" for k in range(20))
    assert all(open(f"{out}/f{k % 3}/{k:03d}.bin", "rb").read() == bytes([k] * k) for k in range(20))
    with pytest.raises(PySparkException, match="there already"):
        file_sink.write_files(rows.limit(1), out)
    file_sink.write_files(rows.where("name = '005.bin'").withColumn("content", F.lit(b"new")), out, overwrite=True)
    assert open(f"{out}/f2/005.bin", "rb").read() == b"new" and len(names(out)) == 20


def test_failed_tasks_leave_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    fail = F.when(F.col("id") == 17, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.format_string("%03d.bin", "id"))
    rows = spark.range(20).repartition(4).select(fail.alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(PySparkException, match="killed"):
        file_sink.write_files(rows, out)
    assert not os.path.isdir(out) or names(out) == []
    for bad in ("../x", "a/../b", "", ".hidden", "/abs"):
        with pytest.raises(PySparkException, match="no name"):
            file_sink.write_files(spark.createDataFrame([(bad, bytearray(b"x"))], "name string, content binary"), out)
    with pytest.raises(PySparkException, match="two files|Exists"):
        file_sink.write_files(spark.range(4).repartition(4).select(F.lit("same").alias("name"), F.lit(b"x").alias("content")), out)
    assert not os.path.isdir(out) or names(out) == []


def test_a_move_that_fails_is_undone(tmp_path, monkeypatch):
    writer = file_sink.FileWriter(str(tmp_path), ["name", "content"], False)
    staged = tmp_path / writer.staging.rsplit("/", 1)[1] / "0-0"
    staged.mkdir(parents=True)
    for n in "abc":
        (staged / n).write_text(n)
    local, moved = pa.fs.LocalFileSystem(), []

    class Failing:
        def __getattr__(self, name):
            return getattr(local, name)

        def move(self, a, b):
            moved.append(b)
            if len(moved) == 3:
                raise OSError("disk")
            local.move(a, b)

    monkeypatch.setattr(file_sink, "located", lambda uri: (Failing(), uri))
    with pytest.raises(OSError, match="disk"):
        writer.commit([file_sink.Staged("0-0", 3)])
    assert sorted(p.name for p in staged.iterdir()) == ["a", "b", "c"]
    writer.abort([])
    assert list(tmp_path.iterdir()) == []


def test_short_files_share_tasks(tmp_path):
    for k in range(40):
        write(tmp_path / f"{k:02d}.wav", bytes(60), rate=100)
    write(tmp_path / "long.wav", bytes(3 * wav.OPEN_BYTES * 10), rate=100)
    reader = wav.WavReader({"path": str(tmp_path), "splitBytes": str(10 * wav.OPEN_BYTES + 2000)})
    tasks = reader.partitions()
    assert sorted(len(t.parts) for t in tasks) == [1, 1, 1, 10, 10, 10, 10]  # one task for each file before
    batches = [b for t in tasks for b in reader.read(t)]
    assert sum(b.num_rows for b in batches) == 40 * 30 + 3 * wav.OPEN_BYTES * 5
    short = [list(reader.read(t)) for t in tasks if len(t.parts) > 1]
    assert all(len(some) == 1 for some in short) and len({p for some in short for p in some[0].column("path").to_pylist()}) == 40


def test_many_files_are_placed_with_few_looks(spark, tmp_path, monkeypatch):
    """One listing for each folder, not a look and a folder made for each file."""
    writer = file_sink.FileWriter(str(tmp_path), ["folder", "name", "content"], False)
    staged = tmp_path / writer.staging.rsplit("/", 1)[1] / "0-0" / "f"
    staged.mkdir(parents=True)
    for n in range(50):
        (staged / f"{n}.bin").write_text(str(n))
    local, calls = pa.fs.LocalFileSystem(), []

    class Watched:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(local, name)

    monkeypatch.setattr(file_sink, "located", lambda uri: (Watched(), uri))
    writer.commit([file_sink.Staged("0-0", 50)])
    assert sorted(int(p.stem) for p in (tmp_path / "f").iterdir()) == list(range(50))
    assert calls.count("move") == 50 and len(calls) < 60
