"""Numbers of a stream of files against one that is handled event by event."""

import random

import pytest

from cuesheet.operators import library
from cuesheet.streaming import numbering, windows

EVENTS = "folder string, seq long, kind string, name string"


def one_by_one(events):
    used, out = {}, []
    for folder, seq, kind, name in sorted(events, key=lambda e: e[1]):
        mine = used.setdefault(folder, set())
        if kind == "upload":
            k = 0
            while k in mine:
                k += 1
            out.append((folder, seq, name, k))
            mine.add(k)
        else:
            digits = name[: len(name) - len(name.lstrip("0123456789"))]
            if digits:
                mine.add(int(digits))
    return sorted(out)


def some_events(n=160):
    r = random.Random(5)
    names = lambda: r.choice([f"{r.randrange(40):03d}_x.png", "cover.png", f"{r.randrange(9)}", "99999999999999999999999.png", "32768.png"])
    return [(r.choice(["hot", "hot", "hot", "b", "c"]), seq, *(("upload", "new.png") if r.random() < 0.4 else ("file", names()))) for seq in range(n)]


@pytest.mark.parametrize("cuts", [[], [40, 41, 90]])
def test_any_split_gives_the_same_numbers(spark, tmp_path, cuts):
    events = some_events()
    bounds = [0, *cuts, len(events)]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        spark.createDataFrame(events[a:b], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = numbering.numbered_uploads(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == one_by_one(events)
    assert windows.read_stream(spark, str(tmp_path / "in" / "part0"), spark.createDataFrame(events, EVENTS).schema).isStreaming


def test_tables_get_the_same_numbers(spark):
    """Files first, then uploads: by state, and by the order of free numbers."""
    events = sorted(some_events(), key=lambda e: e[2] == "upload")
    events = [(folder, seq, kind, name) for seq, (folder, _, kind, name) in enumerate(events)]
    df = spark.createDataFrame(events, EVENTS)
    want = one_by_one(events)
    assert sorted(map(tuple, numbering.numbered_uploads(df).collect())) == want
    new = df.where("kind = 'upload'").selectExpr("folder", "seq as pos", "name")
    got = library.free_numbers(df.where("kind = 'file'"), new)
    assert sorted((x.folder, x.pos, x.name, x.number) for x in got.collect()) == want
    assert library.free_numbers(df.limit(0), new.limit(0)).count() == 0
    assert sorted(x.number for x in library.free_numbers(df.limit(0), new.where("folder = 'hot'")).collect()) == list(range(new.where("folder = 'hot'").count()))


def test_full_blocks_are_left_behind():
    """The state, as maps, over more numbers than a block has."""

    class Map(dict):
        containsKey = dict.__contains__  # noqa: N815
        getValue = dict.__getitem__  # noqa: N815
        updateValue = dict.__setitem__  # noqa: N815

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    p = numbering.Numbering()
    p.blocks, p.first = Map(), Value()
    for k in range(numbering.BLOCK + 3):
        if k != 7:
            bits = p._bits(k // numbering.BLOCK)
            bits[k % numbering.BLOCK] = 1
            p.blocks[(k // numbering.BLOCK,)] = (numbering.np.packbits(bits).tobytes(),)
    assert p._next() == 7 and not p.first.exists()
    p._mark(7)
    assert p._next() == numbering.BLOCK + 3 and p.first.get() == (1,)
