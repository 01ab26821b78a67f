"""Folders of files: plans that can be carried out, files that are written, edits that are replayed."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesheet.operators import audio, library, scenes, segments
from cuesheet.sources import files, sinks

PLAN = "folder string, action string, old_name string, new_name string"


def carry_out(steps, names):
    """Names after all steps, each of which must find its file and overwrite none; a step's renames in any order."""
    at = {n: n for n in names}
    r = random.Random(1)
    for step in sorted({x.step for x in steps}):
        mine = [x for x in steps if x.step == step]
        r.shuffle(mine)
        for x in mine:
            assert x.old_name in at and (x.new_name is None or x.new_name not in at), x
            file = at.pop(x.old_name)
            if x.action == "rename":
                at[x.new_name] = file
    return {file: n for n, file in at.items()}


def test_renames_overwrite_nothing(spark):
    r = random.Random(2)
    rows, want, have = [], {}, {}
    for folder in ("a", "b", "c", "d"):
        names = [f"{k:03d}" for k in range({"a": 40, "b": 7, "c": 1, "d": 12}[folder])]
        gone = set(names[::9]) if folder in "ad" else set()
        kept = [n for n in names if n not in gone]
        free = [f"{k:03d}" for k in range(len(names), len(names) + 10)] + sorted(gone)
        # one chain through all, circles of all lengths, and names that are new
        new = {"a": r.sample(kept + free, len(kept)), "b": kept[1:] + kept[:1], "c": ["009"], "d": [*kept[1:], "500"]}[folder]
        moved = dict(zip(kept, new, strict=True))
        rows += [(folder, "rename", n, m) for n, m in moved.items()] + [(folder, "delete", n, None) for n in gone]
        want[folder], have[folder] = moved, names
    steps = library.rename_steps(spark.createDataFrame(rows, PLAN).repartition(3)).collect()
    for folder, names in have.items():
        mine = [x for x in steps if x.folder == folder]
        assert carry_out(mine, names) == want[folder]
        assert len([x for x in mine if x.action == "rename"]) <= sum(n != m for n, m in want[folder].items()) + len(names) // 2
    assert library.rename_steps(spark.createDataFrame([], PLAN)).count() == 0
    assert library.rename_steps(spark.createDataFrame([("a", "rename", "x", "x"), ("a", "delete", "y", None)], PLAN).coalesce(1)).count() == 1


def replayed(items, log):
    items = list(items)
    for op, item, step in log:
        k = items.index(item) if item in items else None
        if op == "insert" and k is None:
            items.append(item)
        elif op == "delete" and k is not None and len(items) > 1:
            del items[k]
        elif op == "move" and k is not None and 0 <= k + step < len(items):
            items[k], items[k + step] = items[k + step], items[k]
    return items


@pytest.mark.parametrize("kind", ["long", "string"])
def test_edit_logs(spark, kind):
    r = random.Random(3)
    of = int if kind == "long" else str
    rows, logs, want = [], [], []
    for g in [None, *range(30)]:
        items = [of(x) for x in r.sample(range(50), r.choice([0, 1, 2, 9]))]
        log = [(r.choice(["move", "move", "delete", "insert"]), of(r.randrange(50)) if r.random() < 0.3 else r.choice([*items, of(77)]), r.choice([-1, 1])) for _ in range(r.choice([0, 3, 40]))]
        rows += [(g, pos, x) for pos, x in enumerate(items)]
        logs += [(g, seq, *e) for seq, e in enumerate(log)]
        want += [(g, pos, x) for pos, x in enumerate(replayed(items, log))]
    got = scenes.replay(spark.createDataFrame(rows, f"group_id long, pos long, item {kind}").repartition(3), spark.createDataFrame(logs, f"group_id long, seq long, op string, item {kind}, step int").repartition(2))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_first_names_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([("hot" if k % 10 else "b", f"{k * 7919 % 1000:03d}.mp4") for k in range(1000)], "folder string, name string")
    out = library.listing(df, library.MERGEABLE, most=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    names = sorted(f"{k * 7919 % 1000:03d}.mp4" for k in range(1000) if k % 10)[:4]
    assert [x.name for x in out.where("folder = 'hot'").orderBy("pos").collect()] == names and out.count() == 8


def test_files_are_numbered_on(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = lambda n: spark.createDataFrame([(f, k, bytearray(f"{f}{k}".encode())) for f in ("a", "b") for k in range(n)], "folder string, pos long, content binary")
    assert sorted(map(tuple, sinks.save_numbered(rows(2), root, ".png").collect())) == [(f, k, f"{k:03d}.png") for f in "ab" for k in range(2)]
    os.remove(f"{root}/a/000.png")
    sinks.save_numbered(rows(1), root, ".png", gaps=True)
    assert sorted(os.listdir(f"{root}/a")) == ["000.png", "001.png"] and sorted(os.listdir(f"{root}/b")) == ["000.png", "001.png", "002.png"]
    os.remove(f"{root}/a/000.png")
    with pytest.raises(PySparkException, match="there already"):  # a count of 1, but 001 is there; and nothing is written to b
        sinks.save_numbered(rows(1), root, ".png")
    assert sorted(os.listdir(f"{root}/b")) == ["000.png", "001.png", "002.png"]
    new = spark.createDataFrame([("a", 0, [0.5, -0.5, 2.0])], "folder string, pos long, samples array<float>")
    assert [x.name for x in sinks.save_audio(new, root, 10).collect()] == ["000_audio.wav"]
    got = audio.decode_wav(files.binary_files(spark, root, (".wav",))).first()
    assert got.samples == pytest.approx([0.5, -0.5, 1.0], abs=1e-4)


def test_prompts_are_written(spark, tmp_path):
    p = spark.createDataFrame([("f", "a?", "one"), ("f", "b.TXT", "zwei ü"), ("f", "**", "x"), ("f", "c", " ")], "folder string, name string, content string")
    sinks.save_prompts(library.prompt_file(p), str(tmp_path / "p"))
    assert {n: (tmp_path / "p/f" / n).read_text() for n in os.listdir(tmp_path / "p/f")} == {"a.txt": "one", "b.TXT": "zwei ü"}


def test_folders_that_are_not_there(spark, tmp_path):
    absent = str(tmp_path / "absent")
    assert files.file_listing(spark, absent, library.AUDIO).count() == 0
    with pytest.raises(FileNotFoundError, match="doesn't exist"):
        files.file_listing(spark, absent, library.AUDIO, required=True)
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(FileNotFoundError, match="no file"):
        files.file_listing(spark, str(tmp_path), library.AUDIO, required=True)
    assert [x.name for x in files.file_listing(spark, str(tmp_path), library.TEXTS, required=True).collect()] == ["x.txt"]


def test_paths_are_looked_for(spark):
    there = spark.createDataFrame([("in/a.wav",), ("more/a.wav",), ("/abs/b.wav",), ("more/c.wav",)], "path string")
    asked = spark.createDataFrame([(n, p) for n, p in enumerate(["a.wav", ' "/abs/b.wav" ', "c.wav", "/abs/a.wav", "none.wav", "", None, "c.wav"])], "n long, path string")
    got = {x.n: (x.resolved, x.error) for x in library.resolve_existing(asked, there, ["in", "more/"]).collect()}
    missing = lambda p: (None, f"the file is not found: {p}")
    empty = (None, "the path is empty")
    assert got == {0: ("in/a.wav", None), 1: ("/abs/b.wav", None), 2: ("more/c.wav", None), 3: missing("/abs/a.wav"), 4: missing("none.wav"), 5: empty, 6: empty, 7: ("more/c.wav", None)}


KEYFRAMES = {
    "[1, 2.5, -3]": [1.0, 2.5, 0.0],
    '["4", " 1e1 ", true, false]': [4.0, 10.0, 1.0, 0.0],
    '{"keyframes": [0.5]}': [0.5],
    '{"other": [1]}': [],
    "[]": [],
    "": [],
    "  ": [],
    '[1, "x"]': "a keyframe is no number",
    "[null]": "a keyframe is no number",
    "[[1]]": "a keyframe is no number",
    "5": "the keyframes are no list",
    "null": "the keyframes are no list",
    '{"keyframes": null}': "the keyframes are no list",
    "[1,": "the keyframes are no JSON",
}


def test_keyframes_that_are_none(spark):
    df = spark.createDataFrame([(k,) for k in [*KEYFRAMES, None]], "json string")
    told = {x.json: x.p for x in df.select("json", scenes.keyframe_problem(F.col("json")).alias("p")).collect()}
    assert told == {**{k: v if isinstance(v, str) else None for k, v in KEYFRAMES.items()}, None: None}
    for text, want in KEYFRAMES.items():
        one = spark.createDataFrame([(text,)], "json string")
        if isinstance(want, str):
            with pytest.raises(PySparkException, match=want):
                scenes.parse_keyframes(one, "json").collect()
        else:
            assert [x.sec for x in scenes.parse_keyframes(one, "json").orderBy("pos").collect()] == want
    assert [x.sec for x in scenes.parse_keyframes(spark.createDataFrame([('[1, "x", null, 2]',)], "json string"), "json", strict=False).orderBy("pos").collect()] == [1.0, 2.0]


def test_assets_without_segments_are_whole(spark):
    windows = spark.createDataFrame([(1, 1, 5, 9, 41)], "asset_id long, idx long, first_sample long, end_sample long, frames long")
    assets = spark.createDataFrame([(1, 100), (2, 70)], "asset_id long, n_samples long")
    assert sorted(map(tuple, segments.whole_or_windows(windows, assets, 3).collect())) == [(1, 1, 5, 9, 41), (2, 0, 0, 70, 3)]
