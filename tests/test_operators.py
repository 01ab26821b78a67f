"""Worked examples, and small models of sequential rules."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cuesheet.functions import scalars
from cuesheet.operators import audio, frames, geometry, library, relay, scenes, segments, timeline
from cuesheet.sources import shared


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def built(spark, total, secs, **kw):
    assets = spark.createDataFrame([(1, float(total))], "asset_id long, total double")
    markers = spark.createDataFrame([(1, i, float(s), float(total)) for i, s in enumerate(secs)], "asset_id long, pos long, sec double, total double")
    return segments.build_segments(assets, markers, **kw)


def test_markers_become_segments(spark):
    got = rows(built(spark, 10, [5.0, 5.0004, 2.5, 99]), "s", "e")
    assert got == [(0.0, 2.5), (2.5, 5.0), (5.0, 9.999)]


def test_nothing_left_is_the_whole(spark):
    assert rows(built(spark, 10, [], skip_first=True), "s", "e") == [(0.0, 10.0)]


def test_average_split(spark):
    x, walk = 0.3, [0.3]
    while x + 0.1 < 7.0:
        x += 0.1
        walk.append(x)
    got = spark.createDataFrame([(0.3, 7.0), (2.0, 2.0), (3.0, 1.0)], "a double, b double").select(segments.cut_points(0.1)(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [[*walk, 7.0], [2.0], [3.0]]
    assert rows(built(spark, 10, [], step=4), "s", "e") == [(0.0, 4.0), (4.0, 8.0), (8.0, 10.0)]
    assert built(spark, 10, [], step=0.1).count() == 101  # repeated addition


def test_frame_plan(spark):
    ends = [15.3, 25.3, 30.0]
    s = spark.createDataFrame([(1, i + 1, a, b) for i, (a, b) in enumerate(zip([0.0, *ends], ends))], "asset_id long, idx long, s double, e double")
    assert [r[1:] for r in rows(segments.frame_plan(s), "idx", "aligned", "frames", "start")] == [(360, 361, 0.0), (240, 241, 15.0), (120, 121, 25.0)]


def test_loops(spark):
    one = spark.range(1)
    assert one.select(segments.loops_v1(F.lit(10), F.lit(5), F.lit(7))).first()[0] == 5
    c = spark.createDataFrame([(0, 5)], "scene_n long, audio_n long")
    assert rows(segments.loop_window(c, F.lit(False), F.lit(1), F.lit(0)), "start", "loops") == [(1, 4)]


def test_scenes(spark):
    j = '[[0,"x",0,0,0,0,0],[3,"x","bad",1.5,2],"bare"]'
    got = rows(scenes.parse_scenes_v2(spark.createDataFrame([(1, j), (2, "no json"), (3, '{"a":1}'), (4, None)], "k long, j string"), "j", "k"), "k", "seq", "audio_duration", "prompt", "audio_idx", "audio_start", "image_idx", "tail_pos", "transition")
    assert got == [(1, 1, 15.0, "x", 0, 0.0, -1, -1, 0), (1, 2, 3.0, "x", 0, 0.0, -1, -1, 1), (1, 3, 15.0, "bare", 0, 0.0, -1, -1, 1)]


def test_timeline(spark):
    r = spark.createDataFrame([(1, 0, 0.0, 2.5, "a"), (1, 1, 2.5, 5.0, "b"), (1, 2, 5.2, 6.0, "")], "scene_idx long, seq long, start_s double, end_s double, prompt string")
    got = timeline.assemble(timeline.timeline_segments(r)).first()
    assert (got.timed_text, got.total_frames) == ("[0-60]:a\n[61-120]:b", 120)


def test_timeline_rows_keep_what_comes_before_a_bad_field(spark):
    import json

    names = list(scenes.TIMELINE_FIELDS.values())
    cases = [[3, 1, 2.5, "a"], ["3", "1.5", True, "b"], [3.9, "x", 2, "c"], [None, 1, 2, "d"], ["2.5", 1, 2, "e"], [1, 2, "1e1", 5], [1]]
    made = [dict(zip(names, c, strict=False)) for c in cases] + ["bare", [1, 2], 7]
    got = rows(scenes.parse_timeline(spark.createDataFrame([(1, json.dumps(made)), (2, "no json"), (3, "[]"), (4, None)], "k long, j string"), "j", "k"), "seq", "row_idx", "start_s", "end_s", "prompt")
    none = (0, 0.0, 15.0, "")
    assert [r[1:] for r in got] == [(3, 1.0, 2.5, "a"), (3, 1.5, 1.0, "b"), (3, 0.0, 15.0, ""), none, none, (1, 2.0, 10.0, "5"), (1, 0.0, 15.0, ""), none, none, none]


def test_token_costs(spark):
    """All pairs, one by one; later segments win where ranges overlap."""
    segs = [(0, 7, 2, 1.5, 2, 5), (1, 20, 1, 1.5, 4, 6), (2, 28, 0, 1.5, 6, 6)]
    df = spark.createDataFrame([(9, *s) for s in segs], "group_id long, pos long, mid long, win long, sigma double, first long, last long")
    for kw, frame in (({"tokens_per_frame": 3}, lambda q: q // 3), ({"latent_frames": 31}, lambda q: q * 31 / 40)):
        want = {}
        for _, mid, win, sigma, first, last in segs:
            for q in range(40):
                for k in range(first, last):
                    want[q, k] = max(0.0, abs(frame(q) - mid) - win) ** 2 / (2 * sigma**2)
        got = {(r.q, r.k): r.cost for r in relay.token_cost(df, 40, **kw).collect()}
        assert got == pytest.approx({k: v for k, v in want.items() if v > 0})


def test_listings_and_orders(spark):
    f = spark.createDataFrame([("b", "2.PNG"), ("b", "1.jpg"), ("a\\c", "x.wav"), ("a", "y.WAV"), ("a", "no"), (None, "z.jpg")], "folder string, name string")
    assert rows(library.listing(f, library.IMAGES).where("folder is not null"), "folder", "pos", "name") == [("b", 0, "1.jpg"), ("b", 1, "2.PNG")]
    assert library.listing(f, library.IMAGES).where("folder is null").first().pos == 0
    assert rows(library.deep_listing(f, library.AUDIO_SEGMENTS), "pos", "path") == [(0, "a/c/x.wav"), (1, "a/y.WAV")]
    assert library.listing(f.limit(0), library.IMAGES).count() == 0
    o = spark.createDataFrame([(x, i) for i, x in enumerate("dxbax")], "k string, pos long")
    e = spark.createDataFrame([(x,) for x in "abdz"], "k string")
    assert sorted(library.ordered_existing(o, e, "k").select("pos", "k").collect()) == [(0, "d"), (1, "b"), (2, "a")]
    assert rows(library.existing_but(e, o, "k"), "k") == [("z",)]


def lengths(spark, values):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "group_id long, pos long, length long")


def test_shares(spark):
    got = relay.largest_remainder(lengths(spark, [120, 60, 61]), 8, 31)
    assert [r[1] for r in rows(got, "pos", "share")] == [15, 8, 8]
    windows = relay.segment_windows(got)
    assert [r[1:] for r in rows(windows, "pos", "mid", "win")] == [(7, 5), (19, 2), (27, 2)]
    cost = relay.temporal_cost(windows, 31).where("frame = 14 and pos = 0").first().cost
    assert cost == pytest.approx(4 / (2 * relay.sigma_of(1e-3) ** 2))
    assert [r[1] for r in rows(relay.budget_clamp(lengths(spark, [10, 10, 10]), 25), "pos", "effective")] == [10, 10, 5]


def test_min_one_equals_its_loop(spark):
    r = random.Random(4)
    groups = {g: [r.choice([0, 0, 1, 2, 5, 9]) for _ in range(r.randint(1, 8))] for g in range(60)}
    df = spark.createDataFrame([(g, i, 7, s) for g, v in groups.items() for i, s in enumerate(v)], "group_id long, pos long, length long, share long")
    got = {(a, b): c for a, b, c in rows(relay.min_one(df), "group_id", "pos", "share")}
    for g, v in groups.items():
        want = list(v)
        for i in range(len(want)):
            if want[i] < 1 and max(want) > 1:
                want[want.index(max(want))] -= 1
                want[i] = 1
        assert [got[g, i] for i in range(len(v))] == want


def test_token_ranges_need_tokens(spark):
    df = spark.createDataFrame([(1, 0, " ", 2)], "group_id long, pos long, prompt string, global_n long")
    with pytest.raises(PySparkException):
        relay.token_ranges(df).collect()


def test_library(spark):
    f = spark.createDataFrame([("d", x) for x in ("000.png", "001.png", "003.png")], "folder string, name string")
    assert library.next_number_mex(f).first().next_number == 2
    e = spark.createDataFrame([("d", x) for x in ("a.png", "b.png", "c.png")], "folder string, name string")
    o = spark.createDataFrame([("d", i, x) for i, x in enumerate(["c.png", "x.png", "a.png"])], "folder string, pos long, name string")
    assert rows(library.reconcile_plan(e, o), "action", "old_name", "new_name") == [("delete", "b.png", None), ("rename", "a.png", "001.png"), ("rename", "c.png", "000.png")]
    assert spark.range(1).select(scalars.numbered_name(F.lit(0), F.lit("007_song.mp3"))).first()[0] == "000_song.mp3"
    assert spark.range(1).select(scalars.pad3(F.lit(1234))).first()[0] == "1234"
    assert spark.range(1).select(scalars.within(F.lit("/a"), F.lit("/ab")), scalars.within(F.lit("/a"), F.lit("/a/b")), scalars.within(F.lit("/a"), F.lit("/a/../b"))).first()[:] == (False, True, False)


def test_frames(spark):
    f = spark.createDataFrame([(1, i) for i in range(10)], "seq_id long, frame_idx long")
    assert [r[0] for r in rows(frames.frame_range(f, -1, -2), "frame_idx")] == [7, 8, 9]
    assert frames.without_tail(f, 12).count() == 0


def test_geometry(spark):
    s = spark.createDataFrame([(1920, 1080)], "w long, h long")
    assert rows(geometry.fit_max_side(s, 980, 32), "scaled_w", "scaled_h", "crop_w", "crop_h") == [(980, 551, 960, 544)]
    assert rows(geometry.downscale_even(spark.createDataFrame([(101, 50)], "w long, h long"), 2), "small_w", "small_h") == [(50, 26)]
    with pytest.raises(ValueError):
        geometry.downscale_even(s, 0)


def test_wav_round_trip(spark):
    df = spark.createDataFrame([("p", [0.0, 0.5, -1.0])], "path string, samples array<float>")
    wav = audio.encode_wav(df, rate=8000).select("path", F.col("wav").alias("content"))
    broken = spark.createDataFrame([("q", bytearray(b"RIFF"))], "path string, content binary")
    got = audio.decode_wav(wav.union(broken)).collect()
    assert len(got) == 1 and got[0].sample_rate == 8000
    assert got[0].samples == pytest.approx([0.0, 0.5, -1.0], abs=1e-3)
    assert audio.decode_pcm(b"\xff\xff\xff\x00\x00\x40", 3).tolist() == pytest.approx([-1 / 8388608, 0.5])


def test_costs_are_listed_once_for_all_rows(spark):
    """Rounded or not as row by row before, also for windows far from all frames; no row works its cost out."""
    rows = [(1, 0, 3, 1, 0), (1, 1, 7, 6, 1), (2, 0, 1, 90, 3)]
    windows = spark.createDataFrame(rows, "group_id long, pos long, share long, mid long, win long").withColumn("sigma", F.lit(relay.sigma_of(1e-3)))
    for places in (None, 6):
        out = relay.temporal_cost(windows, 10, places=places)
        got = {(r.group_id, r.pos, r.frame): r.cost for r in out.collect()}
        assert len(got) == 30
        for g, pos, _, mid, win in rows:
            for frame in range(10):
                far = max(abs(frame - mid) - win, 0.0)
                want = far * far / (2 * relay.sigma_of(1e-3) * relay.sigma_of(1e-3))
                assert got[g, pos, frame] == (want if places is None else pytest.approx(want, abs=5.1e-7))
    plan = relay.temporal_cost(windows, 10, places=6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("round(") <= 1  # the windows that are too far


def test_segments_are_dealt_by_rows(spark, monkeypatch):
    """Spark merges small partitions into one task, however many rows a task should get."""
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    assets = spark.range(600).selectExpr("id as asset_id", "id % 5 * 10d as total").repartition(3)
    markers = assets.selectExpr("asset_id", "0L as pos", "3d as sec", "total")
    out = segments.build_segments(assets, markers)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 600 + 480 and max(sizes) < 250
    n = assets.selectExpr("asset_id", "cast(total as long) as n_samples")
    windows = segments.sample_window(segments.frame_plan(out.where("asset_id % 3 <> 0")).join(n, "asset_id"), 100)
    whole = segments.whole_or_windows(windows, n)
    assert whole.where("idx = 0").count() == 200 == whole.where("asset_id % 3 = 0 and idx = 0 and first_sample = 0 and frames = 1").count()
