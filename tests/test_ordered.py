"""As-of neighbours, cost blocks and loosely typed cells against plain Python."""

import json
import random

import pytest

from cuesheet.operators import frames, ordered, relay, scenes
from cuesheet.sources import sinks


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_neighbours(spark, partitions):
    r = random.Random(3)
    points = sorted({(k, r.randrange(40) / 4) for k in ("hot", "b", None) for _ in range(60 if k == "hot" else 3)}, key=repr)
    probes = [(n, r.choice(["hot", "hot", "hot", "b", "c", None]), r.choice([None, *(x / 8 for x in range(-4, 90))])) for n in range(300)]
    p = spark.createDataFrame([(k, x, n) for n, (k, x) in enumerate(points)], "k string, x double, name long")
    q = spark.createDataFrame(probes, "n long, k string, t double")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {x.n: (x.before and (x.before.x, x.before.name), x.after and (x.after.x, x.after.name)) for x in ordered.with_neighbours(q, p, "k", "t", "x").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 300
    for n, k, t in probes:
        mine = [(x, m) for m, (of, x) in enumerate(points) if of == k] if k is not None and t is not None else []
        assert got[n] == (max((x for x in mine if x[0] <= t), default=None), min((x for x in mine if x[0] >= t), default=None))
    assert ordered.with_neighbours(q.limit(0), p, "k", "t", "x").count() == 0
    assert ordered.with_neighbours(q, p.limit(0), "k", "t", "x").where("before is null and after is null").count() == 300


def test_nearest_marker_for_many_probes(spark):
    r = random.Random(4)
    markers = [(a, n, r.randrange(300) / 2) for a in (1, 1, 2) for n in range(20)]
    probes = [(n, r.choice([1, 2, 3]), r.randrange(320) / 4, r.choice([10.0, 200.0, 900.0])) for n in range(200)]
    m = spark.createDataFrame(markers, "asset_id long, pos long, sec double")
    q = spark.createDataFrame(probes, "n long, asset_id long, t double, duration double")
    got = {x.n: (x.pos, x.distance) for x in frames.nearest_marker(m, q).collect()}
    want = {}
    for n, a, t, duration in probes:
        near = min(((abs(sec - t), pos) for b, pos, sec in markers if a == b), default=None)
        if near and near[0] <= max(0.2, duration / 100):
            want[n] = (near[1], near[0])
    assert got == want and len(got) > 20


@pytest.mark.parametrize("video", [True, False])
def test_cost_blocks_equal_the_matrix(spark, video):
    """A matrix that is filled segment by segment, later ones over earlier ones."""
    r = random.Random(6)
    rows, want = [], {}
    n, frames_, per = 23, 12, 4
    for g in range(25):
        matrix = {}
        for pos in range(r.randint(1, 6)):
            first = r.randrange(12)
            seg = (g, pos, r.randrange(12), r.randrange(4), 0.5, first, first + r.randrange(-1, 7))
            rows.append(seg)
            for q in range(n):
                frame = q // per if video else q * frames_ / n
                far = max(abs(frame - seg[2]) - seg[3], 0)
                for k in range(seg[5], seg[6]):
                    matrix[q, k] = far * far / (2 * 0.25)
        want |= {(g, q, k): c for (q, k), c in matrix.items() if c > 0}
    df = spark.createDataFrame(rows, "group_id long, pos long, mid long, win long, sigma double, first long, last long")
    kind = {"tokens_per_frame": per} if video else {"latent_frames": frames_}
    runs = relay.cost_runs(df, n, **kind)
    assert {(x.group_id, x.q, x.k): x.cost for x in relay.token_cost(df, n, **kind).collect()} == pytest.approx(want)
    blocks = [(x.group_id, q, k) for x in runs.collect() for q in range(x.q_first, x.q_last + 1) for k in range(x.k_first, x.k_last + 1)]
    assert len(blocks) == len(set(blocks)) == len(want) and runs.count() < len(want) / 2
    assert relay.cost_runs(df.limit(0), n, **kind).count() == 0


def read_row(line):
    """A row of cells as loosely typed as they come: empty ones keep the default, the first that doesn't convert ends the row."""
    out = [15.0, "", 0, 0.0, -1, -1, 1]
    if isinstance(line, str):
        out[1] = line
    elif isinstance(line, list):
        try:
            for n, (kind, v) in enumerate(zip((float, str, int, float, int, int, int), line, strict=False)):
                if (v is not None) if n == 6 else v:
                    out[n] = kind(v) if n != 1 else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        except (TypeError, ValueError):
            pass
    return tuple(out)


CELLS = ["", "0", "7", " 8 ", "-3", "+2", "1_0", "1__0", "2.5", "1e2", ".5", "5.", "x", "inf", 0, 0.0, 1, -4, 2.75, -2.75, 3e2, None, True, False, [], {}, [1], {"a": 1}, "١"]


def test_cells_of_any_kind(spark):
    r = random.Random(7)
    lines = [[r.choice(CELLS) for _ in range(r.randint(0, 8))] for _ in range(400)]
    lines = [[x if n != 1 or not isinstance(x, (bool, float)) else 5 for n, x in enumerate(line)] for line in lines]
    lines += [[*[""] * n, c] for n in range(7) for c in CELLS if n != 1] + ["bare", "", 3, {"a": 1}, None]
    # digits of other scripts are numbers in Python, not here
    lines = [[("x" if c == "١" and n != 1 else c) for n, c in enumerate(line)] if isinstance(line, list) else line for line in lines]
    got = scenes.parse_scenes_v2(spark.createDataFrame([(json.dumps(lines),)], "json string"), "json").orderBy("seq").collect()
    assert [tuple(x)[1:] for x in got] == [read_row(line) for line in lines]


def test_tables_keep_the_types_of_their_cells(spark):
    t = spark.createDataFrame([(1, 1, "b]", 2.5, None), (1, 0, 'a"\n', -1.0, True), (2, 0, None, None, False)], "k long, pos long, text string, x double, flag boolean")
    got = {x.k: json.loads(x.json) for x in sinks.to_json_table(t, ["k"], "pos", "text", "x", "flag", "pos").collect()}
    assert got == {1: [['a"\n', -1.0, True, 0], ["b]", 2.5, None, 1]], 2: [[None, None, False, 0]]}
