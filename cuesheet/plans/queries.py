"""The planning queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.functions import scalars
from cuesheet.operators import audio, frames, geometry, library, relay, scenes, segments, timeline, tokens
from cuesheet.plans import tables as t
from cuesheet.sources import sinks, wav
from cuesheet.sources.shared import cut, numbered, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_ASSETS = "a AS (SELECT user_id AS asset_id, min(epoch_us(ts)) AS t0, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS total FROM events GROUP BY 1)"
_MARKERS = _ASSETS + """, m AS (SELECT user_id AS asset_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, (epoch_us(ts) - t0) / 1e6 AS sec, total
  FROM events JOIN a ON user_id = asset_id WHERE event_type = 'purchase'),
c AS (SELECT asset_id, pos, greatest(least(sec, total - 0.001::DOUBLE), 0::DOUBLE) AS sec, total FROM m),
d AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, round_even(sec * 1000, 0) ORDER BY pos) AS r FROM c) WHERE r = 1),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY sec, pos) AS n FROM d) WHERE n <= 64)"""
_SEGMENTS = _MARKERS + """, p AS (SELECT asset_id, sec FROM k UNION ALL SELECT asset_id, 0::DOUBLE FROM a UNION ALL SELECT asset_id, greatest(total, 0) FROM a),
i0 AS (SELECT asset_id, sec AS s, lead(sec) OVER (PARTITION BY asset_id ORDER BY sec) AS e FROM p),
i AS (SELECT asset_id, s, e, row_number() OVER (PARTITION BY asset_id ORDER BY s) AS idx, count(*) OVER (PARTITION BY asset_id) AS n FROM i0 WHERE e > s)"""
#: As the query segments_trimmed has it: the first segment is skipped, the tail stays unless it is short.
_TRIMMED = _SEGMENTS + """, g0 AS (SELECT asset_id, s, e FROM i WHERE idx >= {low} AND idx <= n{high} AND NOT (idx = n{high} AND e - s < 0.1::DOUBLE)),
g1 AS (SELECT asset_id, s, e FROM g0 UNION ALL SELECT asset_id, 0::DOUBLE, greatest(total, 0) FROM a WHERE asset_id NOT IN (SELECT asset_id FROM g0)),
g AS (SELECT asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY s) AS idx, s, e FROM g1)"""
_BUILT = _TRIMMED.format(low=1, high="")
_PLAN = _BUILT + """, f0 AS (SELECT *, e - s AS d, floor(trunc((e - s) * 24) / 8) * 8 AS al FROM g),
f1 AS (SELECT *, trunc(sum(d) OVER (PARTITION BY asset_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 24) - sum(al) OVER (PARTITION BY asset_id) AS missing,
  count(*) OVER (PARTITION BY asset_id) AS n FROM f0),
f2 AS (SELECT asset_id, idx, n, d, CASE WHEN idx = n THEN CASE WHEN al + missing <= 0 THEN 0 ELSE ceil((al + missing) / 8) * 8 END ELSE al END AS aligned FROM f1),
plan AS (SELECT asset_id, idx, CASE WHEN idx = n THEN aligned / 24 ELSE d END AS d, aligned::BIGINT AS aligned, (aligned + 1)::BIGINT AS frames,
  coalesce(sum(aligned) OVER (PARTITION BY asset_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 24 AS start FROM f2)"""


def _built(spark: SparkSession, d: str, skip_first: bool = False, keep_tail: bool = True, step: float | None = None) -> DataFrame:
    return segments.build_segments(t.assets(spark, d), t.markers(spark, d), skip_first, keep_tail, step)


# segments ------------------------------------------------------------------


@query(f"WITH {_MARKERS} SELECT asset_id, pos, sec FROM d")
def marker_dedup(spark: SparkSession, d: str) -> DataFrame:
    return segments.dedup_markers(t.markers(spark, d)).select("asset_id", "pos", "sec")


@query(f"WITH {_MARKERS} SELECT asset_id, n, sec FROM k")
def marker_top64(spark: SparkSession, d: str) -> DataFrame:
    return segments.first_markers(segments.dedup_markers(t.markers(spark, d))).select("asset_id", "n", "sec")


@query(f"WITH {_SEGMENTS} SELECT asset_id, idx, s, e, n FROM i")
def intervals(spark: SparkSession, d: str) -> DataFrame:
    kept = segments.first_markers(segments.dedup_markers(t.markers(spark, d)))
    return segments.intervals(t.assets(spark, d), kept).select("asset_id", "idx", "s", "e", "n")


@query(f"WITH {_TRIMMED.format(low=2, high=' - 1')} SELECT asset_id, idx, s, e FROM g")
def segments_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d, skip_first=True, keep_tail=False)


@query(f"""WITH RECURSIVE {_BUILT}, span AS (SELECT asset_id, min(s) AS a0, max(e) AS b0 FROM g GROUP BY 1),
w AS (SELECT asset_id, a0 AS s, least(a0 + 7200.0::DOUBLE, b0) AS e, 1 AS idx, b0 FROM span UNION ALL SELECT asset_id, e, least(e + 7200.0::DOUBLE, b0), idx + 1, b0 FROM w WHERE e < b0)
SELECT asset_id, idx::BIGINT AS idx, s, e FROM w""")
def average_split(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d, step=7200.0)


@query(f"WITH {_PLAN} SELECT asset_id, idx, d, aligned, frames, start FROM plan")
def segment_frame_plan(spark: SparkSession, d: str) -> DataFrame:
    return segments.frame_plan(_built(spark, d))


@query(f"""WITH {_PLAN}, n AS (SELECT asset_id, (trunc(total * 100))::BIGINT AS n_samples FROM a),
x AS (SELECT asset_id, idx, d, n_samples, least(trunc(start * 100)::BIGINT, n_samples) AS first_sample FROM plan JOIN n USING (asset_id))
SELECT asset_id, idx, first_sample, least(first_sample + trunc((d + 0.5::DOUBLE) * 100)::BIGINT, n_samples) AS end_sample FROM x""")
def sample_window(spark: SparkSession, d: str) -> DataFrame:
    n = t.assets(spark, d).select("asset_id", scalars.truncated(F.col("total") * 100).alias("n_samples"))
    return segments.sample_window(segments.frame_plan(_built(spark, d)).join(n, "asset_id"), 100).select("asset_id", "idx", "first_sample", "end_sample")


@query(f"""WITH {_BUILT}, x AS (SELECT asset_id, string_agg(round_even(e - s, 0)::BIGINT::VARCHAR, chr(10) ORDER BY idx) AS durations_text, count(*) AS n,
  coalesce(sum((floor((e - s) * 24 / 8) * 8)::BIGINT) FILTER (idx <= 2), 0)::BIGINT AS start_frames FROM g GROUP BY 1)
SELECT asset_id, durations_text, greatest(1, CASE WHEN 7 < n - 2 THEN 5 ELSE n - 2 END)::BIGINT AS loops, start_frames, start_frames / 24 AS start_s FROM x""")
def segment_select_v1(spark: SparkSession, d: str) -> DataFrame:
    return segments.select_v1(_built(spark, d), start=2, end=7)


@query(f"WITH {_BUILT} SELECT asset_id, idx, round_even(e - s, 2) AS duration FROM g")
def segment_durations_v2(spark: SparkSession, d: str) -> DataFrame:
    return segments.durations_v2(_built(spark, d)).select("asset_id", "idx", "duration")


@query("""WITH c AS (SELECT o_custkey, count(*) AS audio_n, count(*) FILTER (o_orderstatus = 'F') AS scene_n FROM orders GROUP BY 1),
x AS (SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 THEN scene_n ELSE audio_n END AS n, o_custkey % 5 AS s0, o_custkey % 7 AS e0 FROM c),
y AS (SELECT *, CASE WHEN n > 0 THEN greatest(0, least(s0, n - 1)) ELSE 0 END AS start FROM x)
SELECT o_custkey, n, start::BIGINT AS start, CASE WHEN n > 0 THEN greatest(0, CASE WHEN e0 = 0 THEN n ELSE e0 END - start) ELSE 0 END::BIGINT AS loops FROM y""")
def loop_window(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("audio_n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("scene_n"))
    k = F.col("o_custkey")
    return segments.loop_window(c, k % 2 == 0, k % 5, k % 7).select("o_custkey", "n", "start", "loops")


@query(f"""WITH {_PLAN}, z AS (SELECT asset_id, (trunc(total * 100))::BIGINT AS n_samples FROM a),
x AS (SELECT asset_id, idx, d, frames, n_samples, least(trunc(start * 100)::BIGINT, n_samples) AS first_sample FROM plan JOIN z USING (asset_id) WHERE asset_id % 3 <> 0)
SELECT asset_id, idx, first_sample, least(first_sample + trunc((d + 0.5::DOUBLE) * 100)::BIGINT, n_samples) AS end_sample, frames FROM x
UNION ALL SELECT asset_id, 0, 0, n_samples, 1 FROM z WHERE asset_id % 3 = 0""")
def segment_audio(spark: SparkSession, d: str) -> DataFrame:
    """The samples of each segment, and all of them for a third of the assets, which have no segments."""
    n = t.assets(spark, d).select("asset_id", scalars.truncated(F.col("total") * 100).alias("n_samples"))
    plan = segments.frame_plan(_built(spark, d).where("asset_id % 3 <> 0"))
    return segments.whole_or_windows(segments.sample_window(plan.join(n, "asset_id"), 100), n)


_SOUND = """s AS (SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS number, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx,
  trunc(greatest(least(((value - 200 * floor(value / 200)) / 100 - 1)::FLOAT, 1), -1) * 32767::FLOAT) / 32768 AS value FROM events)"""


@query(f"WITH {_SOUND} SELECT number, sample_idx, sample_idx / 100.0::DOUBLE AS second, value::DOUBLE AS value FROM s WHERE sample_idx < 30 AND sample_idx >= 12")
def saved_audio(spark: SparkSession, d: str) -> DataFrame:
    """Each user's values as a numbered WAV file in the shared folder, and a part of every file, read by its seconds."""
    value = F.col("value") - 200 * F.floor(F.col("value") / 200)
    sound = t.samples(spark, d).withColumn("value", (value / 100 - 1).cast("float"))
    whole = sound.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("x"))
    rows = numbered(whole.select("asset_id", F.transform("x", lambda r: r["value"]).alias("samples")), "asset_id").select(F.lit("sound").alias("folder"), "pos", "samples")
    path = scratch(spark, "audio")
    sinks.save_audio(rows, path, 100)
    read = wav.read_wav(spark, f"{path}/sound", duration=0.3).where("second >= 0.12")
    number = scalars.leading_number(F.element_at(F.split("path", "/"), -1))
    return read.select(number.alias("number"), "sample_idx", "second", F.col("value").cast("double").alias("value"))


# JSON tables and lookups ---------------------------------------------------


def _json_scenes(spark: SparkSession, d: str) -> DataFrame:
    """A scene table as JSON for each conversation: rows of fields, and bare prompts for every third turn."""
    c = t.table(spark, d, "conversations")
    row = F.concat(F.lit("["), (F.col("turn") * 2.5).cast("string"), F.lit(","), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(","), (F.col("turn") - 1).cast("string"), F.lit(",0.5,"), (F.col("turn") % 3).cast("string"), F.lit("]"))
    text = F.to_json(F.array("text"))
    bare = text.substr(F.lit(2), F.length(text) - 2)
    cell = F.when(F.col("turn") % 3 == 2, bare).otherwise(row)
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("x")).select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["cell"]), ","), F.lit("]")).alias("json"))


_SEQ = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq"


@query(f"""SELECT conv_id, {_SEQ}, CASE WHEN turn % 3 = 2 THEN 5.0 ELSE turn * 2.5 END::DOUBLE AS duration, text AS prompt, CASE WHEN turn % 3 = 2 THEN 0 ELSE turn - 1 END::BIGINT AS audio_idx,
  CASE WHEN turn % 3 = 2 THEN -1 ELSE 0 END::BIGINT AS image_idx, CASE WHEN turn % 3 = 2 THEN -1 ELSE turn % 3 END::BIGINT AS tail_pos, 1::BIGINT AS transition FROM conversations""")
def scene_parse_v1(spark: SparkSession, d: str) -> DataFrame:
    return scenes.parse_scenes_v1(_json_scenes(spark, d), "json", "conv_id")


@query(f"""SELECT conv_id, {_SEQ}, CASE WHEN turn % 3 = 2 OR turn = 0 THEN 15.0 ELSE turn * 2.5 END::DOUBLE AS audio_duration, text AS prompt,
  CASE WHEN turn % 3 = 2 THEN 0 ELSE turn - 1 END::BIGINT AS audio_idx, CASE WHEN turn % 3 = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS audio_start,
  CASE WHEN turn % 3 = 1 THEN 1 ELSE -1 END::BIGINT AS image_idx, -1::BIGINT AS tail_pos, 1::BIGINT AS transition FROM conversations""")
def scene_parse_v2(spark: SparkSession, d: str) -> DataFrame:
    return scenes.parse_scenes_v2(_json_scenes(spark, d), "json", "conv_id")


_CELLS = {
    0: '["", {text}, 2, 0.5, 3, 4, 0]',
    1: '["7", {text}, "0", "0", "0", "0", "0"]',
    2: '[null, false, [], {{}}, "", 0, ""]',
    3: '[" 2.5 ", 12, 3.9, true, "5", -2.7, false]',
    4: '["x", {text}, 2, 0.5, 3, 4, 0]',
    5: '[1e1, {text}, "1.5", 9, 9, 9, 9]',
    6: '{{"a": 1}}',
    7: '[3, {text}, 1, "1e-1", [4], 5]',
}


@query(f"""SELECT conv_id, {_SEQ}, [15.0, 7.0, 15.0, 2.5, 15.0, 10.0, 15.0, 3.0][turn % 8 + 1]::DOUBLE AS audio_duration, CASE WHEN turn % 8 IN (2, 4, 6) THEN '' WHEN turn % 8 = 3 THEN '12' ELSE text END AS prompt,
  [2, 0, 0, 3, 0, 0, 0, 1][turn % 8 + 1]::BIGINT AS audio_idx, [0.5, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.1][turn % 8 + 1]::DOUBLE AS audio_start, [3, 0, -1, 5, -1, -1, -1, -1][turn % 8 + 1]::BIGINT AS image_idx,
  [4, 0, -1, -2, -1, -1, -1, -1][turn % 8 + 1]::BIGINT AS tail_pos, [0, 0, 1, 0, 1, 1, 1, 1][turn % 8 + 1]::BIGINT AS transition FROM conversations""")
def scene_parse_cells(spark: SparkSession, d: str) -> DataFrame:
    """Blank cells, numbers as text, cells of the wrong kind, and rows that are no arrays."""
    text = F.to_json(F.array("text"))
    bare = text.substr(F.lit(2), F.length(text) - 2)
    cell = F.lit(None).cast("string")
    for k, line in _CELLS.items():
        parts = line.replace("{{", "{").replace("}}", "}").split("{text}")
        cell = F.when(F.col("turn") % 8 == k, F.concat(F.lit(parts[0]), *(x for p in parts[1:] for x in (bare, F.lit(p))))).otherwise(cell)
    c = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("x"))
    return scenes.parse_scenes_v2(c.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["cell"]), ","), F.lit("]")).alias("json")), "json", "conv_id")


@query(ORACLES["scene_parse_v2"])
def scene_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Scenes written as a JSON table and read again."""
    fields = ("audio_duration", "prompt", "audio_idx", "audio_start", "image_idx", "tail_pos", "transition")
    return scenes.parse_scenes_v2(sinks.to_json_table(scene_parse_v2(spark, d), ["conv_id"], "seq", *fields), "json", "conv_id")


@query(f"SELECT conv_id, {_SEQ}, text AS prompt FROM conversations")
def prompt_parse(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return scenes.parse_prompts(c.select("conv_id", F.to_json(F.transform("x", lambda r: r["text"])).alias("json")), "json", "conv_id")


@query("SELECT event_id, 0::BIGINT AS pos, json_extract(props, '$.k')::DOUBLE AS sec FROM events WHERE json_extract(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, 1, 0.0 FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def keyframe_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    e = t.table(spark, d, "events").where(k.isNotNull()).select("event_id", F.concat(F.lit('{"keyframes":['), k, F.lit(",-"), k, F.lit("]}")).alias("json"))
    return scenes.parse_keyframes(e, "json", "event_id")


@query(f"""SELECT conv_id, {_SEQ}, CASE turn % 5 WHEN 2 THEN 0 WHEN 4 THEN 0 WHEN 1 THEN 7 ELSE turn END::BIGINT AS row_idx, CASE WHEN turn % 5 IN (2, 4) THEN 0.0 WHEN turn % 5 = 1 THEN 1.5 ELSE turn * 2.5 END::DOUBLE AS start_s,
  CASE turn % 5 WHEN 0 THEN (turn + 1) * 2.5 ELSE 15.0 END::DOUBLE AS end_s, CASE WHEN turn % 5 IN (0, 1) THEN text ELSE '' END AS prompt FROM conversations""")
def timeline_parse(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows, numbers as text, a bad number at the front, one in the middle, and elements that are no objects."""
    name = scenes.TIMELINE_FIELDS
    text = F.to_json(F.array("text"))
    field = lambda key, value: F.concat(F.lit(f'"{name[key]}":'), value.cast("string"))
    prompt = field("prompt", text.substr(F.lit(2), F.length(text) - 2))
    row = lambda *fields: F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    k, two = F.col("turn"), F.col("turn") * 2.5
    cell = (
        F.when(k % 5 == 0, row(field("row_idx", k), field("start_s", two), field("end_s", (k + 1) * 2.5), prompt))
        .when(k % 5 == 1, row(field("start_s", F.lit('" 1.5 "')), field("row_idx", F.lit('"7"')), prompt))
        .when(k % 5 == 2, row(field("row_idx", F.lit('"x"')), field("start_s", two), prompt))
        .when(k % 5 == 3, row(field("row_idx", k), field("start_s", two), field("end_s", F.lit("null")), prompt))
        .otherwise(F.lit('"bare"'))
    )
    c = t.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("x"))
    return scenes.parse_timeline(c.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda r: r["cell"]), ","), F.lit("]")).alias("json")), "json", "conv_id")


@query("""WITH n AS (SELECT DISTINCT conv_id FROM conversations), w AS (SELECT conv_id, i AS asked, i % 4 AS j FROM n, range(0, 9) r(i)), r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations)
SELECT w.conv_id, asked, j AS row_idx, 'p' || coalesce(text, '') || 's' AS prompt FROM w LEFT JOIN r ON w.conv_id = r.conv_id AND j = pos""")
def text_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Plain prompts by row, used again every four rows."""
    rows = prompt_parse(spark, d).withColumn("pos", F.col("seq") - 1)
    wanted = t.table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("asked"))
    got = scenes.lookup_row(wanted.withColumn("i", scenes.reduced(F.col("asked"), F.lit(4))), rows, {"prompt": ""}, ("conv_id",))
    return scenes.with_affixes(got, "p", "s").select("conv_id", "asked", F.col("i").alias("row_idx"), "prompt")


def _scene_rows(spark: SparkSession, d: str) -> DataFrame:
    s = scenes.parse_scenes_v2(_json_scenes(spark, d), "json", "conv_id")
    return s.withColumn("pos", F.col("seq") - 1)


_LOOKUP = """n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), w AS (SELECT conv_id, i, i % 3 AS j FROM n, range(0, 10) r(i)),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, text FROM conversations)"""


@query(f"""WITH {_LOOKUP} SELECT w.conv_id, i AS asked, j AS row_idx, 'p' || coalesce(text, '') || 's' AS prompt, CASE WHEN turn IS NULL THEN j WHEN turn % 3 = 2 THEN 0 WHEN turn - 1 < 0 THEN j ELSE turn - 1 END::BIGINT AS audio_idx,
  CASE WHEN turn IS NULL OR turn % 3 = 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS audio_start, CASE WHEN turn IS NULL OR turn % 3 = 2 OR turn = 0 THEN 15.0 ELSE turn * 2.5 END::DOUBLE AS audio_duration,
  CASE WHEN turn % 3 = 1 THEN 1 ELSE j END::BIGINT AS image_idx, -1::BIGINT AS tail_pos, true AS transition FROM w LEFT JOIN r ON w.conv_id = r.conv_id AND j = pos""")
def scene_lookup_v2(spark: SparkSession, d: str) -> DataFrame:
    rows = _scene_rows(spark, d)
    wanted = t.table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("asked"))
    wanted = wanted.withColumn("i", scenes.reduced(F.col("asked"), F.lit(3)))
    got = scenes.lookup_row(wanted, rows, {"prompt": "", "audio_idx": -1, "audio_start": 0.0, "audio_duration": 15.0, "image_idx": -1, "tail_pos": -1, "transition": 1}, ("conv_id",))
    return scenes.with_affixes(got, "p", "s").select(
        "conv_id", "asked", F.col("i").alias("row_idx"), "prompt", scenes.or_own(F.col("audio_idx").cast("long"), F.col("i")).alias("audio_idx"), "audio_start", "audio_duration",
        scenes.or_own(F.col("image_idx").cast("long"), F.col("i")).alias("image_idx"), F.col("tail_pos").cast("long").alias("tail_pos"), (F.col("transition") == 1).alias("transition"),
    )


@query(f"""WITH {_LOOKUP} SELECT w.conv_id, i AS row_idx, CASE WHEN turn IS NULL THEN 15.0 WHEN turn % 3 = 2 THEN 5.0 ELSE turn * 2.5 END::DOUBLE AS duration, 'p' || coalesce(text, '') || 's' AS prompt,
  CASE WHEN turn IS NULL THEN i WHEN turn % 3 = 2 THEN 0 ELSE turn - 1 END::BIGINT AS audio_idx, CASE WHEN turn IS NULL OR turn % 3 = 2 THEN i ELSE 0 END::BIGINT AS image_idx,
  CASE WHEN turn IS NULL OR turn % 3 = 2 THEN -1 ELSE turn % 3 END::BIGINT AS tail_pos, true AS transition FROM w LEFT JOIN r ON w.conv_id = r.conv_id AND i = pos""")
def scene_lookup_v1(spark: SparkSession, d: str) -> DataFrame:
    rows = scenes.parse_scenes_v1(_json_scenes(spark, d), "json", "conv_id").withColumn("pos", F.col("seq") - 1)
    wanted = t.table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("i"))
    got = scenes.lookup_row(wanted, rows, {"duration": 15.0, "prompt": "", "audio_idx": -99, "image_idx": -1, "tail_pos": -1, "transition": 1}, ("conv_id",))
    own_audio = F.when(F.col("found"), F.col("audio_idx")).otherwise(F.col("i")).cast("long")
    return scenes.with_affixes(got, "p", "s").select("conv_id", F.col("i").alias("row_idx"), "duration", "prompt", own_audio.alias("audio_idx"), scenes.or_own(F.col("image_idx").cast("long"), F.col("i")).alias("image_idx"), F.col("tail_pos").cast("long").alias("tail_pos"), (F.col("transition") == 1).alias("transition"))


@query("""WITH f AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id, count(*) OVER () AS n FROM benchmark)
SELECT o_orderkey, o_custkey, item_id FROM orders JOIN f ON o_custkey % n = pos""")
def wrap_lookup(spark: SparkSession, d: str) -> DataFrame:
    files = numbered(t.table(spark, d, "benchmark").select("item_id"), "item_id")
    return scenes.wrap_lookup(t.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("i")), files).select("o_orderkey", "o_custkey", "item_id")


@query("""WITH f AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey FROM part) SELECT s_suppkey, p_partkey FROM supplier JOIN f ON s_suppkey % 7 = pos""")
def strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    files = numbered(t.table(spark, d, "part").select("p_partkey"), "p_partkey")
    return scenes.strict_lookup(t.table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("i")), files).select("s_suppkey", "p_partkey")


@query("SELECT conv_id, CASE WHEN n > 2 AND p = 1 THEN 2 WHEN n > 2 AND p = 2 THEN 1 ELSE p END::BIGINT AS pos, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def move_row(spark: SparkSession, d: str) -> DataFrame:
    return scenes.move_row(_turns(spark, d), 1, 1, "conv_id").select("conv_id", "pos", "turn")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS pos, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE p <> 0 OR n = 1")
def delete_row(spark: SparkSession, d: str) -> DataFrame:
    return scenes.delete_row(_turns(spark, d), 0, "conv_id").select("conv_id", "pos", "turn")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.table(spark, d, "conversations").select("conv_id", "turn", pos.cast("long").alias("pos"))


_LOG = """e AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE (conv_id + turn) % 4 WHEN 2 THEN 'delete' WHEN 3 THEN 'insert' ELSE 'move' END AS op,
  CASE WHEN (conv_id + turn) % 4 = 3 THEN 100 + turn % 2 ELSE (turn * 5 + conv_id) % 8 END AS item, CASE (conv_id + turn) % 4 WHEN 0 THEN -1 ELSE 1 END AS step FROM conversations)"""


@query(f"""WITH RECURSIVE {_LOG}, n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
r AS (SELECT conv_id, list(turn ORDER BY turn) AS l, 0::BIGINT AS k FROM conversations GROUP BY 1 UNION ALL
  SELECT r.conv_id, CASE WHEN op = 'insert' AND NOT list_contains(l, item) THEN list_append(l, item) WHEN op = 'delete' AND list_contains(l, item) AND len(l) > 1 THEN list_filter(l, lambda x: x <> item)
    WHEN op = 'move' AND list_contains(l, item) AND list_position(l, item) + step BETWEEN 1 AND len(l)
      THEN list_transform(l, lambda x, i: CASE WHEN i = list_position(l, item) THEN l[i + step] WHEN i = list_position(l, item) + step THEN item ELSE x END) ELSE l END, r.k + 1
  FROM r JOIN e ON e.conv_id = r.conv_id AND e.k = r.k + 1)
SELECT conv_id, unnest(range(0, len(l))) AS pos, unnest(l) AS item FROM r JOIN n USING (conv_id) WHERE k = n""")
def edit_log(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns after as many moves, deletions and insertions."""
    kind = (F.col("conv_id") + F.col("turn")) % 4
    op = F.when(kind == 2, "delete").when(kind == 3, "insert").otherwise("move")
    item = F.when(kind == 3, 100 + F.col("turn") % 2).otherwise((F.col("turn") * 5 + F.col("conv_id")) % 8)
    log = t.table(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), op.alias("op"), item.alias("item"), F.when(kind == 0, -1).otherwise(1).alias("step"))
    return scenes.replay(_turns(spark, d).select("conv_id", "pos", F.col("turn").alias("item")), log, "conv_id")


_KEYFRAMES = ("[1, \"2.5\", true, -3]", "[1, \"x\"]", "5", "{\"keyframes\": null}", "{\"other\": 1}", "[1,", "", "{\"keyframes\": [0.5, null]}")


@query("""SELECT event_id, [NULL, 'a keyframe is no number', 'the keyframes are no list', 'the keyframes are no list', NULL, 'the keyframes are no JSON', NULL, 'a keyframe is no number'][event_id % 8 + 1] AS problem,
  CASE WHEN event_id % 8 = 0 THEN 4 ELSE 0 END::BIGINT AS n_keyframes FROM events""")
def keyframe_problems(spark: SparkSession, d: str) -> DataFrame:
    """What a run is told about its keyframes before it begins, and how many can be read."""
    json = F.element_at(F.array(*(F.lit(x) for x in _KEYFRAMES)), (F.col("event_id") % 8 + 1).cast("int"))
    e = t.table(spark, d, "events").select("event_id", json.alias("json"))
    e = e.withColumn("problem", scenes.keyframe_problem(F.col("json")))
    read = scenes.parse_keyframes(e.where("problem is null"), "json", "event_id", strict=False).groupBy("event_id").agg(F.count("*").alias("n_keyframes"))
    return e.select("event_id", "problem").join(read, "event_id", "left").na.fill({"n_keyframes": 0})


# timelines -----------------------------------------------------------------

_TIMED = """f AS (SELECT conv_id AS scene_idx, turn AS seq, round_even(turn * 2.5::DOUBLE * 24, 0)::BIGINT AS s0, round_even((turn + 1) * 2.5::DOUBLE * 24, 0)::BIGINT AS "end", text AS prompt FROM conversations WHERE text <> ''),
x AS (SELECT scene_idx, seq, CASE WHEN lag("end") OVER (PARTITION BY scene_idx ORDER BY seq) = s0 THEN s0 + 1 ELSE s0 END AS start, "end", prompt FROM f)"""


@query(f'WITH {_TIMED} SELECT scene_idx, seq, start, "end", prompt FROM x')
def timeline_segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.timeline_segments(t.timeline_rows(spark, d))


@query(f"""WITH {_TIMED} SELECT scene_idx, 'wide' || chr(10) || 'end' || chr(10) || string_agg('[' || start || '-' || "end" || ']:' || prompt, chr(10) ORDER BY seq) AS timed_text,
  'wide' || chr(10) || string_agg(prompt, chr(10) ORDER BY seq) || chr(10) || 'end' AS plain_text, 'wide end' AS global_prompt, count(*) AS n_segments, greatest(max("end"), 0) AS total_frames FROM x GROUP BY 1""")
def timeline_text(spark: SparkSession, d: str) -> DataFrame:
    out = timeline.assemble(timeline.timeline_segments(t.timeline_rows(spark, d)), "wide", "end")
    return out.select("scene_idx", "timed_text", "plain_text", "global_prompt", F.size("segments").cast("long").alias("n_segments"), "total_frames")


@query(f"""WITH {_TIMED} SELECT scene_idx, row_number() OVER (PARTITION BY scene_idx ORDER BY seq) - 1 AS pos, trim(prompt, ' ') AS prompt, CASE WHEN "end" <= start THEN 1 ELSE "end" - start END AS length FROM x WHERE trim(prompt, ' ') <> ''""")
def timeline_lengths(spark: SparkSession, d: str) -> DataFrame:
    return timeline.encode_lengths(timeline.timeline_segments(t.timeline_rows(spark, d)))


# shares and penalties ------------------------------------------------------

_LENGTHS = "l AS (SELECT l_orderkey AS group_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_quantity::BIGINT AS length FROM lineitem)"
_SHARES = _LENGTHS + """, s0 AS (SELECT *, sum(length) OVER (PARTITION BY group_id) AS total FROM l),
s1 AS (SELECT *, least(31, greatest(1, round_even(total / 8.0::DOUBLE, 0)))::BIGINT AS t0 FROM s0), s2 AS (SELECT *, CASE WHEN t0 >= 30 THEN 31 ELSE t0 END AS target FROM s1),
s3 AS (SELECT *, length * target / total::DOUBLE AS exact, floor(length * target / total::DOUBLE)::BIGINT AS low FROM s2),
s4 AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY exact - low DESC, pos) AS r, sum(low) OVER (PARTITION BY group_id) AS lows FROM s3),
h AS (SELECT group_id, pos, length, (low + CASE WHEN r <= target - lows THEN 1 ELSE 0 END)::BIGINT AS share FROM s4)"""
_WINDOWS = _SHARES + """, w0 AS (SELECT *, sum(share) OVER (PARTITION BY group_id ORDER BY pos) - share AS cur FROM h),
w AS (SELECT group_id, pos, share, floor((2 * cur + share) / 2)::BIGINT AS mid, greatest(floor(share / 2) - 2, 0)::BIGINT AS win, (1.0::DOUBLE / ln(1.0::DOUBLE / 0.001::DOUBLE)) AS sigma FROM w0 WHERE share > 0)"""


@query(f"WITH {_SHARES} SELECT group_id, pos, length, share FROM h")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return relay.largest_remainder(t.order_lengths(spark, d), 8, 31)


@query(f"""WITH RECURSIVE {_SHARES}, g AS (SELECT group_id, list(share ORDER BY pos) AS s, list(length ORDER BY pos) AS ls FROM h GROUP BY 1),
r AS (SELECT group_id, s, ls, 1::BIGINT AS i FROM g UNION ALL SELECT group_id, CASE WHEN s[i] < 1 AND list_max(s) > 1 THEN list_transform(s, lambda v, j: CASE WHEN j = i THEN 1 WHEN j = list_position(s, list_max(s)) THEN v - 1 ELSE v END) ELSE s END, ls, i + 1 FROM r WHERE i <= len(s))
SELECT group_id, unnest(range(0, len(s))) AS pos, unnest(ls) AS length, unnest(s)::BIGINT AS share FROM r WHERE i = len(s) + 1""")
def min_one_repair(spark: SparkSession, d: str) -> DataFrame:
    return relay.min_one(relay.largest_remainder(t.order_lengths(spark, d), 8, 31))


@query(f"WITH {_LENGTHS}, u AS (SELECT *, sum(length) OVER (PARTITION BY group_id ORDER BY pos) AS upto FROM l) SELECT group_id, pos, length, greatest(least(upto, 100) - least(upto - length, 100), 0)::BIGINT AS effective FROM u")
def budget_clamp(spark: SparkSession, d: str) -> DataFrame:
    return relay.budget_clamp(t.order_lengths(spark, d), 100)


@query(f"WITH {_LENGTHS} SELECT group_id, pos, ceil(31.0::DOUBLE / count(*) OVER (PARTITION BY group_id))::BIGINT AS length FROM l")
def equal_lengths(spark: SparkSession, d: str) -> DataFrame:
    return relay.equal_lengths(t.order_lengths(spark, d), 31).select("group_id", "pos", "length")


@query(f"WITH {_WINDOWS} SELECT group_id, pos, share, mid, win, round(sigma, 12) AS sigma FROM w")
def segment_windows(spark: SparkSession, d: str) -> DataFrame:
    out = relay.segment_windows(relay.largest_remainder(t.order_lengths(spark, d), 8, 31))
    return out.withColumn("sigma", F.round("sigma", 12))


@query(f"WITH {_WINDOWS}, q AS (SELECT group_id, pos, sigma, frame, greatest(abs(frame - mid) - win, 0)::DOUBLE AS far FROM w, range(0, 31) r(frame)) SELECT group_id, frame, pos, round(far * far / (2 * sigma * sigma), 6) AS cost FROM q")
def temporal_cost(spark: SparkSession, d: str) -> DataFrame:
    return relay.temporal_cost(relay.segment_windows(relay.largest_remainder(t.order_lengths(spark, d), 8, 31)), 31, places=6)


@query("""SELECT o_orderkey, CASE WHEN lq = lk OR o_orderstatus = 'P' OR lk = 496 OR lk < 8 THEN NULL WHEN lq = 496 THEN 'video' ELSE 'scaled' END AS mode
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 496 ELSE 400 + o_custkey % 100 END AS lq, o_custkey % 500 AS lk FROM orders)""")
def mask_mode(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders")
    lq = F.when(F.col("o_orderkey") % 3 == 0, F.lit(496)).otherwise(400 + F.col("o_custkey") % 100)
    return o.select("o_orderkey", relay.mask_mode(lq, F.col("o_custkey") % 500, F.col("o_orderstatus") == "P", F.lit(496), F.lit(8)).alias("mode"))


@query(r"""WITH c AS (SELECT conv_id AS group_id, turn AS pos, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations),
u AS (SELECT group_id, pos, n, sum(n) OVER (PARTITION BY group_id ORDER BY pos) AS upto FROM c) SELECT group_id, pos, (2 + upto - n)::BIGINT AS first, (2 + upto)::BIGINT AS last FROM u""")
def token_ranges(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.col("text").alias("prompt"), F.lit(2).cast("long").alias("global_n"))
    return relay.token_ranges(c)


#: A public vocabulary of merge ranks; no part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Prompts whose white space runs on into the next one, so that words of the whole text go across their ends.
_PROMPTS = r"""g AS (SELECT conv_id AS group_id, turn AS pos, CASE turn % 3 WHEN 1 THEN text || '   ' WHEN 2 THEN '  ' || chr(10) || text ELSE text END AS prompt FROM conversations WHERE turn > 0 AND trim(text) <> ''),
h AS (SELECT conv_id AS group_id, coalesce(max(CASE WHEN turn = 0 THEN text END), '') || '  ' AS head FROM conversations GROUP BY 1),
b AS (SELECT g.group_id, a.pos, head || string_agg(' ' || g.prompt, '' ORDER BY g.pos) AS text FROM g JOIN h USING (group_id) JOIN g a ON a.group_id = g.group_id AND g.pos <= a.pos GROUP BY 1, 2, head UNION ALL SELECT group_id, -1, head FROM h)"""
#: Each growing text is split and merged on its own: word by word, one merge of all words at a time.
_MERGED = r"""WITH RECURSIVE """ + _PROMPTS + r""",
v AS MATERIALIZED (SELECT hex(from_base64(t)) AS token, r AS rank FROM read_csv('{path}', delim = ' ', header = false, quote = '', escape = '', columns = {{'t': 'VARCHAR', 'r': 'BIGINT'}})),
s AS MATERIALIZED (SELECT group_id, pos, unnest(regexp_extract_all(regexp_replace(text, '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g'), '''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}\x01]+|\s+')) AS word FROM b),
d AS MATERIALIZED (SELECT word, hex(encode(word)) AS bytes FROM (SELECT DISTINCT word FROM s)),
m AS (SELECT word, CASE WHEN bytes IN (SELECT token FROM v) THEN [bytes] ELSE [bytes[2 * i - 1:2 * i] for i in range(1, len(bytes) // 2 + 1)] END AS parts FROM d
  UNION ALL SELECT word, list_concat(list_concat(parts[1:k - 1], [parts[k] || parts[k + 1]]), parts[k + 2:]) FROM (
    SELECT word, parts, arg_min(i, rank * 1000000 + i) AS k FROM (SELECT word, parts, unnest(range(1, len(parts))) AS i FROM m) JOIN v ON token = parts[i] || parts[i + 1] GROUP BY 1, 2)),
n AS MATERIALIZED (SELECT word, min(len(parts)) AS n FROM m GROUP BY 1),
c AS (SELECT group_id, pos, sum(n)::BIGINT AS upto FROM s JOIN n USING (word) GROUP BY 1, 2),
l AS (SELECT group_id, pos, coalesce(lag(upto) OVER (PARTITION BY group_id ORDER BY pos), 0) AS first, upto AS last FROM c)
SELECT group_id, pos, first, last FROM l WHERE pos >= 0"""


@query(_MERGED.format(path=VOCABULARY))
def token_ranges_merged(spark: SparkSession, d: str) -> DataFrame:
    """The first turn as global prompt and the others as local ones, in tokens of a byte-pair vocabulary."""
    c = t.table(spark, d, "conversations")
    k = F.col("turn") % 3
    prompt = F.when(k == 1, F.concat("text", F.lit("   "))).when(k == 2, F.concat(F.lit("  \n"), "text")).otherwise(F.col("text"))
    heads = c.groupBy(F.col("conv_id").alias("group_id")).agg(F.concat(F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")), F.lit("  ")).alias("global_prompt"))
    local = c.where((F.col("turn") > 0) & (F.trim("text") != "")).select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), prompt.alias("prompt"))
    return tokens.merged_ranges(local.join(heads, "group_id"), tokens.merge_ranks(spark, VOCABULARY))


# samples and frames --------------------------------------------------------


@query("""WITH s AS (SELECT user_id AS asset_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events), n AS (SELECT asset_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT asset_id, bin, floor(bin * (n / 64.0::DOUBLE))::BIGINT AS lo, CASE WHEN bin = 63 THEN n ELSE floor((bin + 1) * (n / 64.0::DOUBLE))::BIGINT END AS hi FROM n, range(0, 64) r(bin))
SELECT b.asset_id, bin, coalesce(max(abs(value)), 0.0::DOUBLE) AS peak FROM b LEFT JOIN s ON s.asset_id = b.asset_id AND i >= lo AND i < hi GROUP BY 1, 2""")
def waveform_peaks(spark: SparkSession, d: str) -> DataFrame:
    return audio.waveform_peaks(audio.channel_mean(t.samples(spark, d)), 64)


@query("SELECT user_id AS asset_id, count(*) / 44100.0::DOUBLE AS duration FROM events GROUP BY 1")
def sample_durations(spark: SparkSession, d: str) -> DataFrame:
    return audio.durations(t.samples(spark, d), 44100)


@query("WITH s AS (SELECT user_id AS asset_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_idx, value FROM events) SELECT asset_id, c::INTEGER AS channel, sample_idx, value FROM s, range(0, 2) r(c)")
def stereo(spark: SparkSession, d: str) -> DataFrame:
    return audio.stereo(t.samples(spark, d)).select("asset_id", "channel", "sample_idx", "value")


_FRAMES = "f AS (SELECT label AS seq_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, vec_id, embedding[1]::DOUBLE AS value, count(*) OVER (PARTITION BY label) AS n FROM embeddings)"


@query(f"WITH {_FRAMES} SELECT seq_id, count(*) AS n_frames FROM f GROUP BY 1")
def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_counts(t.frames(spark, d))


@query(f"WITH {_FRAMES} SELECT seq_id, frame_idx, vec_id FROM f WHERE frame_idx >= greatest(n - 1 - 2, 0) AND frame_idx < n")
def frame_range_back(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_range(t.frames(spark, d), -1, -2).select("seq_id", "frame_idx", "vec_id")


@query(f"WITH {_FRAMES} SELECT seq_id, frame_idx, vec_id FROM f WHERE frame_idx >= least(10, n - 1) AND frame_idx < least(least(10, n - 1) + 5, n)")
def frame_range_ahead(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_range(t.frames(spark, d), 10, 5).select("seq_id", "frame_idx", "vec_id")


@query(f"WITH {_FRAMES}, l AS (SELECT label AS seq_id, max(embedding[1]::DOUBLE) AS v FROM embeddings GROUP BY 1) SELECT f.seq_id, frame_idx, CASE WHEN frame_idx = greatest(n - 2, 0) THEN v ELSE value END AS value FROM f JOIN l ON f.seq_id = l.seq_id")
def frame_replace(spark: SparkSession, d: str) -> DataFrame:
    f = t.frames(spark, d)
    return frames.replace_frame(f, f.groupBy("seq_id").agg(F.max("value").alias("value")), -2, "value").select("seq_id", "frame_idx", "value")


@query(f"WITH {_FRAMES} SELECT seq_id, frame_idx, vec_id FROM f WHERE frame_idx >= n - 9")
def tail_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.tail_frames(t.frames(spark, d), 9).select("seq_id", "frame_idx", "vec_id")


@query(f"WITH {_FRAMES} SELECT seq_id, frame_idx, vec_id FROM f WHERE frame_idx < greatest(n - 9, 0)")
def encoder_frames(spark: SparkSession, d: str) -> DataFrame:
    return frames.encoder_frames(t.frames(spark, d), 9).select("seq_id", "frame_idx", "vec_id")


@query(f"""WITH {_MARKERS}, q AS (SELECT asset_id, total / 2 AS t, total AS duration FROM a), x AS (SELECT q.asset_id, q.t, pos, abs(sec - q.t) AS dist, duration FROM q JOIN d ON q.asset_id = d.asset_id),
y AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY dist, pos) AS r FROM x WHERE dist <= greatest(0.2::DOUBLE, duration / 100)) SELECT asset_id, pos, dist AS distance FROM y WHERE r = 1""")
def nearest_marker(spark: SparkSession, d: str) -> DataFrame:
    probes = t.assets(spark, d).select("asset_id", (F.col("total") / 2).alias("t"), F.col("total").alias("duration"))
    return frames.nearest_marker(segments.dedup_markers(t.markers(spark, d)), probes).select("asset_id", "pos", "distance")


@query(f"""WITH {_MARKERS}, q AS (SELECT event_id, user_id AS asset_id, (epoch_us(ts) - t0) / 1e6 AS t, total AS duration FROM events JOIN a ON user_id = asset_id WHERE event_type <> 'purchase'),
x AS (SELECT event_id, q.asset_id, pos, abs(sec - t) AS dist FROM q JOIN d ON q.asset_id = d.asset_id WHERE abs(sec - t) <= greatest(0.2::DOUBLE, duration / 100))
SELECT event_id, asset_id, pos, dist AS distance FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY dist, pos) = 1""")
def nearest_markers_of_all(spark: SparkSession, d: str) -> DataFrame:
    """Every event that is no marker as a probe, among the markers of its asset."""
    e = t.table(spark, d, "events").where("event_type <> 'purchase'").select("event_id", F.col("user_id").alias("asset_id"), t.micros().alias("us"))
    probes = e.join(t.assets(spark, d), "asset_id").select("event_id", "asset_id", ((F.col("us") - F.col("t0")) / F.lit(1e6)).alias("t"), F.col("total").alias("duration"))
    return frames.nearest_marker(segments.dedup_markers(t.markers(spark, d)), probes).select("event_id", "asset_id", "pos", "distance")


@query("""WITH f AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS pos, item_id::VARCHAR AS name, count(*) OVER () AS n FROM benchmark)
SELECT o_orderkey, x.name AS first_name, y.name AS last_name FROM orders JOIN f x ON o_custkey % x.n = x.pos JOIN f y ON (CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END) % y.n = y.pos""")
def first_last_frame(spark: SparkSession, d: str) -> DataFrame:
    files = numbered(t.table(spark, d, "benchmark").select("item_id"), "item_id").select("pos", F.col("item_id").cast("string").alias("name"))
    o = t.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("i"), (F.col("o_custkey") + 1).alias("j"), "o_orderstatus")
    return frames.first_last(o, files, F.col("o_orderstatus") == "F").select("o_orderkey", "first_name", "last_name")


# libraries -----------------------------------------------------------------

_FILES = "fl AS (SELECT p_brand AS folder, printf('%03d', p_partkey % 97) || '_' || replace(p_name, ' ', '_') || '_' || p_partkey || ['.png', '.WAV', '.mp4', '.txt', '.jpg', '.mp3'][p_partkey % 6 + 1] AS name, p_partkey FROM part)"


def _listing_sql(extensions: tuple[str, ...], order: str = "name", most: str = "") -> str:
    names = ", ".join(f"'{x}'" for x in extensions)
    return f"WITH {_FILES} SELECT folder, pos, name FROM (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY {order}) - 1 AS pos FROM fl WHERE lower(regexp_extract(name, '(\\.[^./]+)$', 1)) IN ({names})){most}"


@query(_listing_sql(library.AUDIO))
def list_audio(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.AUDIO)


@query(_listing_sql(library.MANAGED_IMAGES, r"regexp_replace(name, '\.[^./]+$', ''), name"))
def list_images_by_stem(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.MANAGED_IMAGES, by_stem=True)


@query(_listing_sql(library.TEXTS))
def list_prompts(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.TEXTS)


@query(_listing_sql(library.IMAGES))
def list_images(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.IMAGES)


@query(_listing_sql(library.MANAGED_AUDIO))
def list_managed_audio(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.MANAGED_AUDIO)


@query(_listing_sql(library.MANAGED_VIDEOS))
def list_managed_videos(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.MANAGED_VIDEOS)


@query(f"WITH {_FILES}, x AS (SELECT folder || '/' || name AS path FROM fl WHERE lower(regexp_extract(name, '(\\.[^./]+)$', 1)) IN ('.wav', '.mp3', '.flac', '.ogg', '.m4a', '.aac')) SELECT row_number() OVER (ORDER BY path) - 1 AS pos, path FROM x")
def list_audio_segments(spark: SparkSession, d: str) -> DataFrame:
    return library.deep_listing(t.files(spark, d), library.AUDIO_SEGMENTS)


@query(_listing_sql(library.MERGEABLE, most=" WHERE pos < 5"))
def merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return library.listing(t.files(spark, d), library.MERGEABLE, most=5)


@query(f"""WITH x AS ({_listing_sql(library.MERGEABLE, most=" WHERE pos < 5")}) SELECT folder, CASE WHEN count(*) = 1 THEN 'copy' ELSE 'concat' END AS action, string_agg('file ''' || name || '''', chr(10) ORDER BY pos) AS manifest FROM x GROUP BY 1""")
def merge_manifest(spark: SparkSession, d: str) -> DataFrame:
    return library.merge_manifest(merge_candidates(spark, d))


@query(f"""WITH {_FILES}, u AS (SELECT DISTINCT folder, regexp_extract(name, '^(\\d+)', 1)::BIGINT AS k FROM fl), g AS (SELECT folder, k FROM (SELECT DISTINCT folder FROM fl), range(0, 1000) r(k))
SELECT g.folder, min(g.k) AS next_number FROM g LEFT JOIN u ON g.folder = u.folder AND g.k = u.k WHERE u.k IS NULL GROUP BY 1""")
def next_number_mex(spark: SparkSession, d: str) -> DataFrame:
    return library.next_number_mex(t.files(spark, d))


@query(f"WITH {_FILES} SELECT folder, count(*) AS next_number FROM fl GROUP BY 1")
def next_number_count(spark: SparkSession, d: str) -> DataFrame:
    return library.next_number_count(t.files(spark, d))


@query(f"""WITH {_FILES}, u AS (SELECT DISTINCT folder, regexp_extract(name, '^(\\d+)', 1)::BIGINT AS k FROM fl WHERE p_partkey % 3 <> 0),
g AS (SELECT folder, k, row_number() OVER (PARTITION BY folder ORDER BY k) - 1 AS n FROM (SELECT DISTINCT folder FROM fl), range(0, (SELECT 1000 + count(*) FROM fl)) r(k) WHERE (folder, k) NOT IN (SELECT (folder, k) FROM u)),
w AS (SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY p_partkey) - 1 AS n, p_partkey AS pos FROM fl)
SELECT w.folder, pos, k AS number FROM w JOIN g USING (folder, n)""")
def upload_numbers(spark: SparkSession, d: str) -> DataFrame:
    """As many uploads as a folder had files, each into the smallest number that is free among two thirds of them."""
    f = t.files(spark, d).withColumn("pos", F.regexp_extract("name", r"_(\d+)\.", 1).cast("long"))
    return library.free_numbers(f.where("pos % 3 <> 0"), f.select("folder", "pos")).select("folder", "pos", "number")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """What each folder should hold: two of three files in reversed order, and one that doesn't exist."""
    key = F.regexp_extract("name", r"_(\d+)\.", 1).cast("long")
    f = t.files(spark, d).withColumn("k", key).where("k % 3 <> 0").select("folder", (-F.col("k")).alias("pos"), "name")
    return f.unionByName(t.files(spark, d).select("folder").distinct().select("folder", F.lit(-1).cast("long").alias("pos"), F.lit("missing.png").alias("name")))


_SAFE = f"WITH {_FILES}, o AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY -p_partkey) - 1 AS idx FROM fl WHERE p_partkey % 3 <> 0)"
_GONE = "SELECT folder, 'delete' AS action, name AS old_name, NULL::VARCHAR AS new_name FROM fl WHERE p_partkey % 3 = 0"


@query(_SAFE + r" SELECT folder, 'rename' AS action, name AS old_name, printf('%03d', idx) || lower(regexp_extract(name, '(\.[^./]+)$', 1)) AS new_name FROM o UNION ALL " + _GONE)
def reconcile_plan(spark: SparkSession, d: str) -> DataFrame:
    return library.reconcile_plan(t.files(spark, d), _ordered(spark, d))


@query(_SAFE + r" SELECT folder, 'rename' AS action, name AS old_name, printf('%03d', idx) || '_' || regexp_replace(name, '^\d{3}_(.+)', '\1') AS new_name FROM o UNION ALL " + _GONE)
def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return library.reconcile_plan(t.files(spark, d), _ordered(spark, d), keep_names=True, guard_empty=True)


@query(f"WITH {_FILES} SELECT folder, name FROM fl WHERE p_partkey % 3 = 0")
def delete_plan(spark: SparkSession, d: str) -> DataFrame:
    return library.delete_plan(t.files(spark, d), _ordered(spark, d)).select("folder", "name")


@query(f"WITH {_FILES}, n AS (SELECT folder, count(*) AS c FROM fl GROUP BY 1) SELECT folder, i AS pos, printf('%03d', c + i) || '.png' AS name FROM n, range(0, 3) r(i)")
def saved_names(spark: SparkSession, d: str) -> DataFrame:
    numbers = library.next_number_count(t.files(spark, d))
    new = numbers.select("folder", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("pos"))
    return library.saved_names(new, numbers)


@query("""WITH n AS (SELECT source AS folder, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id FROM documents), c AS (SELECT source AS folder, count(*) AS k FROM documents GROUP BY 1)
SELECT folder, pos, printf('%03d', k + pos) || '_clip' || doc_id || '.mp4' AS name FROM n JOIN c USING (folder)""")
def uploaded_names(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents").select(F.col("source").alias("folder"), "doc_id")
    new = numbered(docs, ["folder", "doc_id"], within="folder").select("folder", "pos", F.concat(F.lit('clip:?"'), F.col("doc_id").cast("string"), F.lit("*.mp4")).alias("name"))
    return library.uploaded_names(new, library.next_number_count(docs))


@query(f"""WITH {_FILES}, n AS (SELECT folder, count(*) AS c FROM fl GROUP BY 1),
u AS (SELECT p_brand AS folder, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, p_partkey % 6 AS k FROM part)
SELECT folder, pos, CASE WHEN k = 5 THEN 'name is empty' END AS error, CASE WHEN k < 5 THEN printf('%03d', c + pos) || ['.png', '.jpg', '.webp', '.png', '.png'][k + 1] END AS name FROM u JOIN n USING (folder)""")
def uploaded_images(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*(F.lit(x) for x in ("a.PNG", "b?.x.Jpg", "webp", "c.gif", "no extension", "?*"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    parts = numbered(t.table(spark, d, "part").select(F.col("p_brand").alias("folder"), "p_partkey"), ["folder", "p_partkey"], within="folder")
    new = parts.select("folder", "pos", names.alias("name"))
    return library.uploaded_images(new, library.next_number_count(t.files(spark, d)))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'name is empty' WHEN p_partkey % 7 = 0 THEN 'content is empty' END AS error,
  CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_name || '.TXT' ELSE p_name || '.txt' END AS saved_as FROM part""")
def prompt_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    p = t.table(spark, d, "part").select("p_partkey", F.when(k % 5 == 0, F.lit(' ?* ')).when(k % 3 == 0, F.concat(F.lit("<"), "p_name", F.lit(">.TXT"))).otherwise(F.concat("p_name", F.lit("|"))).alias("name"), F.when(k % 7 == 0, F.lit("  ")).otherwise(F.lit("x")).alias("content"))
    return library.prompt_file(p).select("p_partkey", "error", "saved_as")


_STEPS = """f AS (SELECT p_brand AS folder, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, p_size, p_partkey FROM part),
g AS (SELECT folder, i, printf('%03d', i) || ['.png', '.jpg'][i % 3 // 2 + 1] AS name, p_size, p_partkey FROM f),
p AS (SELECT folder, name AS o, printf('%03d', row_number() OVER (PARTITION BY folder ORDER BY p_size, p_partkey) - 1) || ['.png', '.jpg'][i % 3 // 2 + 1] AS w FROM g WHERE i % 11 <> 5),
r AS (SELECT * FROM p WHERE o <> w)"""


@query(f"""WITH RECURSIVE {_STEPS},
k AS (SELECT folder, o AS start, o AS cur, 0 AS n FROM r UNION ALL SELECT k.folder, start, x.o, n + 1 FROM k JOIN r c ON c.folder = k.folder AND c.o = cur JOIN r x ON x.folder = k.folder AND x.o = c.w WHERE x.o <> start),
z AS (SELECT k.folder, start, max(n) AS most, bool_or(c.w = start) AS circle, min(cur) AS least FROM k JOIN r c ON c.folder = k.folder AND c.o = cur GROUP BY 1, 2),
m AS (SELECT z.folder, z.start, circle AND z.start = least AS broken, CASE WHEN circle AND z.start <> least THEN k.n - 1 ELSE most END AS n FROM z LEFT JOIN k ON circle AND k.folder = z.folder AND k.start = z.start AND k.cur = least)
SELECT m.folder, (n + 2)::BIGINT AS step, 'rename' AS action, CASE WHEN broken THEN '_tmp_' || o ELSE o END AS old_name, w AS new_name FROM m JOIN r ON r.folder = m.folder AND o = start
UNION ALL SELECT folder, 1, 'rename', start, '_tmp_' || start FROM m WHERE broken UNION ALL SELECT folder, 0, 'delete', name, NULL FROM g WHERE i % 11 = 5""")
def rename_steps(spark: SparkSession, d: str) -> DataFrame:
    """Numbered files put into another order, where most new names are taken: chains and circles of renames."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    ext = F.when(F.col("i") % 3 == 2, ".jpg").otherwise(".png")
    parts = t.table(spark, d, "part").select(F.col("p_brand").alias("folder"), i.alias("i"), "p_size", "p_partkey")
    have = cut(parts.select("folder", "i", F.concat(scalars.pad3("i"), ext).alias("name"), "p_size", "p_partkey"), "files")
    wanted = have.where("i % 11 <> 5").select("folder", (F.col("p_size").cast("long") * 1_000_000_000 + F.col("p_partkey")).alias("pos"), "name")
    return library.rename_steps(library.reconcile_plan(have.select("folder", "name"), wanted))


@query("""WITH w AS (SELECT p_partkey AS k, p_name || '_' || p_partkey AS n FROM part) SELECT k AS p_partkey,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN CASE WHEN k % 5 = 0 THEN '/abs/' || n END WHEN k % 3 = 0 THEN 'input/' || n WHEN k % 3 = 1 THEN 'more/' || n END AS resolved,
  CASE WHEN k % 7 = 0 THEN 'the path is empty' WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'the file is not found: /abs/' || n WHEN k % 2 = 1 AND k % 3 = 2 THEN 'the file is not found: ' || n END AS error FROM w""")
def resolve_existing(spark: SparkSession, d: str) -> DataFrame:
    """Paths as they are given, among the files that are there."""
    k, name = F.col("p_partkey"), F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"))
    p = t.table(spark, d, "part").select("p_partkey", name.alias("name"))
    there = p.select(F.explode(F.array(F.when(k % 3 == 0, F.concat(F.lit("input/"), "name")).when(k % 3 == 1, F.concat(F.lit("more/"), "name")), F.when(k % 3 == 0, F.concat(F.lit("more/"), "name")), F.when(k % 5 == 0, F.concat(F.lit("/abs/"), "name")))).alias("path")).where("path is not null")
    path = F.when(k % 7 == 0, F.lit(' "" ')).when(k % 2 == 0, F.concat(F.lit('"/abs/'), "name", F.lit('"'))).otherwise(F.concat(F.lit(" "), "name"))
    return library.resolve_existing(p.select("p_partkey", path.alias("path")), there, ["input/", "more"]).select("p_partkey", "resolved", "error")


# sizes and scalars ---------------------------------------------------------

_SIZES = "z AS (SELECT p_partkey AS id, p_size * 37 + 41 AS w, floor(p_retailprice)::BIGINT + 17 AS h FROM part)"


@query(f"""WITH {_SIZES}, s AS (SELECT *, round_even(w * (980.0::DOUBLE / greatest(w, h)), 0)::BIGINT AS scaled_w, round_even(h * (980.0::DOUBLE / greatest(w, h)), 0)::BIGINT AS scaled_h FROM z)
SELECT id, scaled_w, scaled_h, scaled_w - scaled_w % 32 AS crop_w, scaled_h - scaled_h % 32 AS crop_h, (scaled_w % 32) // 2 AS "left", (scaled_h % 32) // 2 AS top FROM s""")
def fit_max_side(spark: SparkSession, d: str) -> DataFrame:
    return geometry.fit_max_side(t.sizes(spark, d), 980, 32).select("id", "scaled_w", "scaled_h", "crop_w", "crop_h", "left", "top")


@query(f"WITH {_SIZES} SELECT id, greatest(w // 3 + (w // 3) % 2, 2)::BIGINT AS small_w, greatest(h // 3 + (h // 3) % 2, 2)::BIGINT AS small_h FROM z")
def downscale_even(spark: SparkSession, d: str) -> DataFrame:
    return geometry.downscale_even(t.sizes(spark, d), 3).select("id", "small_w", "small_h")


@query(f"""WITH {_SIZES}, c AS (SELECT id, CASE WHEN w = 540 OR h = 960 THEN w WHEN w / h > 540 / 960.0::DOUBLE THEN w * 960 // h ELSE 540 END AS cover_w, CASE WHEN w = 540 OR h = 960 THEN h WHEN w / h > 540 / 960.0::DOUBLE THEN 960 ELSE h * 540 // w END AS cover_h FROM z)
SELECT id, cover_w, cover_h, floor((cover_w - 540) / 2)::BIGINT AS crop_left, floor((cover_h - 960) / 2)::BIGINT AS crop_top FROM c""")
def cover_crop(spark: SparkSession, d: str) -> DataFrame:
    return geometry.cover_crop(t.sizes(spark, d), 540, 960).select("id", "cover_w", "cover_h", "crop_left", "crop_top")


@query(f"WITH {_SIZES}, s AS (SELECT id, CASE WHEN id % 2 = 0 THEN h ELSE w END AS w, CASE WHEN id % 2 = 0 THEN w ELSE h END AS h FROM z) SELECT id, w, h, w - w % 32 AS base_w, h - h % 32 AS base_h, (w - w % 32) // 2 AS half_w, (h - h % 32) // 2 AS half_h FROM s")
def base_size(spark: SparkSession, d: str) -> DataFrame:
    return geometry.base_size(geometry.swapped(t.sizes(spark, d), F.col("id") % 2 == 0), 32).select("id", "w", "h", "base_w", "base_h", "half_w", "half_h")


@query("SELECT p_partkey, CASE p_partkey % 9 WHEN 2 THEN p_brand WHEN 3 THEN p_type ELSE p_name END AS picked FROM part")
def pick_of_n(spark: SparkSession, d: str) -> DataFrame:
    index = F.when(F.col("p_partkey") % 9 == 0, F.lit(99)).otherwise(F.col("p_partkey") % 9)
    return t.table(spark, d, "part").select("p_partkey", geometry.pick(index, F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("picked"))


@query("""WITH s AS (SELECT * FROM (VALUES (4, [14.6146, 6.4746, 1.9074, 0.4255, 0.0]), (6, [14.6146, 9.4268, 6.4746, 3.9665, 1.9074, 0.4255, 0.0]), (8, [14.6146, 11.6742, 9.4268, 7.5958, 6.0729, 3.9665, 1.9074, 0.6472, 0.0])) v(steps, xs))
SELECT o_orderkey, unnest(range(0, len(xs))) AS i, unnest(xs)::DOUBLE AS sigma FROM orders JOIN s ON steps = 4 + 2 * (o_orderkey % 3) UNION ALL SELECT o_orderkey, -1, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def noise_schedules(spark: SparkSession, d: str) -> DataFrame:
    o = t.table(spark, d, "orders").select("o_orderkey", geometry.sigmas(4 + 2 * (F.col("o_orderkey") % 3)).alias("s"))
    none = t.table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(-1).cast("long").alias("i"), F.get(geometry.sigmas(F.lit(5)), F.lit(0)).alias("sigma"))
    return o.select("o_orderkey", F.posexplode("s").alias("i", "sigma")).select("o_orderkey", F.col("i").cast("long").alias("i"), "sigma").union(none)


@query("""SELECT event_id, floor(value + 0.5::DOUBLE)::BIGINT AS snapped, printf('%d:%05.2f', floor(value / 60)::BIGINT, value - floor(value / 60) * 60) AS clock, (floor(trunc(value * 24) / 8) * 8)::BIGINT AS down,
  CASE WHEN trunc(value * 24) <= 0 THEN 0 ELSE ceil(trunc(value * 24) / 8) * 8 END::BIGINT AS up, coalesce(try_cast(json_extract(props, '$.k') AS BIGINT), 0)::BIGINT AS k, event_id::DOUBLE AS as_float FROM events""")
def scalar_times(spark: SparkSession, d: str) -> DataFrame:
    f = scalars.truncated(F.col("value") * 24)
    return t.table(spark, d, "events").select(
        "event_id", scalars.half_up("value").alias("snapped"), scalars.clock("value").alias("clock"), scalars.align_down(f, 8).alias("down"), scalars.align_up(f, 8).alias("up"),
        scalars.safe_int(F.get_json_object("props", "$.k")).alias("k"), F.col("event_id").cast("double").alias("as_float"),
    )


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true ELSE url LIKE 'https://%' END AS inside,
  CASE WHEN page_id % 5 < 4 THEN '.md' ELSE lower(regexp_extract(url, '(\.[^./]+)$', 1)) END AS extension FROM pages""")
def path_guard(spark: SparkSession, d: str) -> DataFrame:
    """Below the base, beside it under a longer name, out of it by ``..``, with dots in a name, and as it is."""
    made = ["https://a/x.md", "https:more/a/x.MD", "https://a/../../x.md", "https://a..b/..c/x.Md"]
    url = F.coalesce(F.get(F.array(*(F.lit(x) for x in made)), (F.col("page_id") % 5).cast("int")), "url")
    return t.table(spark, d, "pages").select("page_id", scalars.within(F.lit("https:/"), url).alias("inside"), scalars.extension(url).alias("extension"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def ordered_intersection(spark: SparkSession, d: str) -> DataFrame:
    wanted = t.table(spark, d, "documents").select("doc_id", (-F.col("doc_id")).alias("pos"))
    return library.ordered_existing(wanted, t.table(spark, d, "labels"), "doc_id").select("doc_id", "pos")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def existing_minus_kept(spark: SparkSession, d: str) -> DataFrame:
    return library.existing_but(t.table(spark, d, "documents").select("doc_id"), t.table(spark, d, "labels"), "doc_id")


@query("""SELECT CASE WHEN event_id % 4 > 0 THEN '请您根据要求生成一段总长度' || event_id % 4 || '秒的视频脚本；' || event_type ELSE event_type END AS system_text, event_id,
  ['audio', 'video', NULL][event_id % 3 + 1] AS media_kind FROM events""")
def prompt_options(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    mime = F.element_at(F.array(F.lit("audio/wav"), F.lit("video/mp4"), F.lit("text/audio/")), (k % 3 + 1).cast("int"))
    return t.table(spark, d, "events").select(library.system_prompt(F.col("event_type"), k % 4).alias("system_text"), "event_id", library.mime_kind(mime).alias("media_kind"))


# bounds, paths and checks --------------------------------------------------


@query("SELECT event_id, greatest(0, event_id - 50)::BIGINT AS first, greatest(event_id - 60 + event_id % 40, greatest(0, event_id - 50) + 1)::BIGINT AS last FROM events")
def slice_bounds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    first, last = segments.slice_bounds(k - 50, k - 60 + k % 40)
    return t.table(spark, d, "events").select("event_id", first.alias("first"), last.alias("last"))


@query(ORACLES["token_ranges"].replace("SELECT group_id, pos, (2 + upto - n)::BIGINT AS first, (2 + upto)::BIGINT AS last FROM u", "SELECT group_id, max(2 + upto)::BIGINT AS most_tokens FROM u GROUP BY 1"))
def most_tokens(spark: SparkSession, d: str) -> DataFrame:
    return token_ranges(spark, d).groupBy("group_id").agg(F.max("last").alias("most_tokens"))


@query(f"WITH {_WINDOWS}, r AS (SELECT conv_id AS group_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations) SELECT group_id, pos, mid, win FROM w JOIN r USING (group_id, pos)")
def zip_by_position(spark: SparkSession, d: str) -> DataFrame:
    windows = relay.segment_windows(relay.largest_remainder(t.order_lengths(spark, d), 8, 31))
    return relay.by_place(_turns(spark, d).select(F.col("conv_id").alias("group_id"), "pos"), windows).select("group_id", "pos", "mid", "win")


#: Segments of equal lengths, cut off where the 31 frames end.
_TOKEN_WINDOWS = r"""WITH c AS (SELECT conv_id AS group_id, turn AS pos, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, ceil(31.0::DOUBLE / count(*) OVER (PARTITION BY conv_id))::BIGINT AS length FROM conversations),
u AS (SELECT group_id, pos, length, 2 + sum(n) OVER (PARTITION BY group_id ORDER BY pos) AS last, n, sum(length) OVER (PARTITION BY group_id ORDER BY pos) - length AS cur FROM c),
e AS (SELECT *, greatest(least(cur + length, 31) - least(cur, 31), 0) AS share FROM u),
w AS (SELECT group_id, (last - n)::BIGINT AS first, last::BIGINT AS last, floor((2 * least(cur, 31) + share) / 2) AS mid, greatest(floor(share / 2) - 2, 0) AS win, 1.0::DOUBLE / ln(1.0::DOUBLE / 0.001::DOUBLE) AS sigma FROM e WHERE share > 0),
x AS (SELECT *, greatest(abs({frame} - mid) - win, 0)::DOUBLE AS far FROM w, range(0, {n}) r(q))
"""
_TOKEN_COST = _TOKEN_WINDOWS + "SELECT group_id, q, unnest(range(first, last)) AS k, round(far * far / (2 * sigma * sigma), 6) AS cost FROM x WHERE far > 0"


def _token_segments(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"))
    lengths = relay.budget_clamp(relay.equal_lengths(c, 31), 31)
    windows = relay.segment_windows(lengths.select("group_id", "pos", F.col("effective").alias("share")))
    return relay.by_place(token_ranges(spark, d), windows)


@query(_TOKEN_COST.format(frame="q // 4", n=24))
def token_cost_video(spark: SparkSession, d: str) -> DataFrame:
    return relay.token_cost(_token_segments(spark, d), 24, tokens_per_frame=4).withColumn("cost", F.round("cost", 6))


@query(_TOKEN_COST.format(frame="q * 31 / 10.0::DOUBLE", n=10))
def token_cost_scaled(spark: SparkSession, d: str) -> DataFrame:
    return relay.token_cost(_token_segments(spark, d), 10, latent_frames=31).withColumn("cost", F.round("cost", 6))


@query(_TOKEN_WINDOWS.format(frame="q", n=31) + "SELECT group_id, q * 40 AS q_first, q * 40 + 39 AS q_last, first AS k_first, last - 1 AS k_last, round(far * far / (2 * sigma * sigma), 6) AS cost FROM x WHERE far > 0 AND last > first")
def cost_runs_video(spark: SparkSession, d: str) -> DataFrame:
    """A whole clip of 31 frames of 40 tokens: a block for each frame that is outside a segment's window, not 40 rows a token."""
    return relay.cost_runs(_token_segments(spark, d), 31 * 40, tokens_per_frame=40, overlap=False).withColumn("cost", F.round("cost", 6))


#: Every turn also reaches 3 tokens into the next one's range, which the next one then takes back.
_REACH = _TOKEN_WINDOWS.format(frame="q", n=31).split("x AS (")[0] + """o AS (SELECT group_id, first, last + 3 AS last, mid, win, sigma, lead(first) OVER (PARTITION BY group_id ORDER BY mid, first) AS next FROM w),
x AS (SELECT group_id, q, first, least(last, coalesce(next, last)) AS last, sigma, greatest(abs(q * 31 / 10.0::DOUBLE - mid) - win, 0)::DOUBLE AS far FROM o, range(0, 10) r(q))
SELECT group_id, q AS q_first, q AS q_last, first AS k_first, last - 1 AS k_last, round(far * far / (2 * sigma * sigma), 6) AS cost FROM x WHERE far > 0"""


@query(_REACH)
def cost_runs_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that overlap, in proportion: each token costs what the last segment that has it says."""
    wide = _token_segments(spark, d).withColumn("last", F.col("last") + 3)
    return relay.cost_runs(wide, 10, latent_frames=31).withColumn("cost", F.round("cost", 6))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '/abs/' || p_name ELSE 'input/' || p_name END AS first_candidate, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_candidates FROM part""")
def resolve_paths(spark: SparkSession, d: str) -> DataFrame:
    quoted = F.concat(F.lit(' "'), F.when(F.col("p_partkey") % 2 == 0, F.lit("/abs/")).otherwise(F.lit("")), "p_name", F.lit('" '))
    found = library.resolved(quoted, ["input/", "more"])
    return t.table(spark, d, "part").select("p_partkey", F.get(found, F.lit(0)).alias("first_candidate"), F.size(found).cast("long").alias("n_candidates"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 0 THEN 'the file is not found' WHEN event_id % 5 = 0 THEN 'the keyframes are no JSON' END AS problem FROM events""")
def input_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    file = F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("a.wav"))
    keyframes = F.when(k % 5 == 0, F.lit("[1,")).otherwise(F.col("props"))
    return t.table(spark, d, "events").select("event_id", scenes.input_problem(file, k % 4 != 0, keyframes).alias("problem"))
