"""Timed prompts: seconds to frames, gap repair, and the three forms they are given out in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.scalars import half_even

DEFAULT_START, DEFAULT_END = 0.0, 15.0


def timeline_segments(rows: DataFrame, fps: int = 24, scene: str = "scene_idx") -> DataFrame:
    """(scene, seq, start, end, prompt) in frames; empty prompts go.

    Where a segment starts at the frame at which the one before it ends, it
    starts one frame later. Ends are never moved, so repairs don't add up.
    """
    frames = rows.select(
        scene,
        "seq",
        half_even(F.coalesce("start_s", F.lit(DEFAULT_START)) * fps).alias("start"),
        half_even(F.coalesce("end_s", F.lit(DEFAULT_END)) * fps).alias("end"),
        F.coalesce("prompt", F.lit("")).alias("prompt"),
    ).where("prompt <> ''")
    before = F.lag("end").over(Window.partitionBy(scene).orderBy("seq"))
    return frames.withColumn("start", F.when(before == F.col("start"), F.col("start") + 1).otherwise(F.col("start")))


def _joined(parts: Column, default: str) -> Column:
    text = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    return F.when(text == "", F.lit(default)).otherwise(text)


def assemble(segments: DataFrame, prefix: str = "", suffix: str = "", default: str = "", scene: str = "scene_idx") -> DataFrame:
    """(scene, timed_text, plain_text, global_prompt, segments, total_frames).

    The timed text has the suffix before the segments, the plain text behind them.
    """
    by = segments.groupBy(scene).agg(F.array_sort(F.collect_list(F.struct("seq", "prompt", "start", "end"))).alias("x"), F.greatest(F.max("end"), F.lit(0).cast("long")).alias("total_frames"))
    head, tail = F.lit(prefix), F.lit(suffix)
    timed = F.concat(F.array(head, tail), F.transform("x", lambda r: F.concat(F.lit("["), r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit("]:"), r["prompt"])))
    plain = F.concat(F.array(head), F.transform("x", lambda r: r["prompt"]), F.array(tail))
    return by.select(
        scene,
        _joined(timed, default).alias("timed_text"),
        _joined(plain, default).alias("plain_text"),
        F.lit(f"{prefix} {suffix}").alias("global_prompt"),
        F.transform("x", lambda r: F.struct(r["prompt"].alias("prompt"), r["start"].alias("start"), r["end"].alias("end"))).alias("segments"),
        "total_frames",
    )


def encode_lengths(segments: DataFrame, scene: str = "scene_idx") -> DataFrame:
    """(scene, pos, prompt, length): an end not after its start is one frame after it; blank prompts go."""
    kept = segments.where(F.trim("prompt") != "")
    end = F.when(F.col("end") <= F.col("start"), F.col("start") + 1).otherwise(F.col("end"))
    pos = F.row_number().over(Window.partitionBy(scene).orderBy("seq")) - 1
    return kept.select(scene, pos.cast("long").alias("pos"), F.trim("prompt").alias("prompt"), (end - F.col("start")).alias("length"))
