"""Markers to segments, and segments to frame budgets.

Every relation carries the asset it belongs to and the position of a row in
it; all windows are partitioned by asset.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.scalars import align_down, align_up, half_even, truncated
from cuesheet.sources.shared import cut, dealt

MOST_MARKERS = 64
SHORTEST_TAIL = 0.1
EDGE = 0.001


def dedup_markers(markers: DataFrame, asset: str = "asset_id") -> DataFrame:
    """(asset, pos, sec, total): clamped into the asset; of those in one millisecond the first stays."""
    clamped = markers.withColumn("sec", F.greatest(F.least("sec", F.col("total") - EDGE), F.lit(0.0)))
    bucket = Window.partitionBy(asset, half_even(F.col("sec") * 1000)).orderBy("pos")
    return clamped.withColumn("_n", F.row_number().over(bucket)).where("_n = 1").drop("_n")


def first_markers(markers: DataFrame, most: int = MOST_MARKERS, asset: str = "asset_id") -> DataFrame:
    """The ``most`` earliest markers of each asset, numbered from 1."""
    n = F.row_number().over(Window.partitionBy(asset).orderBy("sec", "pos"))
    return markers.withColumn("n", n.cast("long")).where(F.col("n") <= most)


def intervals(assets: DataFrame, markers: DataFrame, asset: str = "asset_id") -> DataFrame:
    """(asset, idx, s, e, n): what lies between 0, the markers and the end; empty intervals are left out."""
    points = markers.select(asset, "sec").unionByName(assets.select(asset, F.explode(F.array(F.lit(0.0), F.greatest("total", F.lit(0.0)))).alias("sec")))
    by = Window.partitionBy(asset).orderBy("sec")
    pairs = points.select(asset, F.col("sec").alias("s"), F.lead("sec").over(by).alias("e")).where("e > s")
    order, whole = Window.partitionBy(asset).orderBy("s"), Window.partitionBy(asset)
    return pairs.withColumn("idx", F.row_number().over(order).cast("long")).withColumn("n", F.count("*").over(whole))


def trim_edges(segments: DataFrame, skip_first: bool = False, keep_tail: bool = True) -> DataFrame:
    """Without the first segment, without the last, and then without a last one that is too short."""
    low, high = (2 if skip_first else 1), (F.col("n") if keep_tail else F.col("n") - 1)
    kept = segments.where((F.col("idx") >= low) & (F.col("idx") <= high))
    return kept.where(~((F.col("idx") == high) & (F.col("e") - F.col("s") < SHORTEST_TAIL)))


def or_whole(segments: DataFrame, assets: DataFrame, asset: str = "asset_id") -> DataFrame:
    """(asset, idx, s, e): an asset that has no segment left is one segment."""
    both = assets.select(asset, F.greatest("total", F.lit(0.0)).alias("_end")).join(segments.select(asset, "s", "e"), asset, "full")
    order = Window.partitionBy(asset).orderBy("s")
    filled = both.select(asset, F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("e", "_end").alias("e"))
    return filled.select(asset, F.row_number().over(order).cast("long").alias("idx"), "s", "e")


def cut_points(step: float) -> Callable[[Column, Column], Column]:
    """A function of two columns: start, start + step, ... by repeated addition, and the end."""

    @F.arrow_udf("array<double>")
    def walk(starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for start, end in zip(starts.to_pylist(), ends.to_pylist(), strict=True):
            points = np.full(max(1, int(np.ceil((end - start) / step)) + 1), step)
            points[0] = start
            points = np.add.accumulate(points)  # one addition after the other
            out.append(np.append(points[points < end], end) if end > start else points[:1])
        return pa.array(out, pa.list_(pa.float64()))

    return walk


def average_split(segments: DataFrame, step: float, asset: str = "asset_id") -> DataFrame:
    """The span of each asset's segments anew, in pieces of ``step`` seconds; the last one is shorter."""
    spans = segments.groupBy(asset).agg(F.min("s").alias("a"), F.max("e").alias("b"))
    points = spans.select(asset, cut_points(float(step))(F.col("a"), F.col("b")).alias("p"))
    pieces = points.select(asset, F.posexplode(F.expr("transform(slice(p, 1, greatest(size(p) - 1, 0)), (x, i) -> struct(x as s, p[i + 1] as e))")).alias("i", "x"))
    return pieces.select(asset, (F.col("i") + 1).cast("long").alias("idx"), "x.s", "x.e")


def build_segments(assets: DataFrame, markers: DataFrame, skip_first: bool = False, keep_tail: bool = True, step: float | None = None, most: int = MOST_MARKERS, asset: str = "asset_id") -> DataFrame:
    """(asset, idx, s, e) from raw markers: all of the above in order.

    Assets and the markers kept are written first, and dealt to as many tasks as their rows ask for.
    """
    assets, kept = cut(assets, "assets"), cut(first_markers(dedup_markers(markers, asset), most, asset), "markers")
    assets, kept = dealt(asset, 2 * assets.count() + kept.count(), assets, kept)
    out = or_whole(trim_edges(intervals(assets, kept, asset), skip_first, keep_tail), assets, asset)
    return out if step is None or step <= 0 else or_whole(average_split(out, step, asset), assets, asset)


def frame_plan(segments: DataFrame, fps: int = 24, base: int = 8, overlap: int = 1, asset: str = "asset_id") -> DataFrame:
    """(asset, idx, d, aligned, frames, start): whole multiples of ``base`` frames for each segment.

    What alignment lost is added to the last segment, which is aligned upwards;
    ``start`` is the second at which a segment's frames begin.
    """
    whole = Window.partitionBy(asset)
    order = whole.orderBy("idx")
    d = segments.withColumn("d", F.col("e") - F.col("s")).withColumn("al", align_down(truncated(F.col("d") * fps), base))
    total = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    summed = d.withColumn("missing", truncated(total * fps) - F.sum("al").over(whole)).withColumn("n", F.count("*").over(whole)).withColumn("k", F.row_number().over(order))
    last = F.col("k") == F.col("n")
    aligned = summed.withColumn("aligned", F.when(last, align_up(F.col("al") + F.col("missing"), base)).otherwise(F.col("al")))
    before = F.coalesce(F.sum("aligned").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seconds = F.when(last, F.col("aligned") / fps).otherwise(F.col("d"))
    return aligned.select(asset, "idx", seconds.alias("d"), "aligned", (F.col("aligned") + overlap).alias("frames"), (before / fps).alias("start"))


def sample_window(plan: DataFrame, rate: int, n_samples: str = "n_samples", pad: float = 0.5) -> DataFrame:
    """Adds first and end sample of each planned segment, with ``pad`` seconds more, inside the asset."""
    first = F.least(truncated(F.col("start") * rate), F.col(n_samples))
    return plan.withColumn("first_sample", first).withColumn("end_sample", F.least(F.col("first_sample") + truncated((F.col("d") + pad) * rate), F.col(n_samples)))


def whole_or_windows(windows: DataFrame, assets: DataFrame, overlap: int = 1, n_samples: str = "n_samples", asset: str = "asset_id") -> DataFrame:
    """(asset, idx, first_sample, end_sample, frames): ``windows``, and for assets without any segment, as segment 0, all samples and ``overlap`` frames.

    ``windows`` are those of ``sample_window``; ``assets`` have (asset, n_samples).
    """
    both = assets.select(asset, F.col(n_samples).cast("long").alias("_all")).join(windows.select(asset, "idx", "first_sample", "end_sample", "frames"), asset, "full")
    long = lambda v: F.lit(v).cast("long")
    whole = {"idx": long(0), "first_sample": long(0), "end_sample": F.col("_all"), "frames": long(overlap)}
    return both.select(asset, *(F.when(F.col("idx").isNull(), v).otherwise(F.col(c)).alias(c) for c, v in whole.items()))


def slice_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """A slice starts at 0 or later and has one sample at least."""
    first = F.greatest(F.lit(0).cast("long"), start)
    return first, F.greatest(end, first + 1)


def loop_window(counts: DataFrame, use_scene: Column, start: Column, end: Column) -> DataFrame:
    """Adds chosen count, start and loops: the start inside the list, an end of 0 meaning all; the end is exclusive."""
    n = F.when(use_scene, F.col("scene_n")).otherwise(F.col("audio_n"))
    out = counts.withColumn("n", n).withColumn("start", F.when(F.col("n") > 0, F.greatest(F.lit(0).cast("long"), F.least(start, F.col("n") - 1))).otherwise(F.lit(0).cast("long")))
    stop = F.when(end == 0, F.col("n")).otherwise(end)
    return out.withColumn("loops", F.when(F.col("n") > 0, F.greatest(F.lit(0).cast("long"), stop - F.col("start"))).otherwise(F.lit(0).cast("long")))


def loops_v1(n: Column, start: Column, end: Column) -> Column:
    """The first version's loop count, which compares the end with what is left after the start; one at least."""
    left = n - start
    return F.greatest(F.lit(1).cast("long"), F.when((end > 0) & (end < left), end - start).otherwise(left))


def select_v1(segments: DataFrame, start: int, end: int, fps: int = 24, asset: str = "asset_id") -> DataFrame:
    """(asset, durations_text, loops, start_frames, start_s): whole seconds by line, and frames in multiples of 8 before ``start``."""
    rows = segments.groupBy(asset).agg(F.array_sort(F.collect_list(F.struct("idx", "s", "e"))).alias("x"))
    frames = F.aggregate(F.slice("x", 1, max(start, 0)), F.lit(0).cast("long"), lambda acc, r: acc + align_down((r["e"] - r["s"]) * fps, 8))
    text = F.array_join(F.transform("x", lambda r: half_even(r["e"] - r["s"]).cast("string")), "\n")
    loops = loops_v1(F.size("x").cast("long"), F.lit(start).cast("long"), F.lit(end).cast("long"))
    return rows.withColumn("start_frames", frames).select(asset, text.alias("durations_text"), loops.alias("loops"), "start_frames", (F.col("start_frames") / fps).alias("start_s"))


def durations_v2(segments: DataFrame) -> DataFrame:
    """Adds the duration to two places."""
    return segments.withColumn("duration", F.bround(F.col("e") - F.col("s"), 2))
