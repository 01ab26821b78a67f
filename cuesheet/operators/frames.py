"""Frame sequences: rows (group, frame_idx) with whatever they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.ordered import with_neighbours


def frame_counts(frames: DataFrame, group: str = "seq_id") -> DataFrame:
    return frames.groupBy(group).agg(F.count("*").alias("n_frames"))


def _counted(frames: DataFrame, group: str) -> DataFrame:
    """``frames`` with the number of frames of their group as ``_n``: counted before the shuffle, so that no task has a whole sequence."""
    n = frames.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    return frames.join(n, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def frame_range(frames: DataFrame, start: int = -1, length: int = 1, group: str = "seq_id") -> DataFrame:
    """``length`` frames from ``start`` on (-1: the last), or, for 0 and below, that many before it and itself."""
    at = F.greatest(F.lit(0).cast("long"), F.least(F.col("_n") - 1 if start == -1 else F.lit(start).cast("long"), F.col("_n") - 1))
    if length > 0:
        low, high = at, F.least(at + length, F.col("_n"))
    else:
        low, high = F.greatest(at + length, F.lit(0).cast("long")), at + 1
    return _counted(frames, group).where((F.col("frame_idx") >= low) & (F.col("frame_idx") < high)).drop("_n")


def replace_frame(frames: DataFrame, letter: DataFrame, index: int, value: str, group: str = "seq_id") -> DataFrame:
    """One frame's ``value`` replaced by the group's in ``letter``; an index below 0 counts from the end, and is kept inside."""
    wanted = F.lit(index).cast("long") if index >= 0 else F.col("_n") + index
    at = F.greatest(F.lit(0).cast("long"), F.least(wanted, F.col("_n") - 1))
    new = letter.select(group, F.col(value).alias("_new"))
    joined = _counted(frames, group).join(new, group, "left")
    return joined.withColumn(value, F.when((F.col("frame_idx") == at) & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(value))).drop("_n", "_new")


def tail_frames(frames: DataFrame, n: int, group: str = "seq_id") -> DataFrame:
    return _counted(frames, group).where(F.col("frame_idx") >= F.col("_n") - n).drop("_n")


def without_tail(frames: DataFrame, n: int, group: str = "seq_id") -> DataFrame:
    """All but the last ``n`` frames, none if there are no more than that."""
    return _counted(frames, group).where(F.col("frame_idx") < F.greatest(F.col("_n") - max(n, 0), F.lit(0).cast("long"))).drop("_n")


def encoder_frames(frames: DataFrame, overlap: int = 1, group: str = "seq_id") -> DataFrame:
    """The frames a clip is encoded from: without the frames it shares with the next one."""
    return without_tail(frames, overlap, group)


def first_last(wanted: DataFrame, files: DataFrame, transition: Column) -> DataFrame:
    """Each wanted (i, j) with the files at both places, wrapping around; without a transition the last is the first.

    Without any files both are null.
    """
    at = wanted.withColumn("n_files", files.agg(F.count("*")).scalar())
    at = at.withColumns({"a": F.when(F.col("n_files") > 0, F.pmod("i", F.col("n_files"))), "b": F.when(F.col("n_files") > 0, F.pmod(F.when(transition, F.col("j")).otherwise(F.col("i")), F.col("n_files")))})
    one = files.select(F.col("pos").alias("a"), F.col("name").alias("first_name"))
    two = files.select(F.col("pos").alias("b"), F.col("name").alias("last_name"))
    return at.join(one, "a", "left").join(two, "b", "left").drop("a", "b", "n_files")


def nearest_marker(markers: DataFrame, probes: DataFrame, asset: str = "asset_id") -> DataFrame:
    """Each probe (asset, t, duration, ...) that has a marker near enough, with that marker's ``pos`` and its ``distance``.

    None is near that is farther than ``max(0.2, duration / 100)``. The first of
    equally near markers wins. Only the last marker before a probe and the first
    one behind it can be nearest, so there are no pairs of all probes and markers.
    """
    points = markers.where("sec is not null").groupBy(asset, "sec").agg(F.min("pos").alias("pos"))
    found = with_neighbours(probes, points, asset, "t", "sec", "_before", "_after")
    near = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.sec") - F.col("t")).alias("d"), F.col(f"{side}.pos").alias("pos")))
    best = found.withColumn("_m", F.least(near("_before"), near("_after")))
    close = best.where(F.col("_m.d") <= F.greatest(F.lit(0.2), F.col("duration") / 100))
    return close.select(*probes.columns, F.col("_m.pos").alias("pos"), F.col("_m.d").alias("distance"))
