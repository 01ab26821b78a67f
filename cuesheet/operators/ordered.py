"""Neighbours in a sorted order that no task holds whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.sources.shared import cut, few


def with_neighbours(probes: DataFrame, points: DataFrame, key: str, at: str, point: str, before: str = "before", after: str = "after") -> DataFrame:
    """``probes`` (key, at, ...) with the nearest ``points`` (key, point, ...) on either side, as structs of their columns.

    ``before`` is the last point up to the probe, ``after`` the first one from it
    on; null where there is none. Points of equal keys and places have to be one.

    Probes and points are sorted together by ranges, so a hot key is spread over
    its places. Each range finds its own neighbours by windows. What lies beyond
    it comes from one row for each range that a key is in: the first and the last point
    there, carried over from range to range, and broadcast if these rows are few.
    So there are no pairs of probes and points, and no task has all of a key.
    Probes without a key or a place have no neighbours.
    """
    fields = [c for c in points.columns if c != key]
    # points come first where places are equal, for 'before'; 'after' looks at the place itself
    mark = F.struct(F.col(point).alias("_at"), *(F.col(c) for c in fields))
    both = probes.select(F.struct(*probes.columns).alias("_probe"), F.col(key).alias("_key"), F.col(at).cast("double").alias("_place"), F.lit(None).cast(points.select(mark.alias("m")).schema["m"].dataType).alias("_point"))
    both = both.unionByName(points.select(F.lit(None).cast(both.schema["_probe"].dataType).alias("_probe"), F.col(key).alias("_key"), F.col(point).cast("double").alias("_place"), mark.alias("_point")))
    order = ["_key", "_place", F.col("_probe").isNotNull()]
    sorted_ = cut(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_row", 33)
    own = Window.partitionBy("_key", "_part").orderBy("_row")
    upto, onwards = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    here = sorted_.withColumn("_part", part).withColumns({"_before": F.last("_point", True).over(upto), "_after": F.first("_point", True).over(onwards)})
    ends = sorted_.groupBy("_key", part.alias("_part")).agg(F.min("_point").alias("_first"), F.max("_point").alias("_last"))
    parts = Window.partitionBy("_key").orderBy("_part")
    earlier = F.last("_last", True).over(parts.rowsBetween(Window.unboundedPreceding, -1))
    later = F.first("_first", True).over(parts.rowsBetween(1, Window.unboundedFollowing))
    carried = cut(ends.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), earlier.alias("_earlier"), later.alias("_later")), "carried")
    found = here.where("_probe is not null").join(few(carried), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    known = F.col("_key").isNotNull() & F.col("_place").isNotNull()
    # a point at the probe's own place is sorted before it, and is the first one from there on as well
    same = F.col("_prior._at").cast("double") == F.col("_place")
    out = found.withColumns({"_prior": F.coalesce("_before", "_earlier"), "_next": F.coalesce("_after", "_later")})
    return out.select("_probe.*", F.when(known, F.col("_prior").dropFields("_at")).alias(before), F.when(known, F.when(F.coalesce(same, F.lit(False)), F.col("_prior")).otherwise(F.col("_next")).dropFields("_at")).alias(after))
