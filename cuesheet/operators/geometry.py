"""Sizes and choices: what is resized, cropped or picked, as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.scalars import align_down, half_even

#: Noise schedules by number of steps.
SIGMAS = {
    4: [14.6146, 6.4746, 1.9074, 0.4255, 0.0],
    6: [14.6146, 9.4268, 6.4746, 3.9665, 1.9074, 0.4255, 0.0],
    8: [14.6146, 11.6742, 9.4268, 7.5958, 6.0729, 3.9665, 1.9074, 0.6472, 0.0],
}


def base_size(df: DataFrame, base: int, w: str = "w", h: str = "h") -> DataFrame:
    """Adds sizes floored to multiples of ``base``, and half of each."""
    out = df.withColumn("base_w", align_down(w, base)).withColumn("base_h", align_down(h, base))
    return out.withColumn("half_w", F.floor(F.col("base_w") / 2)).withColumn("half_h", F.floor(F.col("base_h") / 2))


def swapped(df: DataFrame, swap: Column, w: str = "w", h: str = "h") -> DataFrame:
    return df.withColumns({w: F.when(swap, F.col(h)).otherwise(F.col(w)), h: F.when(swap, F.col(w)).otherwise(F.col(h))})


def fit_max_side(df: DataFrame, most: int, base: int, w: str = "w", h: str = "h") -> DataFrame:
    """Adds the size scaled to a longest side of ``most``, and the centred crop of it whose sides are multiples of ``base``."""
    scale = F.lit(float(most)) / F.greatest(w, h)
    out = df.withColumns({"scaled_w": half_even(F.col(w) * scale), "scaled_h": half_even(F.col(h) * scale)})
    out = out.withColumns({"crop_w": align_down("scaled_w", base), "crop_h": align_down("scaled_h", base)})
    return out.withColumns({"left": F.floor((F.col("scaled_w") - F.col("crop_w")) / 2), "top": F.floor((F.col("scaled_h") - F.col("crop_h")) / 2)})


def downscale_even(df: DataFrame, factor: int, w: str = "w", h: str = "h") -> DataFrame:
    """Adds sides divided by a whole number from 1 to 100, odd ones made even upwards, 2 at least."""
    if not 1 <= factor <= 100:
        raise ValueError("the factor must be from 1 to 100")
    side = lambda c: F.greatest(F.floor(F.col(c) / factor) + F.floor(F.col(c) / factor) % 2, F.lit(2).cast("long"))
    return df.withColumns({"small_w": side(w), "small_h": side(h)})


def cover_crop(df: DataFrame, to_w: int, to_h: int, w: str = "w", h: str = "h") -> DataFrame:
    """Adds the smallest size of the same shape that covers the target (the size itself where a side fits already), and where the centred crop begins."""
    same = (F.col(w) == to_w) | (F.col(h) == to_h)
    wider = F.col(w) / F.col(h) > to_w / to_h
    big_w = F.when(same, F.col(w)).when(wider, F.col(w) * to_h / F.col(h)).otherwise(F.lit(to_w)).cast("long")
    big_h = F.when(same, F.col(h)).when(wider, F.lit(to_h)).otherwise(F.col(h) * to_w / F.col(w)).cast("long")
    out = df.withColumns({"cover_w": big_w, "cover_h": big_h})
    return out.withColumns({"crop_left": F.floor((F.col("cover_w") - to_w) / 2), "crop_top": F.floor((F.col("cover_h") - to_h) / 2)})


def pick(index: Column, *inputs: Column) -> Column:
    """The input with that number, from 1; the first one where there is none."""
    return F.coalesce(F.try_element_at(F.array(*inputs), index.cast("int")), inputs[0])


def sigmas(steps: Column) -> Column:
    """The fixed schedule for a number of steps; null for others."""
    out = F.lit(None).cast("array<double>")
    for n, values in SIGMAS.items():
        out = F.when(steps == n, F.array(*(F.lit(v) for v in values))).otherwise(out)
    return out
