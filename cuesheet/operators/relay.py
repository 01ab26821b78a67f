"""Sharing out a frame budget over segments, and the distance penalties that follow.

Rows are (group, pos, length); everything is a window over one group but
``min_one``, whose steps depend on one another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.scalars import half_even

FLAT_SIGMA = 0.1448


def target_total(total: Column, stride: int, frames: Column) -> Column:
    """The latent frames that a sum of pixel lengths stands for: one at least, the budget at most, all of it if one short."""
    naive = F.greatest(F.lit(1).cast("long"), half_even(total / stride))
    target = F.least(frames, naive)
    return F.when(target >= frames - 1, frames).otherwise(target)


def largest_remainder(lengths: DataFrame, stride: int, frames: int, group: str = "group_id") -> DataFrame:
    """(group, pos, length, share): shares of the target in proportion, whole by largest remainders, ties by position."""
    whole = Window.partitionBy(group)
    summed = lengths.withColumn("total", F.sum("length").over(whole))
    exact = F.col("length") * F.col("target") / F.col("total")
    parts = summed.withColumn("target", target_total(F.col("total"), stride, F.lit(frames).cast("long"))).withColumn("exact", exact).withColumn("low", F.floor("exact"))
    rank = F.row_number().over(whole.orderBy(F.desc(F.col("exact") - F.col("low")), "pos"))
    given = parts.withColumn("share", F.col("low") + F.when(rank <= F.col("target") - F.sum("low").over(whole), 1).otherwise(0))
    return given.select(group, "pos", "length", F.when(F.col("total") <= 0, F.lit(1).cast("long")).otherwise(F.col("share")).alias("share"))


def min_one(shares: DataFrame, group: str = "group_id") -> DataFrame:
    """Shares under one take one from the currently largest share, first one on ties, if that has more than one.

    The steps of a group depend on one another, so they are a fold over its array of shares.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "length", "share")))
    by = shares.groupBy(group).agg(rows.alias("x"))

    def step(acc: Column, i: Column) -> Column:
        most = F.array_position(acc, F.array_max(acc)) - 1
        moved = F.transform(acc, lambda v, j: F.when(j == i, F.lit(1).cast("long")).when(j == most, v - 1).otherwise(v))
        return F.when((F.get(acc, i) < 1) & (F.array_max(acc) > 1), moved).otherwise(acc)

    start = F.transform("x", lambda r: r["share"])
    mended = F.when(F.array_min(start) < 1, F.aggregate(F.sequence(F.lit(0), F.size("x") - 1), start, step)).otherwise(start)
    out = by.withColumn("share", mended).select(group, F.posexplode("x").alias("i", "r"), "share")
    return out.select(group, "r.pos", "r.length", F.get("share", F.col("i")).alias("share"))


def equal_lengths(groups: DataFrame, frames: int, group: str = "group_id") -> DataFrame:
    """Lengths of ``ceil(frames / n)`` for groups that give none."""
    n = F.count("*").over(Window.partitionBy(group))
    return groups.withColumn("length", F.ceil(F.lit(frames) / n).cast("long"))


def budget_clamp(lengths: DataFrame, frames: int, group: str = "group_id", length: str = "length") -> DataFrame:
    """Adds ``effective``: what of each length lies before the end of the budget."""
    upto = F.sum(length).over(Window.partitionBy(group).orderBy("pos"))
    f = F.lit(frames).cast("long")
    return lengths.withColumn("effective", F.greatest(F.least(upto, f) - F.least(upto - F.col(length), f), F.lit(0).cast("long")))


def sigma_of(epsilon: float) -> float:
    return 1.0 / math.log(1.0 / epsilon) if 0 < epsilon < 1 else FLAT_SIGMA


def segment_windows(shares: DataFrame, epsilon: float = 1e-3, group: str = "group_id", share: str = "share") -> DataFrame:
    """(group, pos, share, mid, win, sigma) of each segment with a share."""
    before = F.sum(share).over(Window.partitionBy(group).orderBy("pos")) - F.col(share)
    placed = shares.withColumn("cursor", before).where(F.col(share) > 0)
    mid = F.floor((2 * F.col("cursor") + F.col(share)) / 2)
    return placed.select(group, "pos", share, mid.alias("mid"), F.greatest(F.floor(F.col(share) / 2) - 2, F.lit(0).cast("long")).alias("win"), F.lit(sigma_of(epsilon)).alias("sigma"))


def temporal_cost(windows: DataFrame, frames: int, group: str = "group_id", places: int | None = None) -> DataFrame:
    """(group, frame, pos, cost): each segment with each frame, the squared distance outside its window; rounded, with ``places``.

    A segment makes its own frames, so there is no join; rows are segments times
    ``frames``. Distances are whole, so a row takes its cost from a list by
    distance, which Spark makes once where sigma is a constant; windows farther than ``frames`` from a frame have theirs worked out.
    """

    def paid(far: Column) -> Column:
        cost = far * far / (2 * F.col("sigma") * F.col("sigma"))
        return cost if places is None else F.round(cost, places)

    listed = windows.withColumn("_costs", F.array(*(paid(F.lit(float(k))) for k in range(frames))))
    spread = listed.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(frames - 1).cast("long"))))
    far = F.greatest(F.abs(F.col("frame") - F.col("mid")) - F.col("win"), F.lit(0).cast("long"))
    return spread.select(group, "frame", "pos", F.when(far < frames, F.get("_costs", far.cast("int"))).otherwise(paid(far.cast("double"))).alias("cost"))


def query_frame(q: Column, tokens_per_frame: int | None = None, latent_frames: int | None = None, n_queries: int | None = None) -> Column:
    """The frame of a query token: whole frames where their size is known, a proportion otherwise."""
    return F.floor(q / tokens_per_frame).cast("double") if tokens_per_frame else q * latent_frames / n_queries


def by_place(ranges: DataFrame, windows: DataFrame, group: str = "group_id") -> DataFrame:
    """Segments and token ranges paired by their places; what only one side has goes."""
    return ranges.join(windows, [group, "pos"])


def owned_ranges(segments: DataFrame, group: str = "group_id") -> DataFrame:
    """``segments`` (pos, first, last, ...) with ranges that don't overlap: of those that share a token, the one of the largest ``pos`` keeps it.

    Ranges are cut at all bounds of their group that lie inside them, a piece
    belongs to its last segment, and pieces of one segment that touch are one range again.
    """
    real = segments.where("last > first")
    bounds = real.groupBy(group).agg(F.array_sort(F.array_union(F.collect_set("first"), F.collect_set("last"))).alias("_b"))
    inside = F.filter("_b", lambda x: (x >= F.col("first")) & (x <= F.col("last")))
    pieces = F.transform(F.slice("_c", 1, F.size("_c") - 1), lambda x, i: F.struct(x.alias("k0"), F.get("_c", i + 1).alias("k1")))
    rest = [c for c in segments.columns if c not in (group, "first", "last")]
    cut = real.join(bounds, group).withColumn("_c", inside).select(group, *rest, F.explode(pieces).alias("_p"))
    owner = cut.groupBy(group, F.col("_p.k0").alias("k0")).agg(F.max(F.struct("pos", F.struct(*(c for c in rest if c != "pos")).alias("of"), F.col("_p.k1").alias("k1"))).alias("o"))
    flat = owner.select(group, "k0", "o.k1", "o.pos", "o.of.*")
    order = Window.partitionBy(group).orderBy("k0")
    new = F.when((F.lag("pos").over(order) == F.col("pos")) & (F.lag("k1").over(order) == F.col("k0")), 0).otherwise(1)
    run = flat.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    kept = [F.first(c).alias(c) for c in rest]
    return run.groupBy(group, "_run").agg(F.min("k0").alias("first"), F.max("k1").alias("last"), *kept).select(*segments.columns)


def cost_runs(segments: DataFrame, n_queries: int, tokens_per_frame: int | None = None, latent_frames: int | None = None, group: str = "group_id", overlap: bool = True) -> DataFrame:
    """(group, q_first, q_last, k_first, k_last, cost): the matrix of query tokens and prompt tokens as blocks of equal cost.

    ``segments`` have (pos, mid, win, sigma, first, last). A query's frame is a
    whole one of ``tokens_per_frame`` queries, which then are one run, or ``q *
    latent_frames / n_queries``, a run of one query each; all tokens of a segment's range are one run.
    Blocks that cost nothing are left out. Where ranges overlap, the later
    segment's cost holds; without ``overlap`` they are known not to.
    """
    step = tokens_per_frame or 1
    blocks = -(-n_queries // step)
    own = (owned_ranges(segments, group) if overlap else segments.where("last > first")).select(group, "mid", "win", "sigma", F.col("first").alias("k_first"), (F.col("last") - 1).alias("k_last"))
    spread = own.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    q_first = F.col("_i") * step
    far = F.greatest(F.abs(query_frame(q_first, tokens_per_frame, latent_frames, n_queries) - F.col("mid")) - F.col("win"), F.lit(0.0))
    paid = spread.withColumn("cost", far * far / (2 * F.col("sigma") * F.col("sigma"))).where("cost > 0")
    return paid.select(group, q_first.alias("q_first"), (F.least(q_first + step, F.lit(n_queries).cast("long")) - 1).alias("q_last"), "k_first", "k_last", "cost")


def expanded_runs(runs: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, q, k, cost): every cell of the blocks."""
    by_query = runs.select(group, F.explode(F.sequence("q_first", "q_last")).alias("q"), "k_first", "k_last", "cost")
    return by_query.select(group, "q", F.explode(F.sequence("k_first", "k_last")).alias("k"), "cost")


def token_cost(segments: DataFrame, n_queries: int, tokens_per_frame: int | None = None, latent_frames: int | None = None, group: str = "group_id") -> DataFrame:
    """(group, q, k, cost): what query token ``q`` pays for token ``k`` of a segment's range, for all pairs that pay something."""
    return expanded_runs(cost_runs(segments, n_queries, tokens_per_frame, latent_frames, group), group)


def mask_mode(lq: Column, lk: Column, uncond_only: Column, video_lq: Column, most_tokens: Column) -> Column:
    """Which penalty applies to a pair of lengths: 'video', 'scaled', or none (null)."""
    none = (lq == lk) | uncond_only | (lk == video_lq) | (lk < most_tokens)
    return F.when(none, F.lit(None).cast("string")).when(lq == video_lq, "video").otherwise("scaled")


def token_ranges(prompts: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, pos, first, last): places of each local prompt's tokens behind the global prompt's.

    Tokens are runs without white space; a prompt without any is an error.
    """
    n = F.size(F.filter(F.split("prompt", r"\s+"), lambda w: w != "")).cast("long")
    counted = prompts.withColumn("n", F.when(n > 0, n).otherwise(F.raise_error(F.lit("a local prompt has no tokens")).cast("long")))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("pos"))
    return counted.select(group, "pos", (F.col("global_n") + upto - F.col("n")).alias("first"), (F.col("global_n") + upto).alias("last"))
