"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put into an order by a seeded hash and cut into
blocks. The target is the fluid schedule: at any time the sources that still
have blocks are served together, each by its weight's share of those sources'
weights, until its last block is served; from that instant on, which may lie
inside a slot, the others share the rate. Block ``i`` (from 0) of a source may be
released from the slot on in which the fluid schedule begins it, and is due
by the end of the slot in which that ends it. Each slot takes the released
block that is due first. The fluid serves a block one slot's worth inside its
window, and one slot's worth of blocks in each slot, so earliest deadline first
meets all deadlines: at any slot, to the last one, a source has had its target
to within one block, however often sources run out.

With virtual time ``V``, at which a source of weight ``w`` and ``n`` blocks has
been served ``min(n, w V)`` blocks, block ``i`` begins at ``V = i / w``, and the slot
is the sum of what all sources have been served. Weights are exact fractions
brought to whole numbers, and so are all of these sums.

The schedule is made on the driver from one count for each source. It has
``SLOTS`` slots at most, besides one for each source: a block has ``BLOCK``
documents, or as many times that as are needed for so few slots. Documents find
their slots by a join on the place and the number of the block, with a table
that this bounds. What is scheduled are ``MAX_SOURCES`` places: a source's hash
is its place, however few or many sources there are, so nothing changes at some
number of them. Sources in one place, as all are at times beyond that number and
two of ``k`` in about ``k * k / (2 * MAX_SOURCES)`` cases, have the sum of their weights, and their
documents follow one another by virtual time: document ``n`` of a source with
weight ``w`` comes at ``(n + 1/2) / w``. The bound of one block is a place's, and so that of a source alone in its own.

Numbers within a source come from a range sort: no task has all documents of a
source, nor all copies of one document. Documents with equal ids and texts are
interchangeable. A null source counts as the source ''. A source without a
weight has weight 0 and comes after all others; negative weights are an error.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from itertools import accumulate
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, few, fresh, table
from cuesheet.sources.shared import numbered

BLOCK = 16
SLOTS = 1 << 20
MAX_SOURCES = 1 << 16
SEED = 20
#: Exponent of a source's size in its default weight.
TEMPERATURE = 0.5


class Fluid:
    """The target: at virtual time ``V`` a source of weight ``w`` and ``n`` blocks has been served ``min(n, w V)`` blocks."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, Fraction]) -> None:
        scale = lcm(*(w.denominator for w in weights.values()))
        self.weights = {s: int(w * scale) for s, w in weights.items()}
        self.order = sorted(blocks, key=lambda s: Fraction(blocks[s], self.weights[s]))
        self.ends = [(blocks[s], self.weights[s]) for s in self.order]
        self.near = [n / w for n, w in self.ends]
        self.ended = [0, *accumulate(n for n, _ in self.ends)]
        self.rates = [*accumulate((w for _, w in reversed(self.ends)), initial=0)][::-1]

    def slot(self, source: str, i: int) -> tuple[int, int]:
        """When the source has been served ``i`` blocks, as a number of slots: (whole slots, whether there is a rest)."""
        w = self.weights[source]
        # how many sources have ended by then: a guess by rounded numbers, set right by exact ones
        k = bisect_right(self.near, i / w)
        while k < len(self.ends) and self.ends[k][0] * w <= i * self.ends[k][1]:
            k += 1
        while k and self.ends[k - 1][0] * w > i * self.ends[k - 1][1]:
            k -= 1
        whole, rest = divmod(i * self.rates[k], w)
        return self.ended[k] + whole, int(rest > 0)


def earliest_deadlines(blocks: dict[str, int], weights: dict[str, Fraction]) -> Iterator[tuple[str, int]]:
    """The (source, block) of each slot: earliest deadline first among released blocks; ties go by name. All have blocks and weights above 0."""
    fluid = Fluid(blocks, weights)
    waiting = [(0, s, 0) for s in sorted(blocks)]  # (release, source, block)
    ready: list[tuple[int, str, int]] = []
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heappop(waiting)
            heappush(ready, (sum(fluid.slot(s, i + 1)), s, i))
        _, s, i = heappop(ready)
        yield s, i
        if i + 1 < blocks[s]:
            heappush(waiting, (fluid.slot(s, i + 1)[0], s, i + 1))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """The (source, block) of each slot: those with a weight, then the others by equal shares."""
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    left = {s: n for s, n in blocks.items() if n > 0}
    exact = {s: Fraction(weights.get(s, 0)) for s in left}
    for some in ({s: w for s, w in exact.items() if w > 0}, {s: Fraction(1) for s, w in exact.items() if not w}):
        if some:
            yield from earliest_deadlines({s: left[s] for s in some}, some)


def _weighed(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Sources (s, count) with their ``weight``."""
    if weights is None:
        return counts.withColumn("weight", F.col("count") ** TEMPERATURE)
    given = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "s string, weight double")
    return counts.join(given, "s", "left").na.fill({"weight": 0.0})


def _taking_turns(placed: DataFrame, sources: DataFrame, s: str, n: str, group: str) -> DataFrame:
    """``placed`` with ``n`` counting in ``group``, where ``sources`` (s, weight) follow one another by virtual time."""
    name, weight, own = fresh(placed.columns, "name", "weight", "own")
    timed = placed.join(sources.select(F.col("s").alias(name), F.col("weight").alias(weight)), F.col(s) == F.col(name)).drop(name)
    time = F.when(F.col(weight) > 0, (F.col(n) + 0.5) / F.col(weight)).otherwise(F.lit(float("inf")))
    return numbered(timed.withColumn(weight, time).withColumnRenamed(n, own), [group, weight, s, own], n, within=group).drop(weight, own)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, slot_col: str = "mix_slot", order_col: str = "mix_order") -> DataFrame:
    """``docs`` with the slot of each document's block, and a number that orders all documents.

    Without ``weights`` a source's weight is its size to the power ``TEMPERATURE``.
    """
    if any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights must not be negative")
    spark = docs.sparkSession
    s, h, tie, n, j, slot, group = fresh([*docs.columns, slot_col, order_col], "s", "h", "tie", "n", "j", "slot", "group")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    # written once, so that a row keeps its number, which also parts copies of one document
    rows_ = cut(docs.withColumn(tie, F.monotonically_increasing_id()), "rows")
    counts = rows_.groupBy(source.alias("s")).count()
    of_place = lambda c: F.pmod(F.xxhash64(c), F.lit(MAX_SOURCES)).cast("string")
    sources = cut(_weighed(counts, weights), "sources")
    # weights are added in the order of names, whatever the order of rows; a place goes by its first name
    listed = sources.groupBy(of_place("s").alias("place")).agg(F.sum("count").alias("size"), F.array_sort(F.collect_list(F.struct("s", "weight"))).alias("of"))
    total = F.aggregate("of", F.lit(0.0), lambda acc, x: acc + x["weight"])
    places_ = {r.name: r for r in listed.select("place", "size", total.alias("weight"), F.col("of")[0]["s"].alias("name")).collect()}
    block *= max(1, -(-sum(r["size"] for r in places_.values()) // (block * SLOTS)))
    order = schedule({name: -(-r["size"] // block) for name, r in places_.items()}, {name: r.weight for name, r in places_.items()})
    rows = [(places_[name].place, i, at) for at, (name, i) in enumerate(order)]
    slots = spark.createDataFrame(pd.DataFrame(rows, columns=[group, j, slot]), f"{group} string, {j} long, {slot} long")
    marked = rows_.select(tie, source.alias(s), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)).alias(h))
    placed = numbered(marked, [s, h, tie], n, within=s).withColumn(group, of_place(s))
    placed = _taking_turns(placed, sources, s, n, group)
    found = placed.withColumn(j, F.floor(F.col(n) / block)).join(F.broadcast(slots), [group, j])
    places = cut(found.select(tie, F.col(slot).alias(slot_col), (F.col(slot) * block + F.col(n) % block).alias(order_col)), "places")
    return rows_.join(few(places), tie).select(*(F.col(c) for c in docs.columns), slot_col, order_col)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "mix_slot", "mix_order")


QUERIES = {"op2_mixing": op2_mixing}
