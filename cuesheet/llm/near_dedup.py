"""Near-dedup of texts whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Shingles of ``SHINGLE`` words are 64-bit hashes; equal sets are one row before
anything is sent. Candidates come from two sides. One is the SimHash operator:
fingerprints of these shingles that meet at an anchor of its covering code and
differ in few bits. But at a similarity of 0.8 about ten of 64 bits differ, and
a bound wide enough for nearly all such pairs is met by unrelated texts, too;
so for the rest there is MinHash: ``BANDS`` bands of ``ROWS`` minima each, and
sets that agree in a band share a cell. Two sets of similarity ``s`` share one
with probability ``1 - (1 - s ** ROWS) ** BANDS``: over 0.9999 for 0.8. Cells of
one set, and all but one of the cells that hold the same sets, go. All
candidates are compared in full, so no link is below ``SIMILAR``.

A cell with more than ``TILE`` sets, or ``WEIGHT`` shingles, is dealt into tiles,
and every two tiles meet in a cell of their own, so no task needs all of them
at once. A cell gives the links of a spanning forest, not all pairs.

Texts without words (nulls, too) have the empty set and are alike; texts of
fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, discard, few, fresh, text_batches
from cuesheet.llm.components import components
from cuesheet.llm.simhash import majority, near_links, shingle_hashes

SIMILAR = 0.8
SHINGLE = 5
BANDS = 24
ROWS = 5
TILE = 1024
WEIGHT = 1 << 20
_R = np.random.default_rng(5)
_XOR = _R.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _R.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes: np.ndarray) -> list[int]:
    """A signed hash of each band of minima; none for the empty set."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 1 << 12):
        part = hashes[lo : lo + (1 << 12)]
        for k in range(BANDS * ROWS):
            low[k] = min(low[k], (((part ^ _XOR[k]) * _TIMES[k]) >> np.uint64(20)).min())
    flat = low.tobytes()
    return np.array([xxhash.xxh64_intdigest(flat[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def forest(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Links of the components of sets with Jaccard ``similar`` or more; each set is linked once at most."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(sizes)
    own = [flat[a:b] for a, b in zip(ends - sizes, ends, strict=True)]
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    rest, out = np.arange(len(sets)), []

    def without(gone: np.ndarray) -> None:
        """Takes sets out of ``rest``, and their shingles out of ``flat``."""
        nonlocal rest, flat
        flat, rest = flat[~np.repeat(gone, sizes[rest])], rest[~gone]

    while rest.size:
        edge = [int(rest[0])]
        without(np.arange(rest.size) == 0)
        while edge and rest.size:
            x = edge.pop()
            mark[own[x]] = 1
            both = np.add.reduceat(mark[flat], np.cumsum(sizes[rest]) - sizes[rest])
            mark[own[x]] = 0
            near = both >= similar * (sizes[x] + sizes[rest] - both) - 1e-9
            if near.any():
                found = rest[near].tolist()
                out += [(x, k) for k in found]
                edge += found
                without(near)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, i, j, row, shingles) sorted by cell to links; a cell is held whole, and has two tiles at most."""
    rows: list[int] = []
    sets: list[np.ndarray] = []
    here = None

    def close() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            found = forest(sets)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[p[k]] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

    for batch in batches:
        for cell, i, j, row, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (cell, i, j) != here:
                yield from close()
                rows, sets, here = [], [], (cell, i, j)
            rows.append(row)
            sets.append(np.frombuffer(held, np.uint64))
    yield from close()


def anchored(sets: DataFrame) -> DataFrame:
    """(x, y): candidates out of ``sets`` (row, fp): rows of one fingerprint, and of fingerprints that meet at an anchor."""
    first = cut(sets.groupBy("fp").agg(F.min("row").alias("rep")), "fingerprints")
    same = sets.join(first, "fp").where("row <> rep").select(F.col("row").alias("x"), F.col("rep").alias("y"))
    near = near_links(first.select("fp"))
    at = lambda c, name: first.select(F.col("fp").alias(c), F.col("rep").alias(name))
    return cut(same.union(near.join(at("a", "x"), "a").join(at("b", "y"), "b").where("x <> y").select("x", "y")), "anchored")


def verified(pairs: DataFrame, sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b): the ``pairs`` (x, y) whose ``sets`` (row, shingles) have a Jaccard similarity of ``similar`` or more."""

    @F.arrow_udf("boolean")
    def alike(one: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one.to_pylist(), other.to_pylist(), strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= similar * (len(a) + len(b) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    of = lambda c: sets.select(F.col("row").alias(c), F.col("shingles").alias(f"of_{c}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").where(alike("of_x", "of_y")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_rows(rows: DataFrame, tile: int = TILE, weight: int = WEIGHT) -> DataFrame:
    """(rid, id, set, root) of written ``rows`` (rid, id, text): equal roots for rows that links join; ``set`` is equal for equal sets."""
    text_batches(rows.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")

    @F.arrow_udf("struct<set binary, fp long, size long, bands array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        all_ = [shingle_hashes(t, SHINGLE) for t in texts.to_pylist()]
        found = [np.unique(h) for h in all_]
        fps = np.array([majority(h) for h in all_], np.uint64).view(np.int64)
        return pa.StructArray.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array(fps), pa.array([len(h) for h in found], pa.int64()), pa.array([bands_of(h) for h in found], pa.list_(pa.int64()))],
            ["set", "fp", "size", "bands"],
        )

    @F.arrow_udf("binary")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t, SHINGLE)).tobytes() for t in texts.to_pylist()], pa.binary())

    marked = cut(rows.select("rid", "id", sketch(text).alias("s")).select("rid", "id", "s.*"), "sketches")
    # one row stands for all of an equal set
    one = cut(marked.groupBy("set").agg(F.min("rid").alias("row")), "sets")
    chosen = cut(marked.join(one.select(F.col("row").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("row"), "fp", "size", "bands"), "chosen")
    pairs = anchored(chosen.select("row", "fp"))
    sent = cut(chosen.select("row", "size", F.explode("bands").alias("cell")), "bands")
    shared = sent.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("held"), *(F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"m{k}") for k in range(2))).where("n > 1")
    cells = cut(shared.groupBy("n", "held", "m0", "m1").agg(F.min("cell").alias("cell")).select("cell", F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("held") / weight)).cast("long").alias("tiles")), "cells")
    members = cut(sent.join(cells, "cell").select("cell", "tiles", "row"), "members")
    discard(chosen, sent)
    involved = cut(members.select(F.col("row").alias("rid")).union(pairs.select("x")).union(pairs.select("y")).distinct(), "involved")
    sets = cut(rows.join(few(involved), "rid", "left_semi").select(F.col("rid").alias("row"), hashes(text).alias("shingles")), "shingles")
    # cells of one tile are (0, 0); a row of a larger cell goes to each pair of tiles that has its own
    own = F.pmod(F.xxhash64("row"), "tiles")
    dealt = members.select("cell", "row", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    met = dealt.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "row").join(sets, "row")
    sorted_ = met.select("cell", "i", "j", "row", "shingles").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    links = cut(verified(pairs, sets).union(sorted_.mapInArrow(_compare, "a long, b long")).distinct(), "links")
    discard(members, sets, pairs, cells)
    roots = components(links).withColumnRenamed("node", "row")
    named = one.join(roots, "row", "left").select("set", F.coalesce("root", "row").alias("root"))
    return marked.select("rid", "id", "set").join(named, "set")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the first row of the smallest id (a null id counts as the largest)."""
    (rid,) = fresh(docs.columns, "rid")
    # written, so that a row keeps its number: scans need not be split alike
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    found = near_rows(rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best"))
    copies = cut(found.join(best, "root").where("rid <> best.rid").select(F.col("rid").alias(rid)), "copies")
    return rows.join(few(copies), rid, "left_anti").drop(rid)
