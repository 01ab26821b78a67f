"""SuperMinHash near-dedup: texts whose sets of word shingles are alike, ``100 * both >= PERCENT * either``.

A SuperMinHash signature has ``BANDS * ROWS`` places. Every element of a set has
its own random order of the places, and gives its ``j``-th place the value ``j``
plus a random fraction; a place keeps its smallest value. So the elements'
ranks at a place are no independent draws but parts of one permutation each, which
lowers the variance of the signature. Values of round ``j`` are at least ``j``: once
no place has a value of ``j`` or more, later rounds change nothing, and the
signature of a large set takes little more than one round.

Equal sets are one row before anything is sent. Sets that agree in a band of
``ROWS`` places share a cell; two sets of similarity ``s`` do in one of the bands
with probability ``1 - (1 - s ** ROWS) ** BANDS``, over 0.999999 for 0.85. All
links are verified on the full sets, in two steps. First every row meets the
first row of its cells, its pivot, once however many cells they share: copies
by the thousand are then one component, for work in proportion to their number.
Then only cells with several components are left. In those the rows
outside the pivot's component meet one another and the pivot's, in tiles of at
most ``TILE`` rows or ``WEIGHT`` shingles each, so no task needs a whole cell; no two rows of
one component meet, and a row is linked once with each component.

Components are joined up by rounds of hooking and shortcuts over the links, the
distributed form of union-find, which is also what a tile does with its own.

Texts are lower-cased (A to Z) and split at white space. Fewer words than
``SHINGLE`` are one shingle; a text without words, null or not, has the empty
set and is linked with nothing. Repeated rows have equal sets. Null ids are left out when
the smallest is taken; a component of nulls only has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, discard, few, fresh, table, text_batches
from cuesheet.llm.components import components
from cuesheet.llm.simhash import shingle_hashes

SHINGLE = 3
PERCENT = 85
BANDS = 24
ROWS = 5
PLACES = BANDS * ROWS
TILE = 1024
WEIGHT = 1 << 20
#: Elements of a set that go through the rounds together.
CHUNK = 1 << 12
_U = np.uint64
_FAR = np.iinfo(np.uint64).max


def _draw(elements: np.ndarray, turn: int) -> np.ndarray:
    """64 random bits of each element for a round."""
    x = elements + _U((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signature(elements: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The SuperMinHash of distinct 64-bit elements: round and fraction of the smallest value at each place."""
    low = np.full(places, _FAR, np.uint64)
    last = places - 1  # the last round that can still lower a value
    for lo in range(0, len(elements), CHUNK):
        own = elements[lo : lo + CHUNK]
        every = np.arange(len(own))
        order = np.tile(np.arange(places, dtype=np.uint16), (len(own), 1)) if last else None
        turn = 0
        while turn <= last:
            bits = _draw(own, turn)
            pick = turn + ((bits & _U(0xFFFFFFFF)) * _U(places - turn) >> _U(32)).astype(np.int64)
            if order is None:
                place = pick
            else:
                place = order[every, pick]
                order[every, pick] = order[:, turn]
            np.minimum.at(low, place, _U(turn << 32) | (bits >> _U(32)))
            last = min(last, int(low.max() >> _U(32)))
            turn += 1
    return low


def bands_of(elements: np.ndarray) -> list[int]:
    """A signed hash of each band of the signature; none for the empty set."""
    if not len(elements):
        return []
    flat = signature(elements).tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(flat[step * k : step * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64).tolist()


def both(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    at[at == len(long)] = len(long) - 1 if len(long) else 0
    return int((long[at] == short).sum()) if len(long) else 0


def alike_sizes(a: F.Column, b: F.Column, percent: int) -> F.Column:
    """Whether sets of these sizes can be alike at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): the ``pairs`` (x, y) whose ``sets`` (row, shingles) are alike."""

    @F.arrow_udf("boolean")
    def alike(one: pa.Array, other: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(one, other, strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            n = both(a, b)
            out.append(100 * n >= percent * (len(a) + len(b) - n))
        return pa.array(out, pa.bool_())

    of = lambda c: sets.select(F.col("row").alias(c), F.col("shingles").alias(f"of_{c}"))
    return pairs.join(of("x"), "x").join(of("y"), "y").where(alike("of_x", "of_y")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def tile_links(sets: list[np.ndarray], roots: list[int], outer: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links between sets of different ``roots``, at least one of them ``outer``; one for each two components that any joins."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    group = np.unique(np.array(roots), return_inverse=True)[1].reshape(-1)
    out = []
    for x in np.nonzero(outer)[0].tolist():
        mine = codes[starts[x] : starts[x] + sizes[x]]
        mark[mine] = 1
        n = np.add.reduceat(mark[codes], starts)
        mark[mine] = 0
        near = np.nonzero((100 * n >= percent * (sizes[x] + sizes - n)) & (group != group[x]))[0]
        for g in np.unique(group[near]).tolist():
            out.append((x, int(near[group[near] == g][0])))
            group[group == g] = group[x]
    return out


def _compare(percent: int):
    """Rows (cell, kind, i, j, row, root, outer, shingles) sorted by the first four to links (a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        roots: list[int] = []
        outer: list[bool] = []
        sets: list[np.ndarray] = []
        here = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                found = tile_links(sets, roots, outer, percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([rows[p[k]] for p in found], pa.int64()) for k in range(2)], ["a", "b"])

        for batch in batches:
            for cell, kind, i, j, row, root, out, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (cell, kind, i, j) != here:
                    yield from close()
                    rows, roots, outer, sets, here = [], [], [], [], (cell, kind, i, j)
                rows.append(row)
                roots.append(root)
                outer.append(out)
                sets.append(np.frombuffer(held, np.uint64))
        yield from close()

    return compare


def crossed(cells: DataFrame, tile: int = TILE, weight: int = WEIGHT) -> DataFrame:
    """(cell, kind, i, j, row, root, outer): rows of ``cells`` (cell, row, n, root, pivot_root), dealt so that all that have to meet do.

    Kind 0 has a tile of rows outside the pivot's component and one of rows in
    it, kind 1 two tiles of outer rows, or the same one.
    """
    outer = F.col("root") != F.col("pivot_root")
    tiles = lambda own: F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.when(own, 1)) / tile), F.ceil(F.sum(F.when(own, F.col("n")).otherwise(0)) / weight)).cast("long")
    plan = cut(cells.groupBy("cell").agg(tiles(outer).alias("outers"), tiles(~outer).alias("inners")), "plan")
    rows = cells.join(few(plan), "cell").withColumn("outer", outer)
    place = F.pmod(F.xxhash64(F.lit(11), "row"), F.when(F.col("outer"), F.col("outers")).otherwise(F.col("inners")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("place")
    among = F.transform(upto(F.col("outers")), lambda k: cell(1, F.least(own, k), F.greatest(own, k)))
    against = F.transform(upto(F.col("inners")), lambda k: cell(0, own, k))
    inside = F.transform(upto(F.col("outers")), lambda k: cell(0, k, own))
    to = F.when(F.col("outer"), F.concat(among, against)).otherwise(inside)
    return rows.withColumn("place", place).select("cell", F.explode(to).alias("t"), "row", "root", "outer").select("cell", "t.*", "row", "root", "outer")


def meetings(sent: DataFrame) -> DataFrame:
    """(cell, row, n, pivot, pivot_n): the rows of ``sent`` (cell, row, n) in cells of several, with the first row of the cell."""
    first = F.min(F.struct("row", "n")).alias("pivot")
    shared = sent.groupBy("cell").agg(F.count("*").alias("rows"), first).where("rows > 1")
    cells = cut(shared.select("cell", F.col("pivot.row").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "cells")
    out = cut(sent.join(few(cells), "cell"), "met")
    discard(cells)
    return out


def set_links(met: DataFrame, sets: DataFrame, percent: int = PERCENT, tile: int = TILE, weight: int = WEIGHT) -> DataFrame:
    """(node, root): components of the rows of ``met`` (cell, row, n, pivot, pivot_n) whose ``sets`` (row, shingles) are alike; rows without a link are left out."""
    star = met.where((F.col("row") != F.col("pivot")) & alike_sizes(F.col("n"), F.col("pivot_n"), percent)).select(F.col("row").alias("x"), F.col("pivot").alias("y")).distinct()
    stars = cut(star, "stars")
    first = cut(verified(stars, sets, percent), "links")
    roots = components(first)
    rooted = lambda c, name: few(roots).select(F.col("node").alias(c), F.col("root").alias(name))
    named = met.join(rooted("row", "root"), "row", "left").join(rooted("pivot", "pivot_root"), "pivot", "left")
    marked = cut(named.select("cell", "row", "n", F.coalesce("root", "row").alias("root"), F.coalesce("pivot_root", "pivot").alias("pivot_root")), "marked")
    # cells of one component are done, and of cells with the same rows one is enough
    open_ = marked.groupBy("cell").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high"), *(F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"m{k}") for k in range(2)))
    left = cut(open_.where("low <> high").groupBy("rows", "m0", "m1").agg(F.min("cell").alias("cell")).select("cell"), "open")
    rest = cut(marked.join(few(left), "cell", "left_semi"), "rest")
    dealt = crossed(rest, tile, weight)
    columns = ["cell", "kind", "i", "j", "row", "root", "outer", "shingles"]
    tiles = dealt.join(sets, "row").select(*columns).repartition("cell", "kind", "i", "j").sortWithinPartitions("cell", "kind", "i", "j")
    second = cut(tiles.mapInArrow(_compare(percent), "a long, b long").distinct(), "links")
    out = components(first.union(second)) if not second.isEmpty() else roots
    discard(stars, first, marked, left, rest, second)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE, weight: int = WEIGHT) -> DataFrame:
    """(rid, id, n, component): the size of each document's set, and the smallest id that its links lead to."""
    text_batches(docs.sparkSession)

    @F.arrow_udf("struct<set binary, n long, bands array<long>>")
    def sketch(texts: pa.Array) -> pa.Array:
        found = [np.unique(shingle_hashes(t, size)) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in found], pa.binary()), pa.array([len(h) for h in found], pa.int64()), pa.array([bands_of(h) for h in found], pa.list_(pa.int64()))], ["set", "n", "bands"]
        )

    @F.arrow_udf("binary")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t, size)).tobytes() for t in texts.to_pylist()], pa.binary())

    # written, so that a row keeps its number: scans need not be split alike
    rows = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rows")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    marked = cut(rows.select("rid", "id", sketch(text).alias("s")).select("rid", "id", "s.*"), "sketches")
    one = cut(marked.where("n > 0").groupBy("set").agg(F.min("rid").alias("row")), "sets")
    chosen = marked.join(one.select(F.col("row").alias("rid")), "rid", "left_semi")
    sent = cut(chosen.select(F.col("rid").alias("row"), "n", F.explode("bands").alias("cell")), "bands")
    met = meetings(sent)
    discard(sent)
    involved = cut(met.select(F.col("row").alias("rid")).distinct(), "involved")
    sets = cut(rows.join(few(involved), "rid", "left_semi").select(F.col("rid").alias("row"), hashes(text).alias("shingles")), "shingles")
    discard(rows)
    roots = set_links(met, sets, percent, tile, weight).withColumnRenamed("node", "row")
    discard(met, sets, involved)
    named = one.join(roots, "row", "left").select("set", F.coalesce("root", "row").alias("root"))
    found = cut(marked.select("rid", "id", "set", "n").join(named, "set", "left").select("rid", "id", "n", F.coalesce("root", "rid").alias("root")), "found")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    out = found.join(least, "root").select("rid", "id", "n", "component")
    discard(marked, one)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component: the first row of the smallest id (a null id counts as the largest)."""
    (rid,) = fresh(docs.columns, "rid")
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
    found = near_components(rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(rid).alias("rid")).alias("id"), F.col(text_col).alias("text")), "id", "text", size, percent)
    copies = cut(found.where("id.rid <> component.rid").select(F.col("id.rid").alias(rid)), "copies")
    return rows.join(few(copies), rid, "left_anti").drop(rid)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


_ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS rid, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, array_to_string(ws[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(1, len(ws) - {SHINGLE - 1}) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON a = x.rid JOIN n y ON b = y.rid WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid, rid AS at FROM d UNION SELECT r.rid, e.b FROM r JOIN e ON r.at = e.a),
c AS (SELECT r.rid, min(d.doc_id) AS component_id FROM r JOIN d ON r.at = d.rid GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)"""

ORACLES = {"op11_minhash": _ORACLE}
QUERIES = {"op11_minhash": op11_minhash}
