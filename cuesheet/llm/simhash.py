"""SimHash near-dedup over anchors of a covering code.

Fingerprints have 64 bits. They are cut into three blocks of 22, 21 and 21
bits; of two fingerprints that differ in at most ``MAX_DIFF`` = 4 bits, one
block differs in at most one. A block's anchors are the words of a covering
code: the Hamming code on 15 bits, each other bit free, so that every block
value lies within radius 1 of an anchor. A fingerprint is sent to every anchor
within radius + 1 of its block's value; two that differ in one bit of the
block then meet at the anchor next to either. Fingerprints that met are
compared in full.

Equal fingerprints are one row before anything is sent. The rows of an anchor
are dealt into tiles once there are more than ``TILE`` of them, and every two
tiles meet in a cell of their own, so no task needs all rows of an anchor at
once. A cell gives the links of a spanning forest of what it found, at most
one for each of its rows, not all pairs; components are joined up afterwards.

Texts without words (nulls, too) have fingerprint 0 and link like any other;
texts of fewer words than a shingle are one shingle; repeated rows share their
component; ids that are null are left out when the smallest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, discard, few, fresh, table, text_batches
from cuesheet.llm.components import components

MAX_DIFF = 4
SHINGLE = 4
TILE = 4096
#: (first bit, number of bits) of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
RADIUS = 1
HAMMING = 15


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The hashes of the word shingles of a UTF-8 text, repeats included; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(size, len(words)) - 1
    starts = np.concatenate([[0], ends[:-1]]).tolist()[: len(words) - k]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends - 1).tolist()[k:], strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: the bits that more than half of the hashes have; 0 without any."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text."""
    return majority(shingle_hashes(text, size))


def with_fingerprint(docs: DataFrame, text_col: str = "text", fp_col: str = "fp", size: int = SHINGLE) -> DataFrame:
    """Add the fingerprint as a signed 64-bit number."""

    @F.arrow_udf("long")
    def compute(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, size) for t in texts.to_pylist()], np.uint64).view(np.int64))

    text_batches(docs.sparkSession)
    return docs.withColumn(fp_col, compute(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


@cache
def _patterns(bits: int, reach: int) -> list[np.ndarray]:
    """By syndrome, the differences of at most ``reach`` bits that lead to an anchor."""
    by: list[list[int]] = [[] for _ in range(HAMMING + 1)]
    for n in range(reach + 1):
        for places in combinations(range(bits), n):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < HAMMING else 0
            by[syndrome].append(sum(1 << p for p in places))
    return [np.array(x, np.uint64) for x in by]


def syndromes(values: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of the lowest 15 bits: 0 for anchors."""
    out = np.zeros(len(values), np.int64)
    for p in range(HAMMING):
        out ^= ((values >> np.uint64(p)) & np.uint64(1)).astype(np.int64) * (p + 1)
    return out


def anchors(fps: np.ndarray, block: int, reach: int = RADIUS + 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors within ``reach`` of each fingerprint's block."""
    first, bits = BLOCKS[block]
    values = (fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)
    s = syndromes(values)
    rows, found = [], []
    for k, differences in enumerate(_patterns(bits, reach)):
        own = np.nonzero(s == k)[0]
        rows.append(np.repeat(own, len(differences)))
        found.append((values[own][:, None] ^ differences).ravel())
    return np.concatenate(rows), np.concatenate(found)


def forest(fps: np.ndarray, near: int = MAX_DIFF) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) of the components of distinct fingerprints at distance ``near`` or less."""
    n = len(fps)
    linked = np.zeros(n, bool)
    for lo in range(0, n, 512):
        linked[lo : lo + 512] = (np.bitwise_count(fps[lo : lo + 512, None] ^ fps) <= near).sum(1) > 1
    rest = np.sort(fps[linked])
    roots, members = [], []
    while rest.size:
        root, edge, rest = rest[0], rest[:1], rest[1:]
        while edge.size and rest.size:
            reached = np.zeros(rest.size, bool)
            for lo in range(0, edge.size, 512):
                reached |= (np.bitwise_count(edge[lo : lo + 512, None] ^ rest) <= near).any(0)
            edge, rest = rest[reached], rest[~reached]
            members.append(edge)
            roots.append(np.full(edge.size, root))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *roots]), np.concatenate([none, *members])


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whole = np.asarray(b.column(0)).view(np.uint64)
        for lo in range(0, len(whole), 20_000):
            fps = whole[lo : lo + 20_000]
            for block in range(len(BLOCKS)):
                rows, found = anchors(fps, block)
                cell = found.astype(np.int64) << 2 | block
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[rows].view(np.int64))], ["cell", "fp"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to links; a cell is held whole, and has two tiles at most."""
    kept: list[np.ndarray] = []
    here: tuple | None = None

    def close() -> Iterator[pa.RecordBatch]:
        fps = np.unique(np.concatenate(kept))
        if len(fps) > 1:
            a, b = forest(fps)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([np.asarray(b.column(k)) for k in range(3)])
        fps = np.asarray(b.column(3)).view(np.uint64)
        cuts = np.concatenate([[0], 1 + np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0], [len(fps)]])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(key[:, lo].tolist())
            if now != here and kept:
                yield from close()
                kept.clear()
            here = now
            kept.append(fps[lo:hi])
    if kept:
        yield from close()


def near_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links that join every two of the distinct fingerprints ``fp`` at ``MAX_DIFF`` bits or less."""
    sent = cut(fps.mapInArrow(_send, "cell long, fp long"), "anchors")
    large = sent.groupBy("cell").count().where(F.col("count") > tile).select("cell", F.ceil(F.col("count") / tile).cast("long").alias("tiles"))
    # cells of one tile are (0, 0); a row of a larger anchor goes to each pair of tiles that has its own
    dealt = sent.join(large, "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("fp"), "tiles")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    cells = dealt.select("cell", "fp", own.alias("own"), other.alias("other")).select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    out = cut(cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_compare, "a long, b long").distinct(), "links")
    discard(sent)
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, rid: Column | None = None) -> DataFrame:
    """(rid, id, fp, component): each document's fingerprint and the smallest id that its links lead to; rows are numbered unless ``rid`` does it."""
    slim = docs.select((F.monotonically_increasing_id() if rid is None else rid).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = cut(with_fingerprint(slim, "text", "fp", size).drop("text"), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    by_fp = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = by_fp.groupBy("root").agg(F.min("least").alias("component"))
    named = by_fp.join(least, "root").select("fp", "component")
    return marked.join(named, "fp")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the first row of the smallest id (a null id counts as the largest)."""
    (rid,) = fresh(docs.columns, "rid")
    # written, so that a row keeps its number: scans need not be split alike
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    found = near_components(rows, id_col, text_col, size, F.col(rid))
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("best"))
    copies = cut(found.join(best, found["component"].eqNullSafe(best["component"])).where("rid <> best.rid").select(F.col("rid").alias(rid)), "copies")
    return rows.join(few(copies), rid, "left_anti").drop(rid)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op7_simhash": op7_simhash}
