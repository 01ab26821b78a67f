"""Codes of vectors: each is cut into ``PARTS`` equal parts, and each part becomes the index of its nearest entry.

Components are whole numbers, ``floor(SCALE * x)``. The codebook of a part
begins as that part of the ``ENTRIES`` smallest ids. In each of ``ROUNDS`` rounds
every part goes to its nearest entry (squared Euclidean distance, ties to the
lower index), and an entry becomes the floor of the mean of its parts,
component by component; an entry without any stays.

The nearest entry is found by annular norm pruning. A part and an entry are at
least as far from each other as their norms are. Entries are sorted by norm;
the one next to the part's norm gives a first distance, a binary search gives
the interval of norms that this distance allows, both ends included, and the
entries in that annulus are compared exactly, as long as the best distance so
far allows them.

All arithmetic is in whole numbers: of 64 bits where that is enough, else of any
size. The sums of a round are one number for each part, entry and component
before the shuffle; only they, and the codebooks, reach the driver. Sums are
sent in limbs of ``LIMB`` bits, so that they cannot overflow.

Vectors that are null or have a null or non-finite component are dropped.
Shorter vectors count as if zeros followed, up to the longest one's length and
a multiple of ``PARTS``; an empty vector is all zeros. Ids that are null come
last, equal ids go by their components; of fewer than ``ENTRIES`` rows all are
entries; without any the result is empty. Repeated rows count each time.
Distances beyond 64 bits are given as the largest number of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, few, fresh, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMB = 60
MOST = (1 << 63) - 1
#: Rows of vectors that are compared at once.
CHUNK = 1 << 14

Codebooks = list[np.ndarray]


def whole_parts(vectors: pa.Array, length: int) -> np.ndarray:
    """(row, part, component): vectors as whole numbers, with zeros up to ``length``."""
    sizes = np.asarray(pc.list_value_length(vectors), np.int64)
    flat = np.asarray(vectors.flatten(), np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * SCALE)
    if float(np.abs(scaled).max(initial=0)) ** 2 * 4 * length < 2**62:
        whole = scaled.astype(np.int64)
    else:  # numbers too large to be scaled as doubles are whole
        whole = np.array([int(s) if math.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.tolist(), flat.tolist(), strict=True)], object)
    x = np.zeros((len(sizes), length), whole.dtype)
    x[np.arange(length) < sizes[:, None]] = whole
    return x.reshape(len(sizes), PARTS, length // PARTS)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Square roots, of numbers of any size as whole numbers."""
    return np.array([math.isqrt(v) for v in squares.tolist()], object) if squares.dtype == object else np.sqrt(squares.astype(np.float64))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row of ``x``; ties to the lower index."""
    large = x.dtype == object or entries.dtype == object
    if large:
        x, entries = x.astype(object), entries.astype(object)
    norms = _roots((entries * entries).sum(1))
    order = np.argsort(norms, kind="stable")
    ring, sorted_ = norms[order], entries[order]
    own = _roots((x * x).sum(1))
    # roots are rounded, so the annulus is a little wider than the distance
    slack = np.full(len(x), 2, object) if large else 1e-9 * (1 + own + ring[-1])
    far = lambda rows, at: ((x[rows] - sorted_[at]) ** 2).sum(1)
    every = np.arange(len(x))
    start = np.minimum(np.searchsorted(ring, own), len(ring) - 1)
    best, index = far(every, start), order[start]
    reach = _roots(best) + slack
    low, high = np.searchsorted(ring, own - reach, "left"), np.searchsorted(ring, own + reach, "right")
    for step in range(int((high - low).max(initial=0))):
        rows = every[low + step < high]
        at = low[rows] + step
        allowed = (np.abs(ring[at] - own[rows]) <= _roots(best[rows]) + slack[rows]).astype(bool)
        rows, at = rows[allowed], at[allowed]
        d = far(rows, at)
        better = ((d < best[rows]) | ((d == best[rows]) & (order[at] < index[rows]))).astype(bool)
        best[rows[better]], index[rows[better]] = d[better], order[at[better]]
    return index, best


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, label, x): the vectors without a null or non-finite component."""
    finite = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return vectors.where(F.col(vector_col).isNotNull() & finite).select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("x"))


def _length(kept: DataFrame) -> int:
    most = kept.agg(F.max(F.size("x"))).first()[0] or 0
    return -(-most // PARTS) * PARTS


def first_codebooks(kept: DataFrame, length: int) -> Codebooks:
    """The parts of the smallest ids."""
    rows = kept.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    x = whole_parts(pa.array([r.x for r in rows], pa.list_(pa.float64())), length)
    return [x[:, p] for p in range(PARTS)]


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for lo in range(0, b.num_rows, CHUNK):
            part = b.slice(lo, CHUNK)
            yield part, whole_parts(part.column("x"), length)


def sums_of(kept: DataFrame, codebooks: Codebooks, length: int) -> DataFrame:
    """(part, entry, place, limb, value): sums of the components of each entry's parts, in limbs; place -1 is their number."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[[0] * (length // PARTS) for _ in c] for c in codebooks]
        counts = [[0] * len(c) for c in codebooks]
        for _, x in _chunks(batches, length):
            for p, entries in enumerate(codebooks):
                index, _ = nearest(x[:, p], entries)
                for e in np.unique(index).tolist():
                    mine = x[index == e, p]
                    counts[p][e] += len(mine)
                    sums[p][e] = [a + int(v) for a, v in zip(sums[p][e], mine.sum(0), strict=True)]
        rows = []
        for p, of in enumerate(counts):
            for e, n in enumerate(of):
                for place, value in enumerate([n, *sums[p][e]] if n else [], -1):
                    limb = 0
                    while not -(1 << LIMB) < value < 1 << LIMB:
                        rows.append((p, e, place, limb, value & ((1 << LIMB) - 1)))
                        value, limb = value >> LIMB, limb + 1
                    rows.append((p, e, place, limb, value))
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "limb", "value"])

    found = kept.select("x").mapInArrow(add, "part long, entry long, place long, limb long, value long")
    return found.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def train(kept: DataFrame, length: int, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks from written vectors (id, label, x)."""
    codebooks = first_codebooks(kept, length)
    for _ in range(rounds if len(codebooks[0]) else 0):
        sums: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums_of(kept, codebooks, length).collect():
            of = sums.setdefault((r.part, r.entry), {})
            of[r.place] = of.get(r.place, 0) + (int(r.value) << LIMB * r.limb)
        moved = [[[sums[p, e][k] // sums[p, e][-1] for k in range(length // PARTS)] if (p, e) in sums else entry.tolist() for e, entry in enumerate(c)] for p, c in enumerate(codebooks)]
        codebooks = [_packed(c, length // PARTS) for c in moved]
    return codebooks


def _packed(rows: list[list[int]], width: int) -> np.ndarray:
    x = np.array(rows, object).reshape(-1, width)
    return x.astype(np.int64) if not x.size or max(abs(int(v)) for v in x.ravel()) ** 2 * 4 * width * PARTS < 2**62 else x


def encode(kept: DataFrame, codebooks: Codebooks, length: int) -> DataFrame:
    """(id, label, code, error): the index of each part as two hex digits, and the sum of the parts' squared distances."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _chunks(batches, length):
            found = [nearest(x[:, p], c) for p, c in enumerate(codebooks)]
            codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
            errors = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array([min(int(e), MOST) for e in errors], pa.int64())], ["id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(assign, f"id {kind['id']}, label {kind['label']}, code string, error long")


def decode(code: str, codebooks: Codebooks) -> list[float]:
    """The vector that a code stands for."""
    return [float(v) / SCALE for p, c in enumerate(codebooks) for v in c[int(code[2 * p : 2 * p + 2], 16)]]


def as_text(codebooks: Codebooks) -> str:
    """All components by part, entry and place."""
    return ",".join(str(int(v)) for c in codebooks for v in c.ravel())


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The codes (id, label, code, error) of all vectors that are not dropped, and the codebooks."""
    kept = cut(kept_vectors(vectors, id_col, vector_col, label_col), "vectors")
    length = _length(kept)
    codebooks = train(kept, length, rounds)
    return encode(kept, codebooks, length), codebooks


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """Adds ``label_error``: the errors summed over rows of equal labels, nulls together."""
    of, total = fresh(coded.columns, "of", "label_error")
    sums = coded.groupBy(F.col(label).alias(of)).agg(F.sum(F.col(error).cast("decimal(38,0)")).alias(total))
    capped = cut(sums.withColumn(total, F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")), "label-errors")
    return coded.join(few(capped), F.col(label).eqNullSafe(F.col(of))).drop(of)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    found = with_label_error(cut(coded, "codes"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.sha2(F.lit(as_text(codebooks)), 256).alias("codebooks_sha256"))


def _oracle() -> str:
    """Rounds are one table expression each."""
    far = "list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i])))"
    own = f"SELECT rid, part, v, entry, d FROM (SELECT rid, part, v, entry, {far} AS d FROM p JOIN {{books}} USING (part)) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) = 1"
    steps = [
        f"k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        f"p AS MATERIALIZED (SELECT rid, part, x[part * len(x) // {PARTS} + 1:(part + 1) * len(x) // {PARTS}] AS v FROM k, range({PARTS}) r(part))",
        f"c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, v AS c FROM p WHERE rid <= {ENTRIES})",
    ]
    for n in range(1, ROUNDS + 1):
        steps += [
            f"a{n} AS MATERIALIZED ({own.format(books=f'c{n - 1}')})",
            f"s{n} AS (SELECT part, entry, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, (SELECT max(len(v)) FROM p) + 1) r(i) GROUP BY 1, 2, 3)",
            f"m{n} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY 1, 2)",
            f"c{n} AS MATERIALIZED (SELECT c{n - 1}.part, c{n - 1}.entry, coalesce(m{n}.c, c{n - 1}.c) AS c FROM c{n - 1} LEFT JOIN m{n} USING (part, entry))",
        ]
    steps += [
        f"z AS MATERIALIZED ({own.format(books=f'c{ROUNDS}')})",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})",
        "f AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY 1)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN f USING (rid), h"


ORACLES = {"op12_vector_codes": _oracle()}
QUERIES = {"op12_vector_codes": op12_vector_codes}
