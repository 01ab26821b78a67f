"""Vector codes against plain loops over Python's whole numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import vector_codes


def plain(rows):
    """(id, label, code, error) and codebooks of rows (id, vector, label), every distance computed."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    floors = [[math.floor(4096 * float(x)) if math.isfinite(4096 * float(x)) else int(x) * 4096 for x in v] + [0] * (8 * width - len(v)) for _, v, _ in kept]
    parts = [[w[p * width : (p + 1) * width] for w in floors] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books, found = [p[:16] for p in parts], None
    for step in range(7):
        found = [[min((far(v, c), e) for e, c in enumerate(book)) for v in of] for of, book in zip(parts, books, strict=True)]
        if step < 6:
            for p in range(8):
                for e in range(len(books[p])):
                    mine = [v for v, (_, k) in zip(parts[p], found[p], strict=True) if k == e]
                    books[p] = [[sum(c) // len(mine) for c in zip(*mine, strict=True)] if k == e and mine else b for k, b in enumerate(books[p])]
    out = [(i, label, "".join(f"{found[p][n][1]:02x}" for p in range(8)), min(sum(found[p][n][0] for p in range(8)), 2**63 - 1)) for n, (i, _, label) in enumerate(kept)]
    return out, [[[int(x) for x in c] for c in b] for b in books]


def check(spark, rows, tmp_path, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"x": F.lit(1), "of": F.lit("a"), "label_error": F.lit(None).cast("int"), "part": F.lit(2)})
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    want, books = plain(rows)
    got = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    total = {label: min(sum(e for _, x, _, e in want if x == label), 2**63 - 1) for label in {w[1] for w in want}}
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    assert Counter(map(tuple, got)) == Counter((i, code, e, total[label], digest) for i, label, code, e in want)
    return got


def test_vectors_with_odd_rows(spark, tmp_path):
    r = random.Random(3)
    some = lambda: [float(np.float32(r.gauss(0, 0.4))) for _ in range(24)]
    rows = [(i, some(), r.choice([1, 1, 1, 2, None])) for i in range(90)]
    rows += [(200 + k, rows[0][1], 1) for k in range(40)]  # one vector many times
    rows += [(3, some(), 2), (3, some(), 2), (None, some(), 5), (1000, None, 1), (1001, [], 1), (1002, [0.5] * 20, None)]
    rows += [(1003, [0.1] * 23 + [None], 1), (1004, [math.nan] * 24, 1), (1005, [math.inf] + [0.0] * 23, 2), (1006, [-math.inf] * 24, 2)]
    got = check(spark, rows, tmp_path)
    assert len(got) == len(rows) - 5


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, tmp_path, n):
    check(spark, [(n - i, [i / 7.0] * 8, i) for i in range(n)], tmp_path, "float")


def test_no_vector_is_kept(spark, tmp_path):
    assert check(spark, [(1, None, 1), (2, [math.nan], None)], tmp_path) == []


def test_large_numbers_are_exact(spark, tmp_path):
    r = random.Random(4)
    check(spark, [(i, [r.choice([1.0, 3e9, -1e30, 1e306, 0.25]) * r.random() for _ in range(8)], 1) for i in range(30)], tmp_path)


def test_annulus_equals_all_distances():
    """Entries of equal norms and equal distances included."""
    r = np.random.default_rng(6)
    for _ in range(30):
        width = int(r.integers(1, 6))
        entries = r.integers(-4, 5, (int(r.integers(1, 17)), width))
        x = np.concatenate([r.integers(-6, 7, (200, width)), entries, -entries])
        d = ((x[:, None] - entries) ** 2).sum(2)
        for a, b in ((x, entries), (x.astype(object), entries)):
            index, best = vector_codes.nearest(a, b)
            assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_stand_for_their_entries(spark):
    df = spark.createDataFrame([(i, [i * 0.25] * 16) for i in range(16)], "v long, e array<float>")
    coded, books = vector_codes.compress(df, "v", "e", None, rounds=0)
    for row in coded.collect():
        assert row.error == 0 and vector_codes.decode(row.code, books) == [row.id * 0.25] * 16
