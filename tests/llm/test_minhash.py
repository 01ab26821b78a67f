"""SuperMinHash near-dedup against all pairs of shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import minhash
from tests.llm.test_exact import ODD, save
from tests.llm.test_near_dedup import varied


def shingled(text):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def plain(docs):
    """(id, size, component, kept) from (id, text) by comparing all pairs."""
    sets = [shingled(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        ids = [x for x in (i, least.get(top(k))) if x is not None]
        least[top(k)] = min(ids) if ids else None
    return [(i, len(sets[k]), least[top(k)], i == least[top(k)]) for k, (i, _) in enumerate(docs)]


def corpus(r):
    long = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(60, 200))) for _ in range(12)]
    texts = ODD + long + [varied(r, t, n) for n in (1, 2, 3, 4, 6, 9) for t in long] + [long[0]] * 3 + [long[1].upper(), "a b", "A  b", "a b c", "one"]
    for _ in range(25):  # a chain of revisions
        texts.append(varied(r, texts[-1] if len(texts[-1]) > 50 else long[3], 3))
    return texts + [varied(r, long[5], k % 5) for k in range(60)]  # a group of near copies


def test_op_equals_all_pairs(spark, make, tmp_path):
    r = random.Random(3)
    texts = corpus(r)
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, "nobody else has this text"), (7, texts[30]), (7, texts[30])]
    save(make(docs).withColumns({"rid": F.lit(1), "n": F.lit("x"), "root": F.lit(None).cast("int")}), tmp_path, "documents")
    got = [tuple(x) for x in minhash.op11_minhash(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain(docs)))


@pytest.mark.parametrize(("tile", "weight"), [(3, 1 << 20), (1024, 500)])
def test_tiles_lose_no_link(spark, make, tile, weight):
    r = random.Random(9)
    docs = list(enumerate(corpus(r)))
    found = minhash.near_components(make(docs), tile=tile, weight=weight).select("id", "n", "component").collect()
    assert sorted(map(tuple, found)) == sorted(x[:3] for x in plain(docs))


def test_rows_that_have_to_meet_do(spark):
    """Of a cell: outer rows with all, in tiles; rows of the pivot's component not with one another."""
    rows = [(c, 100 * c + k, 10, k if k % 3 == 0 else 1, 1) for c in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "cell long, row long, n long, root long, pivot_root long")
    met = {}
    for x in minhash.crossed(df, tile=5).collect():
        met.setdefault((x.cell, x.kind, x.i, x.j), []).append((x.row, x.outer))
    pairs = {(a, b) for of in met.values() for a, oa in of for b, ob in of if a < b and (oa or ob)}
    outer = {x[1] for x in rows if x[3] != 1}
    assert pairs == {(a, b) for *_, a in [(c, r) for c, r, *_ in rows] for b in [x[1] for x in rows] if a < b and a // 100 == b // 100 and (a in outer or b in outer)}
    assert max(map(len, met.values())) < 40
    inner = {k: sum(not o for _, o in of) for k, of in met.items()}
    assert all(k[1] == 0 for k, n in inner.items() if n)


def test_keep_one(spark, make):
    texts = corpus(random.Random(4))
    docs = make([*enumerate(texts), (None, texts[30])]).withColumn("id", F.lit(3)).withColumn("rid", F.lit(3))
    got = minhash.keep_one(docs)
    assert got.columns == docs.columns
    want = {c for _, _, c, _ in plain(list(enumerate(texts)))}
    assert sorted(x.doc_id for x in got.collect()) == sorted(want)
    assert minhash.keep_one(docs.limit(0)).count() == 0 == minhash.near_components(docs.limit(0)).count()


def test_very_long_texts(spark, make):
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(90_000)}" for _ in range(170_000))
    docs = [(0, long), (1, long + " end"), (2, varied(r, long, 4000)), (3, varied(r, long, 30_000)), (4, "x" * 1_000_000)]
    found = {x.id: x.component for x in minhash.near_components(make(docs)).collect()}
    assert found == {i: c for i, _, c, _ in plain(docs)} and found[2] == 0 and found[3] == 3


def direct(elements, places):
    """All rounds of all elements, one by one."""
    low = [2**64 - 1] * places
    for x in elements:
        order = list(range(places))
        for j in range(places):
            bits = int(minhash._draw(np.array([x], np.uint64), j)[0])
            k = j + ((bits & 0xFFFFFFFF) * (places - j) >> 32)
            order[j], order[k] = order[k], order[j]
            low[order[j]] = min(low[order[j]], j << 32 | bits >> 32)
    return low


@pytest.mark.parametrize("n", [1, 3, 40, 400, 5000])
def test_early_end_changes_nothing(n):
    x = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64))
    assert minhash.signature(x, 24).tolist() == direct(x, 24)


def test_signatures_estimate_similarity_with_less_variance():
    """Of small sets, the share of equal places varies less than that of as many independent draws."""
    r, err = np.random.default_rng(1), []
    for _ in range(400):
        x = r.integers(0, 1 << 63, 60, np.uint64)
        a, b = minhash.signature(x[:50]), minhash.signature(x[10:])
        err.append((a == b).mean() - 40 / 60)
    independent = (2 / 3) * (1 / 3) / minhash.PLACES
    assert abs(np.mean(err)) < 0.006 and np.var(err) < 0.75 * independent


def test_pairs_of_similarity_085_share_a_band():
    r = random.Random(2)
    for _ in range(400):
        both = [r.getrandbits(64) for _ in range(170)]
        a, b = (np.unique(np.array(both + [r.getrandbits(64) for _ in range(15)], "u8")) for _ in range(2))
        assert set(minhash.bands_of(a)) & set(minhash.bands_of(b))
