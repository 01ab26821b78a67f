"""The pipeline's near-dedup against all pairs of shingle sets."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuesheet.llm import decontaminate, near_dedup, simhash
from tests.llm.test_exact import ODD


def shingled(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(texts):
    """The first of each component, from all pairs."""
    sets, root = [shingled(t) for t in texts], list(range(len(texts)))
    near = [[b for b in range(len(texts)) if jaccard(sets[a], sets[b]) >= 0.8] for a in range(len(texts))]
    for _ in texts:
        root = [min(root[b] for b in near[a]) for a in range(len(texts))]
    return {i for i, x in enumerate(root) if x == i}


def varied(r, text, changes):
    w = text.split()
    for k in r.sample(range(len(w)), changes):
        w[k] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_go(spark, make, corpus):
    r = random.Random(4)
    long = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(20)]
    texts = ODD + corpus[:10] + long + [varied(r, t, n) for n in (1, 2, 3, 4, 6) for t in long] + [long[0], long[0].upper()]
    want = kept(texts)
    docs = make(texts).withColumn("rid", F.lit(1)).withColumn("size", F.lit(2))
    got = corpus_pipeline.deduplicate_documents(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(want)
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_texts_of_a_million_characters(spark, make):
    """Whole texts are compared: what differs at the end counts as much as what differs at the beginning."""
    r = random.Random(11)
    long = " ".join(f"w{r.randrange(90_000)}" for _ in range(170_000))
    other = " ".join(f"w{r.randrange(90_000)}" for _ in range(60_000))
    half = long[: len(long) // 2] + " " + other
    texts = [long, long + " end", half, varied(r, long, 3000), "x" * 1_000_000, "y " * 500_000]
    got = [x.doc_id for x in near_dedup.keep_one(make(texts)).collect()]
    assert sorted(got) == sorted(kept(texts)) == [0, 2, 4, 5]
    fps = {x.id: x.fp for x in simhash.near_components(make(texts)).collect()}
    assert fps[0] != fps[2] and len(fps) == len(texts)
    windows = make([(0, long), (1, other + " " + " ".join(long.split()[-30:]))])
    items = spark.createDataFrame([(7, " ".join(long.split()[-12:]))], "item_id long, text string")
    found = {x.c0: x.items for x in decontaminate.contamination(windows, items, carry=("doc_id",)).collect()}
    assert found == {0: ["7"], 1: ["7"]}


@pytest.mark.parametrize("tile", [1024, 3])
def test_tiles_agree(spark, make, corpus, tile):
    r = random.Random(7)
    texts = [varied(r, corpus[k] + " " + corpus[k + 1], r.choice([0, 0, 1, 1, 2])) for k in range(4) for _ in range(12)]
    rows = near_dedup.cut(make(texts).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("id"), "text"), "rows")
    groups = {}
    for x in near_dedup.near_rows(rows, tile).collect():
        groups.setdefault(x.root, []).append(x.id)
    assert {min(g) for g in groups.values()} == kept(texts)


def test_anchors_are_candidates_that_are_compared(spark, make, corpus):
    """Fingerprints that meet at an anchor are compared in full; without bands their links are what is left."""
    r = random.Random(8)
    long = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(8)]
    texts = [*long, *(varied(r, t, 1) for t in long), *(t + " and more" for t in long), None, "", "x y"]
    hashes = [near_dedup.shingle_hashes((t or "").encode(), 5) for t in texts]
    fps = [near_dedup.majority(h) for h in hashes]
    sets = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "row long, fp long")
    found = near_dedup.anchored(sets)
    joined = lambda links: {min(b for b in range(len(texts)) if linked(links, a, b)) for a in range(len(texts))}

    def linked(links, a, b):
        seen, edge = {a}, [a]
        while edge:
            x = edge.pop()
            more = {v for p in links if x in p for v in p} - seen
            seen |= more
            edge += more
        return b in seen

    want = [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    got = [tuple(x) for x in found.collect()]
    assert joined(got) == joined(want) and len(want) > 4
    tables = spark.createDataFrame([(i, bytearray(near_dedup.np.unique(h).tobytes())) for i, h in enumerate(hashes)], "row long, shingles binary")
    near = {tuple(x) for x in near_dedup.verified(found, tables).collect()}
    assert near == {(a, b) for a, b in got if jaccard(shingled(texts[a]), shingled(texts[b])) >= 0.8}


def test_pairs_of_similarity_08_share_a_band():
    r = random.Random(2)
    met = 0
    for _ in range(300):
        both = [r.getrandbits(64) for _ in range(160)]
        a, b = (near_dedup.np.unique(near_dedup.np.array(both + [r.getrandbits(64) for _ in range(20)], "u8")) for _ in range(2))
        met += bool(set(near_dedup.bands_of(a)) & set(near_dedup.bands_of(b)))
    assert met >= 299
