"""The prefix trie against plain prefixes of lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def token(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    """Result rows of (conv_id, turn, role, text), from all prefixes of all rebuilt conversations."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, token(*pair), pair))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(of) - 1) * words
    out = []
    for k, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(paths[c]) == len(k))
        out.append((min(of), len(k), min(members[k[:-1]]) if k else None, len(of), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows, tmp_path, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "words": F.lit("w"), "base": F.lit(None).cast("int")})
    df.repartition(parts).write.parquet(str(tmp_path / "conversations.parquet"))
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))
    return got


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_trie_of_odd_rows(spark, tmp_path, partitions):
    r = random.Random(5)
    texts = ["a b", "a b", "c", "", None, " \t x y  z", "éé", "0:a"]
    rows = [(c, t, r.choice(["user", "user", None, "0:", ""]), r.choice(texts)) for c in range(150) for t in range(r.choice([0, 1, 2, 3, 4, 9]))]
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 320) for t in range(4)]  # a hot sequence
    rows += [(5, None, "user", "first"), (5, 2, "x", "tie"), (5, 2, "x", "tie"), (None, 1, "user", "none"), (None, None, None, None)]
    rows += [(-3, 0, "u", "below zero"), (-20, 0, "u", "base"), (2**40, 0, "u", "far")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(spark, rows, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark, tmp_path):
    assert check(spark, [], tmp_path) == []


def test_only_turnless(spark, tmp_path):
    """Turns that are replaced by those of a base that isn't there."""
    short = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]
    got = check(spark, [(c, 0, "u", "x") for c in short], tmp_path)
    assert len(got) == 1 and got[0].depth == 0 and got[0].n_convs == len(short)


def test_long_and_many(spark, tmp_path):
    """A conversation of many turns twice, a very long turn, and more conversations in one node than are hashed at once."""
    rows = [(c, t, "u", f"t{t % 7}") for c in (40, 41) for t in range(300)] + [(60, 0, "u", "w " * 500_000), (61, 0, "u", "w " * 500_000)]
    rows += [(1000 + k, 0, "u", "same") for k in range(3 * prefix_trie.ENDS)]
    check(spark, rows, tmp_path)


def test_merge_knows_what_rows_share():
    r = random.Random(2)
    digest = [bytes([k]) * 16 for k in range(3)]
    for _ in range(40):
        paths = [[r.randrange(3) for _ in range(r.choice([0, 1, 2, 5, 8]))] for _ in range(r.randint(1, 60))]
        rows = [(b"".join(digest[t] for t in p), n, [1] * len(p)) for n, p in enumerate(paths)]
        runs, k = [], r.randint(1, 9)
        for lo in range(k):
            mine = sorted(rows[lo::k])
            lcps = [0, *(prefix_trie.common(a[0], b[0]) for a, b in zip(mine, mine[1:], strict=False))]
            step = r.randint(1, 4)
            runs += [(mine[i : i + step], lcps[i : i + step]) for i in range(0, len(mine), step)]
        runs.sort(key=lambda c: c[0][0])
        got = list(prefix_trie.merged(iter(runs)))
        assert [row for row, _ in got] == sorted(rows)
        for (a, _), (b, lcp) in zip(got, got[1:], strict=False):
            assert lcp == prefix_trie.common(a[0], b[0])
