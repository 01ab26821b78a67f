"""Token ranges against a library that counts each growing text on its own."""

import base64
import os
import random

import pytest
import tiktoken
from pyspark.errors import PySparkException

from cuesheet.operators import tokens
from cuesheet.plans.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.isfile(VOCABULARY), reason="no vocabulary")
SCHEMA = "group_id long, pos long, global_prompt string, prompt string, first string"


@pytest.fixture(scope="module")
def encoding():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def small():
    """Bytes and a few unions, of white space above all."""
    unions = [b"  ", b" a", b"   ", b"    ", b"at", b" \n", b"\n\n", b"cat", b"it", b"     ", b"it's", b"  \n"]
    return tiktoken.Encoding("small", pat_str=tokens.PATTERN, mergeable_ranks={**{bytes([k]): k for k in range(256)}, **{u: 256 + k for k, u in enumerate(unions)}}, special_tokens={})


@pytest.mark.parametrize("own", [True, False])
def test_ranges_of_growing_texts(spark, encoding, own, tmp_path):
    """With the small vocabulary, tokens go across the ends of prompts."""
    r = random.Random(8)
    encoding = small() if own else encoding
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(k) + b" %d\n" % v for k, v in encoding._mergeable_ranks.items()))
    pieces = ["a", "cat's", "  ", "\n", " \n\n ", "it's  ", "12 3", "　x", "été", "日本語", "...!?", "don't", "\t", "I'LL", " ", "word" * 20]
    prompt = lambda: "".join(r.choice(pieces) + r.choice(["", " "]) for _ in range(r.randint(1, 5)))
    rows, want, crossed = [], [], 0
    for g in range(60):
        head = r.choice([prompt(), prompt() + "   ", "", None])
        built, before = head or "", len(encoding.encode_ordinary(head or ""))
        for pos in range(r.randint(1, 6)):
            text = prompt()
            n = len(encoding.encode_ordinary(f"{built} {text}"))
            if n <= before:
                continue
            rows.append((g, pos, head, text, "x"))
            crossed += n != before + len(encoding.encode_ordinary(f" {text}"))
            built += f" {text}"
            want.append((g, pos, before, n))
            before = n
    found = tokens.merged_ranges(spark.createDataFrame(rows, SCHEMA).repartition(5), tokens.merge_ranks(spark, str(path)))
    assert sorted(map(tuple, found.collect())) == want and (crossed > 10 or not own)


def test_no_tokens_is_an_error(spark):
    """Two spaces are one token, as many as the first space alone."""
    ranks = spark.createDataFrame([(bytearray([k]), k) for k in range(256)] + [(bytearray(b"  "), 256)], "token binary, rank long")
    assert tokens.merged_ranges(spark.createDataFrame([], SCHEMA), ranks).count() == 0
    with pytest.raises(PySparkException, match="no tokens"):
        tokens.merged_ranges(spark.createDataFrame([(1, 0, "a ", "", None)], SCHEMA), ranks).collect()


def test_merges_of_long_words(encoding):
    ranks = encoding._mergeable_ranks
    r = random.Random(9)
    for n in [*range(1, 12), 200, 3000]:
        for letters in ("ab", "thein ", "aé日"):
            word = "".join(r.choice(letters) for _ in range(n)).encode()
            got = tokens.merged_tokens(word, ranks)
            assert b"".join(got) == word
            while len(word) < 300:  # one merge after the other, by search
                parts = [word[k : k + 1] for k in range(len(word))] if word not in ranks else [word]
                while True:
                    near = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
                    if not near:
                        break
                    k = min(near)[1]
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                assert got == parts
                break
