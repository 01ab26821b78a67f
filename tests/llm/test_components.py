"""Components of long chains, where labels that travel hop by hop need hundreds of rounds."""

import random

import pytest

from cuesheet.llm.components import components


@pytest.mark.parametrize("reach", [1, 4])
def test_long_chains(spark, reach):
    names = list(range(2000))
    random.Random(1).shuffle(names)
    chains = [names[:1000], names[1000:1990], names[1990:1992]]
    links = [(c[k], c[k + d]) for c in chains for d in range(1, reach + 1) for k in range(len(c) - d)] + [(names[0], names[0])]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: min(c) for c in chains for x in c}


def test_stars_and_no_links(spark):
    star = [(-5 if k % 2 else 50, k) for k in range(100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {x: (-5 if x % 2 else 0) for x in [*range(100), -5]}
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
