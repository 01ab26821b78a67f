"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): the smallest node that can be reached.

    Each round gives the nodes a new random order and hooks every node to the
    first one among itself and its neighbours; pointers are followed to their
    ends, and links between different ends are the next round's. A node with a
    neighbour stays an end in half of the cases at most, whatever the shape of
    the links, so about the logarithm of the number of nodes is the number of
    rounds, and their tables shrink; a round with links joins two nodes at
    least, so the loop ends. Chains of pointers follow a random order downwards
    and are short. Tables are written to the shared folder, so lineage
    stays short; those of earlier rounds are removed.
    """
    one_way = links.where("a <> b")
    edges = cut(one_way.select("a", "b").union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels, turn = None, 0
    while labels is None or not edges.isEmpty():
        order = lambda name: F.struct(F.xxhash64(F.lit(turn), name).alias("order"), F.col(name).alias("node"))  # noqa: B023, E731
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min(order("b")).alias("first"))
        after = cut(hooks.select("node", F.least("first", order("node"))["node"].alias("root")), "hooks")
        while True:
            up, before = after.select("node", "root"), after
            above = up.select(F.col("node").alias("root"), F.col("root").alias("above"))
            after = cut(up.join(above, "root").select("node", F.col("root").alias("was"), F.col("above").alias("root")), "hooks")
            discard(before)
            if after.where("was <> root").isEmpty():
                break
        up = after.select("node", "root")
        if labels is None:
            labels = cut(up, "labels")
        else:
            named = labels.join(up.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
            before, labels = labels, cut(named.select("node", F.coalesce("above", "root").alias("root")), "labels")
            discard(before)
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("c")), "a").join(up.select(F.col("node").alias("b"), F.col("root").alias("d")), "b")
        before, edges = edges, cut(ends.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).distinct(), "links")
        discard(before, after)
        turn += 1
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    out = cut(labels.join(least, "root").select("node", F.col("least").alias("root")), "labels")
    discard(labels, edges)
    return out
