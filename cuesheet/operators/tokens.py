"""Prompts as tokens of a byte-pair vocabulary, and the range of tokens that each of them takes.

A vocabulary is a table of merge ranks. Text is split into words by a pattern;
within a word, the adjacent two tokens whose union has the lowest rank become
one, the leftmost first, until no union is in the table. Words are made distinct before that,
so each is merged once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how text is split before merges, as the public byte-level vocabularies have it. It leaves out no character.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Merges that a table may have to be broadcast; vocabularies are far smaller.
MOST_RANKS = 1 << 21


def merge_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) from a file with a line for each: the token's bytes in base 64, and its rank."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.unbase64(F.get(parts, F.lit(0))).alias("token"), F.get(parts, F.lit(1)).cast("long").alias("rank"))


def split_words(text: Column | str, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"), F.lit(1))


def merged_tokens(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of one word. Unions wait in a heap by rank and place, so long words take little more than their length."""
    if word in ranks:
        return [word]
    n = len(word)
    end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # by where a token starts
    waiting = [(ranks[word[k : k + 2]], k, k + 2) for k in range(n - 1) if word[k : k + 2] in ranks]
    heapify(waiting)
    end.append(0)
    while waiting:
        _, k, stop = heappop(waiting)
        mid = end[k]
        # tokens that have been merged since make a union out of date
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[k], end[mid] = stop, 0
        if stop < n:
            left[stop] = k
        for a, b in ((left[k], stop), (k, end[stop] if stop < n else 0)):
            if a >= 0 and b and word[a:b] in ranks:
                heappush(waiting, (ranks[word[a:b]], a, b))
    out, k = [], 0
    while k < n:
        out.append(word[k : end[k]])
        k = end[k]
    return out


def token_counts(words: DataFrame, ranks: DataFrame, word: str = "word") -> DataFrame:
    """(word, n): the number of tokens of each distinct word. The table of ranks is broadcast, behind a check of its size."""
    rows = ranks.limit(MOST_RANKS + 1).collect()
    if len(rows) > MOST_RANKS:
        raise ValueError(f"a vocabulary of more than {MOST_RANKS} tokens")
    table = words.sparkSession.sparkContext.broadcast({bytes(r.token): r.rank for r in rows})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(merged_tokens(w.encode(), table.value)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["word", "n"])

    return words.select(F.col(word).alias("word")).where("word is not null").distinct().mapInArrow(count, "word string, n long")


def merged_ranges(prompts: DataFrame, ranks: DataFrame, group: str = "group_id", pattern: str = PATTERN) -> DataFrame:
    """(group, pos, first, last): the tokens that each local prompt adds to the text before it.

    ``prompts`` have (group, pos, global_prompt, prompt). The text is the global
    prompt, and each local prompt behind a space. ``last`` is the number of tokens of the text up to
    a prompt's end, on its own: a word of the whole text may go on across that
    end, and then only the part before it counts, with merges of its own.
    ``first`` is the same for the text before the prompt. A prompt that adds no
    token is an error. Nulls are empty prompts.

    The whole text is split once. A border's tokens are those of all words that
    begin before it, but for the last of them, whose part before the border is a word of its own.
    """
    local = F.concat(F.lit(" "), F.coalesce("prompt", F.lit("")))
    listed = prompts.groupBy(group).agg(F.first(F.coalesce("global_prompt", F.lit(""))).alias("head"), F.array_sort(F.collect_list(F.struct("pos", local.alias("local")))).alias("x"))
    text = F.concat("head", F.array_join(F.transform("x", lambda r: r["local"]), ""))
    words = listed.select(group, F.posexplode(split_words(text, pattern)).alias("i", "word"))
    order = Window.partitionBy(group).orderBy("i")
    placed = words.withColumn("stop", F.sum(F.length("word")).over(order)).select(group, (F.col("stop") - F.length("word")).alias("place"), "stop", "word", F.lit(None).cast(prompts.schema["pos"].dataType).alias("pos"), F.lit(1).alias("kind"))
    # a border for the end of the global prompt, before the first local one, and one for the end of each local prompt
    ends = listed.select(group, F.length("head").cast("long").alias("n"), F.posexplode("x").alias("i", "r"))
    borders = ends.withColumn("place", F.col("n") + F.sum(F.length("r.local")).over(order)).select(group, "place", F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("word"), F.col("r.pos").alias("pos"), F.lit(0).alias("kind"))
    start = listed.select(group, F.length("head").cast("long").alias("place"), F.lit(None).cast("long").alias("stop"), F.lit(None).cast("string").alias("word"), F.lit(None).cast(prompts.schema["pos"].dataType).alias("pos"), F.lit(0).alias("kind"))
    rows = placed.unionByName(borders).unionByName(start)
    # borders come before words that begin there
    upto = Window.partitionBy(group).orderBy("place", "kind", F.col("pos").asc_nulls_first())
    last = F.last(F.when(F.col("kind") == 1, F.struct("place", "stop", "word")), True).over(upto)
    seen = rows.withColumn("_w", last)
    across = (F.col("kind") == 0) & (F.col("_w.stop") > F.col("place"))
    part = F.when(across, F.substring(F.col("_w.word"), F.lit(1), (F.col("place") - F.col("_w.place")).cast("int")))
    seen = seen.withColumn("_part", part).withColumn("_whole", F.when(across, F.col("_w.word")))
    counts = token_counts(seen.select(F.explode(F.array("word", "_part")).alias("word")), ranks)
    named = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n{c}"))
    counted = seen.join(named("word"), "word", "left").join(named("_part"), "_part", "left").join(named("_whole"), "_whole", "left")
    zero = F.lit(0).cast("long")
    total = F.sum(F.coalesce("nword", zero)).over(upto) - F.coalesce("n_whole", zero) + F.coalesce("n_part", zero)
    at = counted.withColumn("_last", total).where("kind = 0")
    before = F.lag("_last").over(Window.partitionBy(group).orderBy("place", F.col("pos").asc_nulls_first()))
    found = at.withColumn("_first", before).where("pos is not null")
    error = F.raise_error(F.lit("a local prompt has no tokens")).cast("long")
    return found.select(group, "pos", F.col("_first").alias("first"), F.when(F.col("_last") > F.col("_first"), F.col("_last")).otherwise(error).alias("last"))
