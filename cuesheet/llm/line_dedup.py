"""Line dedup: repeated runs of lines by a suffix array over line ids.

A run is one or more consecutive lines of a document with ``MIN_WORDS`` words
or more together. A line is deleted if it lies in a run that also starts
earlier, in a document with a smaller id or higher up in the same one (a null
id comes last, equal ids are ordered by their rows' places in the scan).

Lines get ids; only lines that occur twice can be in a repeated run, so the
sequences are the stretches of such lines. Their suffixes are sorted by prefix
doubling: the rank of the first ``2k`` lines of a suffix is the place of the
pair of ranks of ``k`` lines, here and ``k`` lines on, in the sorted order of all
such pairs, a distributed sort; it ends once the ranks tell apart as many lines
as the longest of the shortest runs has. Neighbours in the array get their
longest common prefix by going down the levels of ranks. Where it is shorter
than the shortest run at a suffix, an interval of the array ends: all suffixes
of an interval begin with one repeated run. Its first start stays, and the runs
at its other starts are deleted. The array holds the stretches in reverse order,
too, for the runs up to each line. Together they cover the later copies of
all maximal repeated runs: a line of such a copy either begins a shortest run
inside it, or is in the one that the copy ends with. Overlapping intervals are
merged in order, by a running maximum of their ends.

Everything is joins, sorts and windows of DataFrames. The windows hold the
repeated lines of one document at a time, or a slice of the array, sorted, and
spill. A frequent line is counted before the shuffle; where it is joined,
adaptive execution splits it.

A null text stays null. An empty text is one empty line. A text whose lines are
all deleted becomes empty; its row stays, like every other row and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, discard, few, fresh, table
from cuesheet.sources.shared import numbered

MIN_WORDS = 10
WORD = r"[^\x20\x09-\x0D]+"
#: Places of the array in a slice that one window looks at.
SLICE = 1 << 16
#: Runs to delete up to which they are broadcast to the texts (two numbers each).
FEW_RUNS = 1 << 20


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(rid, id, pos, h1, h2, words) of rows (rid, id, text): each line with 128 bits of its hash and its number of words."""
    split = docs.select("rid", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.select("rid", "id", F.col("pos").cast("long").alias("pos"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))


def ranked(keys: DataFrame, label: str) -> DataFrame:
    """Distinct ``keys`` (a, b) with ``rank``: numbers from 1 in their sorted order, with gaps between partitions."""
    return cut(keys.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id() + 1), label)


def stretches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, id, seg, pos, rank, words): the stretches of repeated lines that have ``min_words`` words or more."""
    every = cut(numbered_lines(docs), "lines")
    twice = every.groupBy(F.col("h1").alias("a"), F.col("h2").alias("b")).count().where("count > 1").select("a", "b")
    names = ranked(twice, "names").select(F.col("a").alias("h1"), F.col("b").alias("h2"), "rank")
    # written, so that the lines reach the windows by an exchange of their own: the join of a frequent line can then be split
    lines = cut(every.join(names, ["h1", "h2"]).drop("h1", "h2"), "repeated")
    placed = lines.withColumn("seg", F.col("pos") - F.row_number().over(Window.partitionBy("rid").orderBy("pos")))
    whole = F.sum("words").over(Window.partitionBy("rid", "seg"))
    out = cut(placed.withColumn("whole", whole).where(F.col("whole") >= min_words).drop("whole"), "stretches")
    discard(every, names, lines)
    return out


def shortest_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``lines`` with ``size``: the number of lines of the shortest run from each on that has ``min_words`` words; null without one."""
    own = Window.partitionBy("rid", "seg")
    upto = lines.withColumn("upto", F.sum("words").over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    ends = upto.withColumns({
        "first_end": F.min(F.when(F.col("upto") >= min_words, F.col("pos"))).over(own),
        "next_end": F.min("pos").over(own.orderBy(F.desc("upto")).rangeBetween(Window.unboundedPreceding, -min_words)),
        "seg_start": F.min("pos").over(own),
    })
    end = F.when(F.col("pos") == F.col("seg_start"), F.col("first_end")).otherwise(F.lag("next_end").over(own.orderBy("pos")))
    return ends.withColumn("size", end - F.col("pos") + 1).drop("upto", "first_end", "next_end", "seg_start", "words")


def doubled(lines: DataFrame, longest: int) -> list[DataFrame]:
    """(rid, seg, pos, rank) by level: ``rank`` orders the first ``2 ** level`` lines of the suffixes, up to ``longest`` lines; a stretch's end comes first."""
    levels = [cut(lines.select("rid", "seg", "pos", "rank"), "level")]
    while 1 << (len(levels) - 1) < longest:
        later = F.lead("rank", 1 << (len(levels) - 1)).over(Window.partitionBy("rid", "seg").orderBy("pos"))
        pairs = cut(levels[-1].withColumn("b", F.coalesce(later, F.lit(0).cast("long"))).withColumnRenamed("rank", "a"), "pairs")
        names = ranked(pairs.select("a", "b").distinct(), "ranks")
        levels.append(cut(pairs.join(names, ["a", "b"]).select("rid", "seg", "pos", "rank"), "level"))
        discard(pairs, names)
    return levels


def suffix_array(suffixes: DataFrame) -> DataFrame:
    """(place, rank, ...) in the order of ``rank``, which is unique."""
    return cut(numbered(suffixes, "rank", "place"), "array")


def neighbour_lcp(array: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(place, lcp): how many lines the suffix at each place (rid, pos) shares with the one before it.

    Their ranks differ at the last level, so the prefix is shorter than that level's blocks.
    """
    side = lambda k, by: array.select((F.col("place") + by).alias("place"), F.col("rid").alias(f"rid{k}"), F.col("pos").alias(f"pos{k}"))
    out = cut(side(0, 1).join(side(1, 0), "place").withColumn("lcp", F.lit(0).cast("long")), "neighbours")
    for level in reversed(range(len(levels) - 1)):
        for k in (0, 1):
            at = levels[level].select(F.col("rid").alias(f"rid{k}"), F.col("pos").alias("at"), F.col("rank").alias(f"rank{k}"))
            out = out.withColumn("at", F.col(f"pos{k}") + F.col("lcp")).join(at, [f"rid{k}", "at"], "left").drop("at")
        same = F.when(F.col("rank0") == F.col("rank1"), F.lit(1 << level)).otherwise(0)
        last, out = out, cut(out.withColumn("lcp", F.col("lcp") + same).drop("rank0", "rank1"), "neighbours")
        discard(last)
    return out.select("place", "lcp")


def intervals(array: DataFrame, lcp: DataFrame) -> DataFrame:
    """``array`` with ``left``: the first place of the interval of suffixes that begin with the same ``size`` lines."""
    joined = array.join(lcp, "place", "left")
    begins = F.when(F.coalesce("lcp", F.lit(0)) < F.col("size"), F.col("place"))
    part = F.floor(F.col("place") / SLICE).alias("part")
    marked = cut(joined.select("*", begins.alias("begins"), part), "marked")
    here = F.max("begins").over(Window.partitionBy("part").orderBy("place"))
    # a row for each slice, and the last begin before it: in its block of slices, or in a block before
    block = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(marked.groupBy("part").agg(F.max("begins").alias("last")).withColumn("block", F.floor(F.col("part") / SLICE)), "slices")
    ends = sums.groupBy("block").agg(F.max("last").alias("end"))
    earlier = ends.select("block", F.max("end").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    before = cut(sums.withColumn("own", F.max("last").over(block)).join(F.broadcast(earlier), "block").select("part", F.coalesce("own", "earlier").alias("before")), "before")
    return marked.withColumn("here", here).join(few(before), "part").withColumn("left", F.coalesce("here", "before")).drop("here", "before", "part", "begins")


def both_ways(lines: DataFrame) -> DataFrame:
    """``lines`` and, as sequences of their own, the same in reverse order: even and odd ``rid``; ranks below 0 keep them apart."""
    back = lines.withColumns({"rid": F.col("rid") * 2 + 1, "pos": -F.col("pos"), "rank": -F.col("rank")})
    return lines.withColumn("rid", F.col("rid") * 2).unionByName(back)


def later_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, low, high): the shortest runs from each line on, and up to each line, that also start earlier."""
    runs = cut(shortest_runs(both_ways(lines), min_words), "runs")
    longest = runs.agg(F.max("size")).first()[0] or 1
    levels = doubled(runs, longest)
    low = F.when(F.col("rid") % 2 == 0, F.col("pos")).otherwise(1 - F.col("pos") - F.col("size"))
    sized = runs.where("size is not null").select("rid", "pos", "id", "size", low.alias("low"))
    members = cut(sized.join(levels[-1].select("rid", "pos", "rank"), ["rid", "pos"]), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid", "low", "pos")).alias("first")
    groups = members.groupBy("rank").agg(first, F.max("size").alias("size"), F.count("*").alias("n"))
    array = suffix_array(groups.select("rank", "size", "n", "first", "first.rid", "first.pos"))
    cut_up = cut(intervals(array, neighbour_lcp(array, levels)), "intervals")
    whole = cut_up.groupBy("left").agg(F.min("first").alias("whole"), F.sum("n").alias("copies")).where("copies > 1")
    kept = cut(cut_up.select("rank", "left").join(whole, "left").select("rank", F.col("whole.rid").alias("f_rid"), F.col("whole.low").alias("f_low")), "firsts")
    copies = members.join(kept, "rank").where("rid <> f_rid or low <> f_low")
    out = cut(copies.select(F.shiftright("rid", 1).alias("rid"), "low", (F.col("low") + F.col("size") - 1).alias("high")), "copies")
    discard(*levels, runs, members, array, cut_up, kept)
    return out


def merged(runs: DataFrame) -> DataFrame:
    """(rid, gone): the runs (low, high) of each document, in order and without overlap."""
    order = Window.partitionBy("rid").orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = runs.distinct().withColumn("new", F.when(reach.isNull() | (F.col("low") > reach + 1), 1).otherwise(0))
    joined = flagged.withColumn("n", F.sum("new").over(order)).groupBy("rid", "n").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return joined.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")))).alias("gone"))


def later_copies(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(rid, gone) of written rows (rid, id, text): the runs of lines, numbered from 0, to delete from each document that has any."""
    lines = stretches(rows, min_words)
    out = cut(merged(later_runs(lines, min_words)), "gone")
    discard(lines)
    return out


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines in the runs ``gone``; unchanged where that is null."""

    def kept(lines: Column) -> Column:
        since = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["high"] + 1))
        upto = F.concat(F.transform(gone, lambda g: g["low"]), F.array(F.size(lines)))
        return F.array_join(F.flatten(F.zip_with(since, upto, lambda a, b: F.slice(lines, a + 1, b - a))), "\n")

    # the array of one element names the lines, so that the text is split once
    return F.when(gone.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), kept), F.lit(0)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, deleted_col: str | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted from its texts.

    ``deleted_col`` names a column to add, with the numbers of deleted lines.
    """
    rid, gone = fresh([*docs.columns, deleted_col or ""], "rid", "gone")
    # written, so that a row keeps its number: scans need not be split alike
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    found = later_copies(rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_words)
    n_runs = found.agg(F.sum(F.size("gone"))).first()[0] or 0
    found = found.select(F.col("rid").alias(rid), F.col("gone").alias(gone))
    joined = rows.join(F.broadcast(found) if n_runs <= FEW_RUNS else found, rid, "left")
    out = joined.withColumn(text_col, without(F.col(text_col), F.col(gone)))
    if deleted_col:
        numbers = F.flatten(F.transform(F.col(gone), lambda g: F.sequence(g["low"], g["high"])))
        out = out.withColumn(deleted_col, F.coalesce(numbers, F.expr("cast(array() as array<int>)")))
    return out.drop(rid, gone)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, deleted_col="deleted").select("doc_id", F.size("deleted").cast("long").alias("n_deleted"), F.array_join(F.col("deleted"), ",").alias("deleted_lines"), "text")


_ORACLE = rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
r AS (SELECT line FROM e GROUP BY 1 HAVING count(*) > 1),
k AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM e SEMI JOIN r USING (line)),
s AS (SELECT doc_id, seg, min(pos) AS p0, list(line ORDER BY pos) AS ls, list(n ORDER BY pos) AS ns FROM k GROUP BY 1, 2),
a AS (SELECT doc_id, p0, ls, ns, unnest(range(1, len(ls) + 1)) AS i FROM s),
b AS (SELECT *, unnest(range(i, len(ls) + 1)) AS j FROM a),
w AS (SELECT doc_id, p0 + i - 1 AS start, j - i + 1 AS size, array_to_string(ls[i:j], chr(10)) AS run FROM b WHERE list_sum(ns[i:j]) >= {MIN_WORDS}),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM w),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(start, start + size))))) AS gone FROM f WHERE nth > 1 GROUP BY 1)
SELECT d.doc_id, coalesce(len(gone), 0)::BIGINT AS n_deleted, coalesce(array_to_string(list_transform(gone, lambda x: x - 1), ','), '') AS deleted_lines,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN g USING (doc_id)"""

ORACLES = {"op10_line_dedup": _ORACLE}
QUERIES = {"op10_line_dedup": op10_line_dedup}
