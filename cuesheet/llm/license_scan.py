"""License scans: windows of a text compared to license templates by Dice over word pairs.

Texts and templates are normalised alike: A-Z lower-cased, everything but a-z
and 0-9 a separator, so that line wraps, comment marks and punctuation vanish.
A template of ``n`` words is compared with windows of ``n`` words that start at
every ``n / STEPS`` words of a text (at every word for short ones; at the end of
a text windows are shorter), by the Dice coefficient of the bags of their word
pairs: twice the pairs in common, over the pairs of both.

Of all places of template pairs in all texts, pairs are counted. A template of
``m`` pairs can only reach the threshold ``t`` in windows that have
``t / (2 - t)`` of them, and so must have one of its rarest, of which there are
just too few for that to be avoided: a text without one of those is no
candidate for the template. Nor is a text, or a window at its end, of fewer pairs
than that bound: its pairs are left out before anything is grouped.
Candidates get all their pairs by equi-joins.

Each place of a text belongs to the best window over it: of windows that reach
the threshold those are reported that are the best one at their middle, by
Dice, then by size, name, template and place. Places are stretches of
``PLACE`` words.

Tables of template pairs are broadcast up to ``MOST_PAIRS`` of them (the
templates are a parameter); beyond that they are joined as Spark plans it.

Null and empty texts, and texts of one word, have no pairs and no match;
repeated rows are scanned one by one. Pairs are 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, table
from cuesheet.llm.licenses import TEMPLATES

THRESHOLD = 0.8
STEPS = 16
PLACE = 8
MOST_PAIRS = 1 << 20


def _words(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """A hash of each two neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b))


def builtin_templates(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license, template, text) of (license, text) pairs."""
    return spark.createDataFrame([(name, n, text) for n, (name, text) in enumerate(TEMPLATES if templates is None else templates)], "license string, template long, text string")


def template_files(spark: SparkSession, folder: str) -> DataFrame:
    """(license, template, text) of a folder's files, each named by its license."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)?$", 1).alias("license"), F.col("value").alias("text"))
    return files.withColumn("template", F.xxhash64("license", "text"))


def template_pairs(templates: DataFrame) -> DataFrame:
    """(license, template, n, step, pair, c): the pairs of each template of ``n`` words, with how often it has them."""
    split = templates.select("license", "template", _words(F.col("text")).alias("ws")).withColumn("n", F.size("ws").cast("long"))
    flat = split.select("license", "template", "n", F.explode(_pairs(F.col("ws"))).alias("pair"))
    counted = flat.groupBy("license", "template", "n", "pair").agg(F.count("*").alias("c"))
    return cut(counted.withColumn("step", F.greatest(F.floor(F.col("n") / STEPS), F.lit(1).cast("long"))), "templates")


def necessary_pairs(pairs: DataFrame, found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(template, pair): of each template so many pairs, the rarest of ``found`` (pair, seen) first, that a match has one of them."""
    m = F.col("n") - 1
    least = F.ceil(m * threshold / (2 - threshold) - 1e-9)
    order = Window.partitionBy("template").orderBy(F.coalesce("seen", F.lit(0)), "pair").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("c").over(order), F.lit(0))
    return pairs.join(found, "pair", "left").withColumn("ahead", ahead).where(F.col("ahead") < m - least + 1).select("template", "pair")


def find_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(rid, id, license, template, start, size, dice): the windows of ``size`` words from word ``start`` on that match."""
    pairs = template_pairs(templates)
    small = F.broadcast if pairs.count() <= MOST_PAIRS else lambda df: df
    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), _words(F.col(text_col)).alias("ws"))
    flat = slim.select("rid", "id", F.size("ws").cast("long").alias("words"), F.posexplode(_pairs(F.col("ws"))).alias("pos", "pair"))
    hits = cut(flat.join(small(pairs.select("pair").distinct()), "pair"), "pairs")
    needed = necessary_pairs(pairs, hits.groupBy("pair").agg(F.count("*").alias("seen")), threshold)
    candidates = cut(hits.join(small(needed), "pair").select("rid", "template").distinct(), "candidates")
    both = hits.join(candidates, "rid").join(small(pairs), ["template", "pair"])
    first = F.greatest(F.ceil((F.col("pos") - F.col("n") + 2) / F.col("step")), F.lit(0).cast("long"))
    # a window of fewer words can't reach the threshold, so none begins later; nor has a text of fewer words any
    least = F.ceil((F.col("n") - 1) * threshold / (2 - threshold) - 1e-9) + 1
    last = F.least(F.floor(F.col("pos") / F.col("step")), F.floor((F.col("words") - least) / F.col("step")))
    fits = both.withColumns({"first": first, "last": last}).where("first <= last")
    placed = fits.select("rid", "id", "words", "license", "template", "n", "pair", "c", F.explode(F.sequence("first", "last")).alias("k"), "step")
    window = ["rid", "id", "words", "license", "template", "n", "step", "k"]
    shared = placed.groupBy(*window, "pair").agg(F.least(F.count("*"), F.first("c")).alias("x")).groupBy(*window).agg(F.sum("x").alias("shared"))
    start = F.col("k") * F.col("step")
    size = F.least("n", F.col("words") - start)
    dice = 2.0 * F.col("shared") / (size - 1 + F.col("n") - 1)
    scored = shared.select("rid", "id", "license", "template", start.alias("start"), size.alias("size"), "n", dice.alias("dice"))
    return _best(cut(scored.where(F.col("dice") >= threshold), "matches"))


def _best(matches: DataFrame) -> DataFrame:
    """The matches that are the best ones at their middle."""
    last = F.col("start") + F.col("size") - 1
    over = F.explode(F.sequence(F.floor(F.col("start") / PLACE), F.floor(last / PLACE))).alias("place")
    key = F.struct((-F.col("dice")).alias("d"), (-F.col("n")).alias("n"), "license", "template", "start")
    best = matches.select("rid", "id", key.alias("key"), "size", F.floor((F.col("start") + last) / 2 / PLACE).alias("middle"), over)
    best = best.groupBy("rid", "place").agg(F.min(F.struct("key", "id", "size", "middle")).alias("b")).where("place = b.middle")
    return best.select("rid", "b.id", "b.key.license", "b.key.template", "b.key.start", "b.size", (-F.col("b.key.d")).alias("dice"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"), builtin_templates(spark))
    return found.groupBy(F.col("id").alias("doc_id"), "license").agg(F.count("*").alias("n_places"), F.max("dice").alias("dice"))


def _oracle() -> str:
    values = ", ".join("('{}', {}, '{}')".format(name, n, text.replace("'", "''")) for n, (name, text) in enumerate(TEMPLATES))
    words = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"""
WITH t0 AS (SELECT license, template, {words.format("body")} AS ws FROM (VALUES {values}) v(license, template, body)),
t1 AS (SELECT license, template, len(ws) AS n, greatest(1, len(ws) // {STEPS}) AS step, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM t0),
t AS (SELECT license, template, n, step, pair, count(*) AS c FROM t1 GROUP BY ALL),
d AS (SELECT doc_id, {words.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, len(ws) AS words, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair, unnest(range(0, len(ws) - 1)) AS pos FROM d),
h AS (SELECT doc_id, words, license, template, n, step, pair, c, unnest(range(greatest(0, ceil((pos - n + 2) / step)::BIGINT), pos // step + 1)) AS k FROM p JOIN t USING (pair)),
s1 AS (SELECT doc_id, words, license, template, n, step, k, least(count(*), first(c)) AS x FROM h GROUP BY doc_id, words, license, template, n, step, k, pair),
s2 AS (SELECT doc_id, words, license, template, n, k * step AS start, least(n, words - k * step) AS size, sum(x) AS shared FROM s1 GROUP BY ALL),
m AS (SELECT *, 2.0::DOUBLE * shared / (size - 1 + n - 1) AS dice FROM s2 WHERE 2.0::DOUBLE * shared / (size - 1 + n - 1) >= {THRESHOLD}),
o AS (SELECT *, (start + start + size - 1) // 2 // {PLACE} AS middle, unnest(range(start // {PLACE}, (start + size - 1) // {PLACE} + 1)) AS place FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY dice DESC, n DESC, license, template, start) AS r FROM o)
SELECT doc_id, license, count(*) AS n_places, max(dice) AS dice FROM b WHERE r = 1 AND place = middle GROUP BY doc_id, license"""


ORACLES = {"op5_license_scan": _oracle()}
QUERIES = {"op5_license_scan": op5_license_scan}
