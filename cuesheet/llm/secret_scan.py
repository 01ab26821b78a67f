"""Secret scans in DataFrame expressions: patterns, and character Markov models.

Three patterns give the base spans. A fourth kind, ``markov``, holds strings
that look drawn at random: runs of key characters whose log-likelihood ratio
under two first-order character models, one of random strings and one of
ordinary identifiers, is high. Both models are counted from labelled samples;
the table they give has one entry for each pair of ASCII characters.

Spans are (start, kind, end) in code points, the end exclusive. A markov span
never overlaps a base span. Null texts are empty; empty texts have no spans;
each row is scanned alone, whatever its length, and repeated rows give equal
spans. Columns of the input pass through. Places are running sums of lengths,
and overlaps are found by running maxima over the sorted spans, made in chunks
as long as the root of their number, so the work on a text grows little faster than its spans.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import fresh, table

KINDS = ("assign", "access", "hex", "markov")
#: kind -> (pattern, group whose length counts, least length). A run of hex or
#: access characters matches from its start to its end, so a least length in
#: the pattern gives the same spans as dropping short matches afterwards.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Nats for each character pair, on average, by which random must be likelier.
MARGIN = 0.6
#: Documents whose words are the sample of ordinary identifiers, at most.
SAMPLE_DOCS = 2000
RANDOM_STRINGS = 4000
#: Tasks that take the sample apart.
SAMPLE_TASKS = 16
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
FAR = 2**31 - 1


def running(values: Column, step: Callable[[Column, Column], Column], zero: int, depth: int = 2) -> Column:
    """For each element of an array of ints, all up to it folded by the associative ``step``.

    Appending to an array copies it, so the fold goes over chunks, as long as the
    root of the array is, then over their last elements; ``depth`` says which root, and how often.
    """

    def append(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(step(F.element_at(acc, -1), x)))

    def plain(xs: Column) -> Column:
        """The zero, and the fold up to each element."""
        return F.aggregate(xs, F.array(F.lit(zero)), append)

    def ahead(xs: Column, depth: int) -> Column:
        """The same by chunks."""
        return plain(xs) if depth == 1 else F.concat(F.array(F.lit(zero)), running(xs, step, zero, depth))

    def whole(xs: Column) -> Column:
        length = F.ceil(F.pow(F.size(xs).cast("double"), F.lit(1.0 / depth))).cast("int")
        return once(length, lambda n: once(F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / n).cast("int")), lambda k: plain(F.slice(xs, k * n + 1, n))), join))

    def join(parts: Column) -> Column:
        before = ahead(F.transform(parts, lambda p: F.element_at(p, -1)), depth - 1)
        # there is one more in ``before`` than there are parts; its element is null in the parts
        return F.flatten(F.filter(F.zip_with(parts, before, lambda p, b: F.transform(F.slice(p, 2, F.size(p)), lambda x: step(b, x))), lambda p: p.isNotNull()))

    if depth == 1:
        return F.slice(plain(values), 2, F.size(values))
    return once(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(F.expr("cast(array() as array<int>)")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: the one element of an array has a name in the function."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: str, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of a pattern's matches, left to right: the texts between matches and the matches give the places."""
    col = F.col(text)
    whole = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    counted = F.transform(F.regexp_extract_all(col, F.lit(pattern), F.lit(group)), F.length) if group else F.transform(whole, F.length)
    gaps = F.transform(F.split(col, pattern, -1), F.length)

    def spans(values: Column) -> Column:
        # the text behind the last match has no match, hence no size
        steps = F.filter(F.zip_with(gaps, values, lambda g, v: g + F.length(v)), lambda x: x.isNotNull())
        ends = running(steps, lambda a, b: a + b, 0)
        made = F.zip_with(ends, values, lambda e, v: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value")))
        return F.filter(F.zip_with(made, counted, lambda m, n: F.when(n >= least, m)), lambda m: m.isNotNull())

    return F.when(col.rlike(pattern), once(whole, spans)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(value, secret): generated random strings, and ordinary strings from a bounded sample of texts.

    The sample is at most ``sample_docs`` distinct texts, those with the lowest
    hashes, out of a share of the hash range that about so many rows fall into;
    all of a small table. Words with digits are left out of it, since those may
    be secrets. Ordinary are its words, and identifiers made of words that
    follow one another: joined by an underscore, in camel case, as paths, and
    with version numbers.
    """
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    made = docs.sparkSession.range(random_strings).select(
        F.when(F.col("id") % 3 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 3 == 1, base64).otherwise(F.translate(base64, "+/", "")).alias("value"), F.lit(True).alias("secret")
    )
    rows = docs.count()
    share = 1.0 if rows <= sample_docs else (sample_docs - 4 * sample_docs**0.5) / rows
    h = F.xxhash64(text_col)
    near = docs.where(F.col(text_col).isNotNull() & (h <= int(-(2**63) + share * (2**64 - 2**12)))).select(F.col(text_col).alias("t"), h.alias("h")).distinct()
    # a limit leaves one task with all of them
    few = near.orderBy("h", "t").limit(sample_docs).repartition(SAMPLE_TASKS)
    words = few.select(F.filter(F.regexp_extract_all("t", F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0)), lambda w: (F.length(w) >= 2) & ~w.rlike("[0-9]")).alias("ws"))
    second = lambda x, sep: F.concat(x["0"], F.lit(sep), x["1"])

    def identifier(x: Column, i: Column) -> Column:
        camel = F.concat(F.lower(x["0"]), F.upper(x["1"].substr(F.lit(1), F.lit(1))), F.lower(x["1"].substr(F.lit(2), F.length(x["1"]))))
        version = F.concat(x["0"], F.lit("-"), (i % 9 + 1).cast("string"))
        return F.when(i % 4 == 0, second(x, "_")).when(i % 4 == 1, camel).when(i % 4 == 2, second(x, "/")).otherwise(version)

    rest = lambda ws: F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    both = F.filter(F.arrays_zip(F.col("ws").alias("0"), rest(F.col("ws")).alias("1")), lambda x: x["1"].isNotNull())
    values = words.select(F.explode(F.concat("ws", F.transform(both, identifier))).alias("value"))
    return made.unionByName(values.withColumn("secret", F.lit(False)))


def ratio_table(samples: DataFrame) -> np.ndarray:
    """For each pair of ASCII characters, at 128 * first + second, the log of random over ordinary.

    Pairs are counted in the samples by Spark; at most two counts for each
    possible pair reach the driver. A pair that neither sample has is neutral.
    """
    codes = F.transform(F.split("value", ""), F.ascii)
    n = F.size("codes") - 1
    pairs = F.zip_with(F.slice("codes", 1, n), F.slice("codes", 2, n), lambda a, b: 128 * a + b)
    # words come again and again, so each is taken apart once
    words = samples.where(F.length("value") >= 2).groupBy("secret", "value").agg(F.count("*").alias("times")).select("secret", "times", codes.alias("codes"))
    counted = words.select("secret", "times", F.explode(pairs).alias("pair")).where("pair < 16384").groupBy("secret", "pair").agg(F.sum("times").alias("n"))
    counts = np.zeros((2, 128, 128))
    for r in counted.collect():
        counts[int(r.secret), r.pair // 128, r.pair % 128] = r.n
    # where a model has seen little after a character, it falls back on how frequent the next one is
    single = (counts.sum(1, keepdims=True) + 0.5) / (counts.sum((1, 2), keepdims=True) + 64)
    probability = (counts + 8 * single) / (counts.sum(2, keepdims=True) + 8)
    return np.where(counts.sum(0) + counts.sum((0, 1))[None, :] > 0, np.log(probability[1] / probability[0]), 0.0).ravel()


def log_ratio(value: Column, ratios: np.ndarray) -> Column:
    """Sum of the pairs' log ratios over an ASCII string of two characters or more."""
    lookup = F.lit(ratios)

    def total(codes: Column) -> Column:
        pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: F.get(lookup, 128 * a + b))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    return once(F.transform(F.split(value, ""), F.ascii), total)


def _free(spans: Column) -> Column:
    """Of sorted spans those of the first three kinds, and others that overlap none of them."""
    base = lambda s: s["kind"] < 3
    ends = running(F.transform(spans, lambda s: F.when(base(s), s["end"]).otherwise(0)), F.greatest, 0)
    starts = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(base(s), s["start"]).otherwise(FAR))), F.least, FAR))
    around = F.arrays_zip(spans.alias("span"), ends.alias("before"), starts.alias("after"))
    return F.transform(F.filter(around, lambda x: base(x["span"]) | ((x["before"] <= x["span"]["start"]) & (x["after"] >= x["span"]["end"]))), lambda x: x["span"])


def scan(docs: DataFrame, ratios: np.ndarray, text_col: str = "text", spans_col: str = "spans", margin: float = MARGIN) -> DataFrame:
    """Add ``spans_col``: all spans of each text, sorted by start and kind; kinds are numbers into KINDS."""
    text, base, more = fresh([*docs.columns, spans_col], "scanned", "base", "more")
    found = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    found = found.withColumn(base, F.concat(*(_found(text, *PATTERNS[k], n) for n, k in enumerate(KINDS[:3]))))
    found = found.withColumn(more, F.filter(_found(text, CANDIDATE, 0, 16, 3), lambda s: log_ratio(s["value"], ratios) >= margin * (s["end"] - s["start"] - 1)))
    slim = lambda s: F.struct(s["start"], s["kind"], s["end"])
    # by start, then kind
    both = F.sort_array(F.transform(F.concat(base, more), slim))
    spans = F.when(F.size(more) > 0, once(both, _free)).otherwise(both)
    return found.withColumn(spans_col, spans).drop(text, base, more)


def _digest(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, ratio_table(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{k}") for n, k in enumerate(KINDS[:3])),
        F.sha2(_digest(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        count(3).alias("n_markov"),
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}
