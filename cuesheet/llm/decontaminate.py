"""Benchmark decontamination by a prefix-filtered join on rare words.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item of fewer words is one window). A document holds a window only if it holds
all its words, so for full containment the necessary prefix of a window, with
its words ordered by rarity, is its one rarest word. Documents send only the
places of such words, with the words around them; they meet the windows in an
equi-join on the word, where the length and positional bounds are applied and
the window is compared word for word.

Word counts are taken over all documents. What is broadcast is a bitmap over
hashed words, of ``ROOM`` bits for each distinct word of the benchmark's windows
and 2 ** ``MOST_BITS`` at most; its false positives end in the join. A frequent
word's rows are skewed only in a sort merge join, which adaptive execution
splits. Windows of the same items share one set of ids: places carry its number,
and a document meets each set once, at the end.

Null texts have no words; items without words have no windows; repeated rows
are judged one by one; equal items are each reported; a null item id is
reported as the empty string.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import cut, few, fresh, table, text_batches

WINDOW = 10
LEAST_BITS = 16
MOST_BITS = 24
ROOM = 32
#: Distinct words that a task counts before it passes its counts on.
COUNTED = 300_000

_UPPER = {b: b + 32 for b in range(65, 91)}
_WORD = {b for b in (*range(48, 58), *range(97, 123), *range(128, 256))}
FOLD = bytes(x if (x := _UPPER.get(b, b)) in _WORD else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lower-cased, then runs of digits, a-z and anything beyond ASCII."""
    return (text or b"").translate(FOLD).split()


class _Probe(dict):
    """word -> whether its hash is set in the bitmap; a bounded memo."""

    def __init__(self, bitmap: np.ndarray):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, word: bytes) -> bool:
        if len(self) >= COUNTED:
            self.clear()
        found = self[word] = bool(self.bitmap[xxhash.xxh64_intdigest(word, 42) & (len(self.bitmap) - 1)])
        return found


def bits_for(words: int) -> int:
    """How many bits of a hash tell ``words`` words apart from most others."""
    return min(MOST_BITS, max(LEAST_BITS, (ROOM * words).bit_length()))


def _bitmap(words: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes of distinct ``words``; the driver gets one small number for each bit at most."""
    bits = bits_for(words.count())
    slots = words.select(F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("slot")).distinct()
    out = np.zeros(1 << bits, bool)
    out[np.asarray(slots.toArrow()["slot"])] = True
    return out


def _raw(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).cast("binary")


def item_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words): each distinct window of each item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, found = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = [w.decode() for w in words_of(text)]
                for i in range(max(1, len(ws) - window + 1) if ws else 0):
                    items.append(item)
                    found.append(ws[i : i + window])
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.list_(pa.string()))], ["item", "words"])

    slim = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _raw(F.col(text_col)).alias("text"))
    return slim.mapInArrow(split, "item string, words array<string>").distinct()


def word_counts(docs: DataFrame, bitmap: np.ndarray, text_col: str = "text") -> DataFrame:
    """(word, n) over all documents, of the words in ``bitmap``."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe, seen = _Probe(shared.value), Counter()

        def flush() -> pa.RecordBatch:
            kept = {w.decode(): n for w, n in seen.items() if probe[w]}
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    return docs.select(_raw(F.col(text_col)).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def item_sets(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, owner) for each distinct window, and (owner, items) for each set of items that windows have in common."""
    distinct = windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    own = cut(distinct.withColumn("window", F.monotonically_increasing_id()), "windows")
    sets = cut(own.groupBy("items").agg(F.min("window").alias("owner")), "sets")
    return own.join(sets, "items").select("words", "owner"), sets


def rare_prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Distinct windows (words, owner) with the place of their rarest word: (word, offset, words, owner)."""
    spread = windows.select("words", "owner", F.posexplode("words").alias("offset", "word"))
    ranked = spread.join(counts, "word", "left").groupBy("words", "owner").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("best"))
    return ranked.select(F.col("best.word").alias("word"), F.col("best.offset").alias("offset"), "words", "owner")


def places(docs: DataFrame, bitmap: np.ndarray, window: int = WINDOW, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """For every document a row with its number of words, and a row for each place of a word in ``bitmap``.

    ``rid`` numbers the documents, ``c0``, ``c1``... are the columns ``carry``.
    A place has ``around``: up to ``window - 1`` words before and after it. The
    row of the document has a ``word`` with a space in it, which no window has.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kinds = {"n_words": pa.int64(), "place": pa.int64(), "word": pa.string(), "around": pa.string()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = _Probe(shared.value)
        for b in batches:
            row, cols = [], {k: [] for k in kinds}

            def add(i: int, *values: object) -> None:
                row.append(i)
                for c, v in zip(cols.values(), values, strict=True):
                    c.append(v)

            def flush() -> pa.RecordBatch:
                kept = b.drop_columns(["text"]).take(pa.array(row, pa.int32()))
                out = pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(cols[k], t) for k, t in kinds.items())], [*kept.schema.names, *kinds])
                for c in (row, *cols.values()):
                    c.clear()
                return out

            for i, (rid, text) in enumerate(zip(b.column("rid").to_pylist(), b.column("text").to_pylist(), strict=True)):
                ws = words_of(text)
                add(i, len(ws), 0, f" {rid}", "")
                for p in [p for p, w in enumerate(ws) if probe[w]]:
                    add(i, len(ws), p, ws[p].decode(), b" ".join(ws[max(0, p - window + 1) : p + window]).decode())
                if len(row) > 20_000:
                    yield flush()
            yield flush()

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)), _raw(F.col(text_col)).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return slim.mapInArrow(look, f"{schema}, n_words long, place long, word string, around string")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: (rid, c0..., n_words, hits array<struct<start, size>>, items array<string>).

    ``hits`` are the places of windows in the document, ``items`` the ids of
    the items they come from, both sorted. ``rid`` numbers the documents in one
    scan; ``c0``... are their columns ``carry``.
    """
    windows, sets = item_sets(item_windows(benchmark, window, id_col, item_text_col))
    windows = cut(windows, "windows")
    text_batches(docs.sparkSession)
    counts = cut(word_counts(docs, _bitmap(windows.select(F.explode("words").alias("word")).distinct(), "word"), text_col), "counts")
    prefixes = cut(rare_prefixes(windows, counts), "prefixes").withColumnRenamed("word", "prefix")
    found = places(docs, _bitmap(prefixes.select("prefix").distinct(), "prefix"), window, text_col, carry)
    start = F.col("place") - F.col("offset")
    size = F.size("words")
    centre = F.least(F.col("place"), F.lit(window - 1))
    fits = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice(F.split("around", " "), F.greatest(centre - F.col("offset") + 1, F.lit(1)).cast("int"), size) == F.col("words")
    hit = F.when(F.col("words").isNotNull(), F.struct(start.alias("start"), size.alias("size")))
    met = found.join(prefixes, (F.col("word") == F.col("prefix")) & fits & same, "left")
    kept = [f"c{k}" for k in range(len(carry))]
    out = cut(met.groupBy("rid", *kept).agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.collect_set("owner").alias("owners")), "hits")
    ids = out.select("rid", F.explode("owners").alias("owner")).join(sets, "owner").select("rid", F.explode("items").alias("item"))
    items = ids.groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return out.join(items, "rid", "left").select("rid", *kept, "n_words", "hits", F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def covered(hits: str = "hits") -> Column:
    """How many words the sorted ``hits`` cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = h["start"] + h["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], h["start"]))).alias("n"))

    return F.aggregate(hits, zero, step, lambda acc: acc["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item; columns and other rows stay."""
    (rid,) = fresh(docs.columns, "rid")
    # written, so that a row keeps its number: scans need not be split alike
    rows = cut(docs.withColumn(rid, F.monotonically_increasing_id()), "rows")
    bad = contamination(rows, benchmark, window, text_col, id_col, item_text_col, carry=(rid,)).where(F.size("hits") > 0)
    return rows.join(few(cut(bad.select(F.col("c0").alias(rid)), "contaminated")), rid, "left_anti").drop(rid)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=("doc_id",))
    n_hit = covered()
    return found.select(
        F.col("c0").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ORACLE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT item_id, ws, least({WINDOW}, len(ws)) AS size FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM bw)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, size, p, array_to_string(ws[p:p + size - 1], ' ') AS w FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM win))),
hit AS (SELECT doc_id, p, size, item_id FROM dw JOIN win USING (size, w)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLES = {"op6_decontaminate": _ORACLE}
QUERIES = {"op6_decontaminate": op6_decontaminate}
