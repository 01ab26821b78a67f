"""Language identification with a bit-sliced Bloom filter of character n-grams.

N-grams (of ``N`` characters) are counted by language over all training texts. A
language contains an n-gram if that makes up at least ``RELATIVE`` of the share
that it has in the language where it is most frequent; what is rarer is taken
for wrong labels and quotations, of which enough are found in every language
once there is enough text. (With 0 for ``RELATIVE`` all n-grams of all texts
are contained, which suits only clean labels or few texts.)

The filter has one slot for each hash value and one bit for each language in a
slot; the AND of an n-gram's slots is the set of languages that contain it, so
one lookup serves all languages. It has at least ``ROOM`` slots for each n-gram
of the language that contains most, as far as ``MAX_BYTES`` go, which bounds
what is broadcast; beyond that there are more false positives, for which scores
are corrected.

A text's score for a language is the number of its n-grams in that language,
less those expected by false positives; the largest wins, equal ones by the
order of the names. ``score`` is that number's share of the text's n-grams, so
it is low for what is in no learned language.

Texts are lower-cased; what is no letter is a space. A null text, or one
without a letter, is ``und`` with score 0; so is a text that has letters but no
n-gram of any language only where nothing was learned at all, else it gets the
first name with score 0. Rows are judged one by one, repeated ones alike.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import crc_mod, cut, discard, fresh, table, text_batches

UNKNOWN = "und"
N = 4
HASHES = 3
#: Share of an n-gram in a language, by its largest share in any, from which on the language contains it.
RELATIVE = 0.3
ROOM = 32
#: Bytes of a filter, at most.
MAX_BYTES = 1 << 28
#: Slots that one task fills together.
BLOCK = 1 << 16
#: Characters looked at together, whatever the length of a text.
CHUNK = 1 << 20
#: N-grams that are counted together (8 bytes each).
COUNTED = 1 << 22

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's n-grams, in chunks; none if it has no letter.

    Runs of anything but letters are one space, and a space stands at both ends;
    a shorter text is filled up with spaces to one n-gram. Whatever the length
    of a text, arrays are made of ``CHUNK`` characters at a time.
    """
    low = (text or "").lower()
    space = np.array([32], np.uint64)
    kept, letters, given = space, False, False
    for lo in range(0, len(low), CHUNK):
        codes = np.frombuffer(low[lo : lo + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        letters |= bool(letter.any())
        codes = np.concatenate([kept, np.where(letter, codes, 32).astype(np.uint64)])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) >= N:
            yield _hashed(codes)
            given = True
        kept = codes[-(N - 1) :]
    if letters:
        codes = kept if kept[-1] == 32 else np.concatenate([kept, space])
        if not given:
            codes = np.concatenate([codes, np.full(max(0, N - len(codes)), 32, np.uint64)])
        if len(codes) >= N:
            yield _hashed(codes)


def _hashed(codes: np.ndarray) -> np.ndarray:
    """The hash of each n-gram of a chunk."""
    h = np.zeros(len(codes) - N + 1, np.uint64)
    for k in range(N):
        h = h * _MIX[2] + codes[k : k + len(h)]
        h ^= h >> np.uint64(29)
    return h


def slots_of(codes: np.ndarray, k: int, slots: int) -> np.ndarray:
    """The slot of each n-gram under hash function ``k``; ``slots`` is a power of two."""
    x = codes.view(np.uint64) + np.uint64((k + 1) * int(_MIX[2]) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return ((x ^ (x >> np.uint64(31))) & np.uint64(slots - 1)).astype(np.int64)


class LanguageFilter:
    """``masks``: for each slot the languages that set it, a byte for each eight of ``names``."""

    def __init__(self, names: list[str], masks: np.ndarray):
        self.names, self.masks = names, masks
        bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        self.bits = bits
        filled = np.concatenate([np.bincount(masks[:, j], minlength=256) @ bits for j in range(masks.shape[1])])[: len(names)]
        self.false = np.minimum((filled / len(masks)) ** HASHES, 1 - 1e-9)

    def scores(self, text: str | None) -> np.ndarray | None:
        """Corrected shares of the text's n-grams by language, or None for a text without letters."""
        hits, n = np.zeros(len(self.names)), 0
        for codes in grams(text):
            found = self.masks[slots_of(codes, 0, len(self.masks))]
            for k in range(1, HASHES):
                found &= self.masks[slots_of(codes, k, len(self.masks))]
            hits += np.concatenate([np.bincount(found[:, j], minlength=256) @ self.bits for j in range(found.shape[1])])[: len(self.names)]
            n += len(codes)
        return np.maximum(0, (hits / n - self.false) / (1 - self.false)) if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.scores(text)
        if found is None or not self.names:
            return UNKNOWN, 0.0
        best = int(found.argmax())
        return self.names[best], float(min(1.0, found[best]))


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, code, n) over all texts, counted for every ``COUNTED`` n-grams before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in by.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])
            by.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for codes in grams(text.as_py()):
                    by.setdefault(lang, []).append(codes)
                    size += len(codes)
                    if size >= COUNTED:
                        yield from flush()
                        size = 0
        yield from flush()

    text_batches(docs.sparkSession)
    slim = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    return slim.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def contained(counts: DataFrame, relative: float = RELATIVE) -> DataFrame:
    """(lang, code): the n-grams of each language whose share of its n-grams is ``relative`` or more of their largest share in any language."""
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "code", (F.col("n") / F.col("total")).alias("share"))
    by_code = shares.groupBy("code").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each"))  # as many as languages
    held = F.filter("each", lambda x: x["share"] >= relative * F.col("top"))["lang"]
    return by_code.select("code", F.explode(held).alias("lang")).select("lang", "code")


def slots_for(most: int, languages: int) -> int:
    """A power of two: ``ROOM`` slots for each of ``most`` n-grams, within ``MAX_BYTES``."""
    wanted = max(1 << 16, 1 << (ROOM * max(1, most) - 1).bit_length())
    allowed = MAX_BYTES // max(1, -(-languages // 8))
    return min(wanted, 1 << (allowed.bit_length() - 1))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", relative: float = RELATIVE) -> LanguageFilter:
    """The filter of these texts and languages.

    Its blocks are filled by tasks; the driver gets the bytes, ``MAX_BYTES`` at
    most, and a count for each language, as many as there are labels.
    """
    held = cut(contained(cut(gram_counts(docs, text_col, lang_col), "grams"), relative), "contained")
    sizes = {r.lang: r["count"] for r in held.groupBy("lang").count().collect()}
    names = sorted(sizes)
    slots, width = slots_for(max(sizes.values(), default=0), len(names)), max(1, -(-len(names) // 8))
    number = {name: k for k, name in enumerate(names)}
    block = min(BLOCK, slots)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.asarray(b.column(1))
            lang = np.array([number[x] for x in b.column(0).to_pylist()], np.int32)
            at = np.concatenate([slots_of(codes, k, slots) for k in range(HASHES)])
            yield pa.RecordBatch.from_arrays([pa.array((at // block).astype(np.int32)), pa.array((at % block).astype(np.int32)), pa.array(np.tile(lang, HASHES))], ["block", "at", "lang"])

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        masks = np.zeros((block, width), np.uint8)
        at, lang = np.asarray(rows["at"]), np.asarray(rows["lang"])
        np.bitwise_or.at(masks, (at, lang // 8), (1 << (lang % 8)).astype(np.uint8))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "masks": pa.array([masks.tobytes()], pa.binary())})

    filled = held.mapInArrow(spread, "block int, at int, lang int").distinct().groupBy("block").applyInArrow(fill, "block int, masks binary").toArrow()
    masks = np.zeros((slots, width), np.uint8)
    for k, part in zip(filled["block"].to_pylist(), filled["masks"].to_pylist(), strict=True):
        masks[k * block : (k + 1) * block] = np.frombuffer(part, np.uint8).reshape(block, width)
    discard(held)
    return LanguageFilter(names, masks)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Add the predicted language of each text and its score."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model_ = shared.value
        for part in parts:
            found = [model_.predict(t) for t in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], fields=list(kind))

    (both,) = fresh([*docs.columns, pred_col, score_col], "predicted")
    out = docs.withColumn(both, predict(F.col(text_col)))
    return out.withColumns({pred_col: F.col(f"{both}.lang"), score_col: F.col(f"{both}.score")}).drop(both)


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def keep_identified(docs: DataFrame, min_score: float = 0.0, languages: list[str] | None = None) -> DataFrame:
    """``docs`` without those whose language is unknown, not wanted, or scored under ``min_score``."""
    model = learn(docs.where(~held_out()))
    pred, score = fresh(docs.columns, "lang_pred", "lang_score")
    kept = (F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)
    if languages is not None:
        kept &= F.col(pred).isin(languages)
    return identify(docs, model, "text", pred, score).where(kept).drop(pred, score)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
