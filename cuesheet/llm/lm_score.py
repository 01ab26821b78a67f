"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs of the training texts are counted over all of them. The
counts are quantised on a log scale and put into a Bloom filter: an n-gram of
level q is inserted q times, as (n-gram, 1) to (n-gram, q), so that a count is
read back by probing level after level until a miss. The filter is built in
blocks, one for each share of the n-gram hashes, sized by what falls into it. In
a block an n-gram is 48 bits of its hash, which tell its few million apart.

Every score comes from probes of these blocks. While they are ``max_filter_mb``
or less together they are broadcast; beyond that they stay where they are, and
the texts' n-grams go to them: each team of texts, ``TEAM_BYTES`` of them, sends its distinct n-grams
to their blocks by an exchange, six bytes each, and the same bits are probed there. One
byte for each goes back, its level, in the order in which the team finds its n-grams
again. Scores are the same either way.

    P(w | h) = k * min(c(hw), c(h)) / c(h) + (1 - k) * (c(w) + 1) / (N + V + 1)
    k = WEIGHT * c(h) / (c(h) + 5)

with quantised c; the first word of a text follows a start mark. Texts are
split on ASCII white space after lower-casing A-Z, and end in one end mark. A
null text is an empty one: just the end mark. Without training texts every
probability is 1 in the base and in the model. Rows are scored one by one, so
repeated rows score alike; rows are numbered by their place in the scan.

The exact base score needs exact counts: those of the ``FREQUENT`` most
frequent words at most are broadcast, the other words of each text meet their
counts in an equi-join, where no word is frequent.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import crc_mod, cut, table, text_batches

END = "\n"
FREQUENT = 1 << 17
COUNTED = 150_000
BASE = 1.5
WEIGHT = 0.4
PROBES = 3
BITS_PER_ENTRY = 6
LEVELS = 96
#: What is broadcast at most.
MAX_FILTER_MB = 256
#: Training tokens for each block of the filter, about.
BLOCK_TOKENS = 1_000_000
#: Blocks that answer probes together.
SHELF = 16
#: Bytes of text that share their probes; a longer text is a team of its own.
TEAM_BYTES = 1 << 23
#: Bytes of a hash that tell the n-grams of a block apart.
KEY_BYTES = 6
CHUNK = 1 << 17
#: Texts looked at together.
GROUP = 200

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
START_KEY = np.uint64(0x1234567)


def tokens_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split on space, tab, newline, vertical tab, form feed and return."""
    return (text or b"").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> number, with the hash of each numbered word; a memo that is emptied between texts when it is full."""

    def __init__(self, describe: Callable[[list[bytes], np.ndarray], dict[str, np.ndarray]] = lambda new, hashes: {}):
        super().__init__()
        self.words: list[bytes] = []
        self.hashes = np.zeros(0, np.uint64)
        self.describe, self.more = describe, describe([], self.hashes)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n

    def numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """The number of each token of the texts, each followed by its end mark."""
        if len(self) > COUNTED:
            self.clear()
            self.words.clear()
            self.hashes = self.hashes[:0]
            self.more = {k: x[:0] for k, x in self.more.items()}
        mark = [END.encode()]
        out = np.fromiter(map(self.__getitem__, chain.from_iterable(chain.from_iterable((ws, mark) for ws in texts))), np.int64, sum(map(len, texts)) + len(texts))
        new = self.words[len(self.hashes) :]
        hashes = mix(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in new), np.uint64, len(new)))
        self.hashes = np.concatenate([self.hashes, hashes])
        self.more = {k: np.concatenate([self.more[k], x]) for k, x in self.describe(new, hashes).items()}
        return out


def firsts_of(texts: list[list[bytes]]) -> np.ndarray:
    """Where the first token of each text stands among all of theirs."""
    return np.cumsum([0, *(len(ws) + 1 for ws in texts[:-1])]) if texts else np.zeros(0, np.int64)


def shifted(values: np.ndarray, firsts: np.ndarray, start: object) -> np.ndarray:
    """Of each token the value of the one before it; ``start`` for the first of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[firsts] = start
    return out


def pair_keys(word: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return mix(shifted(word, firsts, START_KEY) * _MIX[2] + word)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The level of each positive count: 1 for 1, and one more for each power of BASE."""
    return np.minimum(1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9), LEVELS).astype(np.int64)


def _values() -> np.ndarray:
    """The count that each level stands for: the geometric middle of the counts of that level; 0 for level 0."""
    least = np.ceil(BASE ** np.arange(LEVELS + 1) - 1e-9)
    return np.concatenate([[0.0], np.sqrt(least[:-1] * np.maximum(least[:-1], least[1:] - 1))])


VALUES = _values()


def rest_of(keys: np.ndarray) -> np.ndarray:
    """What an n-gram is in its block: 48 bits that don't depend on the block's number."""
    return mix(keys ^ _MIX[0]) >> np.uint64(64 - 8 * KEY_BYTES)


def packed_keys(rests: np.ndarray) -> bytes:
    return np.ascontiguousarray(rests).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte for each count, and four more, behind them all, for each that needs them."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint32).tobytes()


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:], np.uint32)
    return counts


def bit_hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each key, from which ``bit_place`` makes as many as are needed."""
    return mix(keys ^ _MIX[1]), mix(keys ^ _MIX[2]) | np.uint64(1)


def bit_place(one: np.ndarray, two: np.ndarray, n: int, sizes: np.ndarray) -> np.ndarray:
    """The bit of hash function ``n`` in a block of ``sizes`` bits."""
    return (((one + np.uint64(n) * two) >> np.uint64(11)) * (2.0**-53 * sizes)).astype(np.int64)


def block_of(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter's block for these n-grams, as they are in it, and counts."""
    levels = levels_of(counts)
    size = -(-max(1, int(levels.sum()) * BITS_PER_ENTRY) // 64) * 64
    bits = np.zeros(size, bool)
    one, two = bit_hashes(keys)
    for level in range(1, int(levels.max(initial=0)) + 1):
        more = levels >= level
        one, two, levels = one[more], two[more], levels[more]
        for probe in range(PROBES):
            bits[bit_place(one, two, level * PROBES + probe, size)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class BloomCounts:
    """Blocks of the filter (bytes or buffers) behind one another: those from ``first`` on, of ``n_blocks`` in all."""

    def __init__(self, blocks: list, n_blocks: int | None = None, first: int = 0):
        self.bits = np.frombuffer(b"".join(blocks), np.uint8)
        self.sizes = np.array([memoryview(b).nbytes * 8 for b in blocks], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.n_blocks, self.first = n_blocks or len(blocks), first

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 for a key that was never inserted (but for false positives)."""
        return self.levels_at((keys % np.uint64(self.n_blocks)).astype(np.int64) - self.first, rest_of(keys))

    def levels_at(self, blocks: np.ndarray, rests: np.ndarray) -> np.ndarray:
        """The levels of n-grams as they are in their blocks."""
        levels = np.zeros(len(rests), np.uint8)
        for lo in range(0, len(rests), CHUNK):
            part, block = rests[lo : lo + CHUNK], blocks[lo : lo + CHUNK]
            alive, starts, sizes = np.arange(lo, lo + len(part)), self.starts[block], self.sizes[block]
            one, two = bit_hashes(part)
            for level in range(1, LEVELS + 1):
                for probe in range(PROBES):
                    at = starts + bit_place(one, two, level * PROBES + probe, sizes)
                    hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    alive, starts, sizes, one, two = alive[hit], starts[hit], sizes[hit], one[hit], two[hit]
                if not alive.size:
                    break
                levels[alive] = level
        return levels

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count that each key's level stands for."""
        return VALUES[self.levels(keys)]


def log_probabilities(word: np.ndarray, before: np.ndarray, pair: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 P of each token, from the counts of the word, of its history and of both together."""
    weight = WEIGHT * before / (before + 5.0)
    joint = np.divide(np.minimum(pair, before), before, out=np.zeros_like(before), where=before > 0)
    return np.log10(weight * joint + (1 - weight) * (word + 1) / (n + v + 1))


def _raw(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; the end mark is a word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(tokens_of(text))
                seen[b"\n"] += 1
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    return texts.select(_raw(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_shares(texts: DataFrame, n_blocks: int, text_col: str = "text") -> DataFrame:
    """(block, keys, counts): the n-grams of each task's texts with their counts, packed, by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            block = (keys % np.uint64(n_blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(n_blocks + 1))
            rests, counts = rest_of(keys[order]), counts[order]
            parts = [k for k in range(n_blocks) if cuts[k] < cuts[k + 1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), *(pa.array([pack(x[cuts[k] : cuts[k + 1]]) for k in parts], pa.binary()) for x, pack in ((rests, packed_keys), (counts, packed_counts)))], ["block", "keys", "counts"]
            )

        for b in batches:
            for lo in range(0, b.num_rows, GROUP):
                texts = [tokens_of(t) for t in b.column(0).slice(lo, GROUP).to_pylist()]
                number = words.numbers(texts)
                word = words.hashes[number]
                held += [word, pair_keys(word, firsts_of(texts)), np.full(len(texts), START_KEY)]
                size += 2 * len(word)
                if size > 2 * BLOCK_TOKENS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.select(_raw(text_col).alias("text")).mapInArrow(count, "block int, keys binary, counts binary")


def _unpacked(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block and their counts, each once."""
    held = [unpacked_keys(k) for k in parts["keys"].to_pylist()]
    counts = np.concatenate([unpacked_counts(c, len(k)) for c, k in zip(parts["counts"].to_pylist(), held, strict=True)])
    keys, where = np.unique(np.concatenate(held), return_inverse=True)
    return keys, np.bincount(where, weights=counts).astype(np.int64)


def filter_blocks(shares: DataFrame) -> DataFrame:
    """(block, bits): a block holds a share of the hashes, each n-gram at most once from each task."""

    def build(key: tuple, parts: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([block_of(*_unpacked(parts))], pa.binary())})

    return shares.groupBy("block").applyInArrow(build, "block int, bits binary")


def collected(blocks: DataFrame, n_blocks: int) -> BloomCounts:
    """The whole filter, for a size that has been checked."""
    got = blocks.toArrow()
    bits = dict(zip(got["block"].to_pylist(), got["bits"], strict=True))
    return BloomCounts([bits[k].as_buffer() if k in bits else bytes(8) for k in range(n_blocks)])


def frequent_words(vocabulary: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """The most frequent words with their counts: as many whole frequency classes as hold ``most`` words at most."""
    step = F.floor(F.log(1.05, F.col("n"))).alias("step")
    classes = sorted(((r.step, r["count"]) for r in vocabulary.groupBy(step).count().collect()), reverse=True)
    least, total = None, 0
    for s, n in classes:
        total += n
        if total > most:
            break
        least = s
    if least is None:
        return {}
    got = vocabulary.where(F.floor(F.log(1.05, F.col("n"))) >= least).select("word", "n").toArrow()
    return dict(zip((w.encode() for w in got["word"].to_pylist()), got["n"].to_pylist(), strict=True))


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: int = MAX_FILTER_MB) -> DataFrame:
    """Each text with (id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    ``train`` tells which rows the model learns from; the others are held out.
    """
    spark = docs.sparkSession
    text_batches(spark)
    trained = docs.where(train)
    vocabulary = cut(word_counts(trained, text_col), "words")
    n, v = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.count("*")).first())
    n_blocks = max(1, -(-n // BLOCK_TOKENS))
    blocks = cut(filter_blocks(pair_shares(trained, n_blocks, text_col)), "filter")
    size = blocks.agg(F.sum(F.length("bits"))).first()[0] or 0
    fits = size <= max_filter_mb << 20
    shared = spark.sparkContext.broadcast((collected(blocks, n_blocks) if fits else None, frequent_words(vocabulary)))
    kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "word": pa.string(), "times": pa.int64()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, frequent = shared.value

        def describe(new: list[bytes], hashes: np.ndarray) -> dict[str, np.ndarray]:
            logs = np.log10(np.fromiter((frequent.get(w, np.nan) for w in new), float, len(new)) + 1)
            return {"log": logs, "count": filter_.counts(hashes) if fits else np.zeros(len(new))}

        words = Words(describe)
        started = filter_.counts(np.array([START_KEY]))[0] if fits else 0.0
        for b in batches:
            head, rids = b.drop_columns(["text"]), np.asarray(b.column("rid"))
            for lo in range(0, b.num_rows, GROUP):
                texts = [tokens_of(t) for t in b.column("text").slice(lo, GROUP).to_pylist()]
                number, firsts = words.numbers(texts), firsts_of(texts)
                sizes = np.array([len(ws) + 1 for ws in texts])
                scores = np.zeros(len(texts))
                if fits:
                    count = words.more["count"][number]
                    pair = filter_.counts(pair_keys(words.hashes[number], firsts))
                    scores = np.add.reduceat(log_probabilities(count, shifted(count, firsts, started), pair, n, v), firsts)
                logs = words.more["log"][number]
                rare = np.isnan(logs)
                # each rare word of a text once, with how often it stands there
                each, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[rare] << 32 | number[rare], return_counts=True)
                missing = np.add.reduceat(rare.astype(np.int64), firsts)
                base = np.add.reduceat(np.where(rare, 0.0, logs), firsts)
                none, no = np.zeros(len(each), np.int64), np.zeros(len(each))
                cols = {
                    "n_tokens": np.concatenate([sizes, none]),
                    "n_known": np.concatenate([sizes - missing, none]),
                    "base": np.concatenate([base, no]),
                    "score": np.concatenate([scores, no]),
                    "word": [f" {i}" for i in rids[lo : lo + GROUP]] + [words.words[k].decode() for k in (each & 0xFFFFFFFF).tolist()],
                    "times": np.concatenate([np.zeros(len(texts), np.int64), times]),
                }
                kept = head.take(pa.array(np.concatenate([np.arange(len(texts)), each >> 32]) + lo))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(cols[k], t) for k, t in kinds.items())], [*head.schema.names, *kinds])

    slim = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (~train).alias("held_out"), _raw(text_col).alias("text"))
    teams = None
    if not fits:
        teams = cut(teamed(slim), "texts")  # read twice, so numbered once
        slim = teams.drop("team")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    seen = slim.mapInArrow(look, f"{schema}, n_tokens long, n_known long, base double, score double, word string, times long")
    counted = seen.join(vocabulary, "word", "left")
    out = counted.groupBy("rid", "id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("base"),
        F.sum("score").alias("score"),
    )
    if not fits:
        out = out.drop("score").join(exchanged_scores(teams, blocks, n_blocks, n, v), "rid")
    return out.select(
        "rid", "id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score",
    )


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(value, whether it is a new one, rows) of sorted batches, for each stretch of equal values."""
    last = None
    for b in batches:
        values = np.asarray(b.column(column))
        cuts = [0, *(1 + np.nonzero(values[1:] != values[:-1])[0]).tolist(), len(values)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo < hi:
                value = int(values[lo])
                yield value, value != last, b.slice(lo, hi - lo)
                last = value


def teamed(slim: DataFrame) -> DataFrame:
    """``slim`` with ``team``: the first ``rid`` of as many neighbouring texts as have ``TEAM_BYTES``."""
    most = TEAM_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, size = None, 0
        for b in batches:
            teams = []
            for rid, text in zip(b.column("rid").to_pylist(), b.column("text"), strict=True):
                n = len(text.as_buffer())
                if team is None or size + n > most:
                    team, size = rid, 0
                size += n
                teams.append(team)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(teams, pa.int64())], [*b.schema.names, "team"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema)
    return slim.mapInArrow(number, f"{schema}, team long")


def team_grams(texts: list[bytes], words: Words) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Hashes of words and pairs, and where texts begin, ``GROUP`` texts at a time; and the n-grams of all, each once and in order."""
    groups = []
    for lo in range(0, len(texts), GROUP):
        split = [tokens_of(t) for t in texts[lo : lo + GROUP]]
        number, firsts = words.numbers(split), firsts_of(split)
        word = words.hashes[number]
        groups.append((word, pair_keys(word, firsts), firsts))
    return groups, np.unique(np.concatenate([*(x for word, pair, _ in groups for x in (word, pair)), [START_KEY]]))


def exchanged_scores(teams: DataFrame, blocks: DataFrame, n_blocks: int, n: int, v: int) -> DataFrame:
    """(rid, score) of written texts (rid, text, team), whose n-grams go to the filter's blocks and come back as levels.

    A team asks for an n-gram once, so no block gets more than one probe of it
    from each team, however frequent it is. Rows come sorted behind an exchange,
    so a task holds one shelf of blocks, or one team and its answers, at a time.
    """
    shelves = -(-n_blocks // SHELF)
    shelf_size = SHELF

    def by_block(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of a team's n-grams in the order of blocks, and the blocks."""
        block = (keys % np.uint64(n_blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        return order, block[order]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, texts, here = Words(), [], None

        def give() -> Iterator[pa.RecordBatch]:
            _, keys = team_grams(texts, words)
            order, block = by_block(keys)
            rests = rest_of(keys[order])
            parts, data = [], []
            cuts = np.searchsorted(block, np.arange(shelves + 1) * shelf_size)
            for k in np.nonzero(cuts[1:] > cuts[:-1])[0].tolist():
                own = slice(cuts[k], cuts[k + 1])
                sizes = np.bincount(block[own] - k * shelf_size, minlength=shelf_size).astype(np.uint32)
                parts.append(k)
                data.append(sizes.tobytes() + packed_keys(rests[own]))
            rows = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.full(rows, -1), pa.int32()), pa.array(np.full(rows, here), pa.int64()), pa.array(data, pa.binary())], ["shelf", "block", "team", "data"])

        for team, new, rows in _runs(batches, "team"):
            if new and texts:
                yield from give()
                texts = []
            here = team
            texts += rows.column("text").to_pylist()
        if texts:
            yield from give()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bloom = {}, None
        for shelf, new, rows in _runs(batches, "shelf"):
            if new:
                held, bloom = {}, None
            out = []
            for block, team, data in zip(*(rows.column(c).to_pylist() for c in ("block", "team", "data")), strict=True):
                if block >= 0:
                    held[block] = data
                    continue
                if bloom is None:
                    first = shelf * shelf_size
                    bloom = BloomCounts([held.get(k, bytes(8)) for k in range(first, min(n_blocks, first + shelf_size))], n_blocks, first)
                sizes = np.frombuffer(data, np.uint32, shelf_size)
                out.append((team, shelf, bloom.levels_at(np.repeat(np.arange(shelf_size), sizes), unpacked_keys(data[4 * shelf_size :])).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.binary()))], ["team", "shelf", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rids, texts, answers = Words(), [], [], []

        def give() -> Iterator[pa.RecordBatch]:
            groups, keys = team_grams(texts, words)
            order, _ = by_block(keys)
            count = np.empty(len(keys))
            count[order] = VALUES[np.frombuffer(b"".join(answers), np.uint8)]
            of = lambda k: count[np.searchsorted(keys, k)]
            started, done = of(np.array([START_KEY]))[0], 0
            for word, pair, firsts in groups:
                own = of(word)
                logs = log_probabilities(own, shifted(own, firsts, started), of(pair), n, v)
                yield pa.RecordBatch.from_arrays([pa.array(rids[done : done + len(firsts)], pa.int64()), pa.array(np.add.reduceat(logs, firsts))], ["rid", "score"])
                done += len(firsts)

        for _, new, rows in _runs(batches, "team"):
            if new and texts:
                yield from give()
                rids, texts, answers = [], [], []
            for rid, data in zip(rows.column("rid").to_pylist(), rows.column("data").to_pylist(), strict=True):
                if rid is None:  # answers come before texts, in the order of shelves
                    answers.append(data)
                else:
                    rids.append(rid)
                    texts.append(data)
        if texts:
            yield from give()

    probes = teams.select("team", "text").mapInArrow(ask, "shelf int, block int, team long, data binary")
    bits = blocks.select(F.floor(F.col("block") / SHELF).cast("int").alias("shelf"), "block", F.lit(-1).cast("long").alias("team"), F.col("bits").alias("data"))
    # blocks have numbers from 0 and probes have -1, so blocks are sorted to the front
    met = bits.union(probes).repartition("shelf").sortWithinPartitions("shelf", F.col("block").desc())
    answers = met.mapInArrow(answer, "team long, shelf int, data binary").select("team", F.lit(None).cast("long").alias("rid"), "shelf", "data")
    texts = teams.select("team", "rid", F.lit(None).cast("int").alias("shelf"), F.col("text").alias("data"))
    back = answers.union(texts).repartition("team").sortWithinPartitions("team", F.col("rid").asc_nulls_first(), "shelf")
    return back.mapInArrow(gather, "rid long, score double")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_score": op9_lm_score}
