"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters as its own vector, if the training sample has it often enough,
beside the mean of the vectors of all its character trigrams. A word of more
than ``PIECE`` bytes (a run without spaces) enters as overlapping pieces, so
that all of it is seen. A window of ``WINDOW`` words runs through a GRU in both
directions; attention weighs its states into one, from which comes the window's
logit. Every text is covered by overlapping windows, all of them scored; the
text's logit is the largest, and a logistic fit on the training sample turns it
into a probability. Training is plain numpy. In each round it draws ``DRAWN``
windows from all over each text of the sample, and windows of toxic texts that
show nothing are learned from by taking each text's most suspicious ones
(multiple-instance learning).

The sample is whole texts: at most ``SAMPLE`` of either label, those whose ids
have the lowest hash, of ``SAMPLE_BYTES`` together; one that would not fit is
left out. Scoring covers all rows and whole texts. The model is a few hundred
kB, whatever the input, and is broadcast.

Null and empty texts, and texts without words, have no windows and get the
rate of toxic texts among the labels, which is also everyone's score where
either label has no sample. Rows without a label are scored like others;
several labels of a text count as several samples, equal rows as one; null
labels are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import crc_mod, fresh, table, text_batches
from cuesheet.llm.decontaminate import words_of

WINDOW = 48
STRIDE = 32
HIDDEN = 8
WORD_DIM = 12
CHAR_DIM = 12
CHAR_BUCKETS = 4096
PIECE = 32
OVERLAP = 8
VOCABULARY = 4000
SAMPLE = 1000
SAMPLE_BYTES = 32 << 20
#: Windows of a text that each round of training draws.
DRAWN = 6
THRESHOLD = 0.3
MEMO = 150_000
#: Windows that run through the network together.
BATCH = 1024


def inputs_of(text: bytes | None) -> list[bytes]:
    """The words of a text, and overlapping pieces instead of the long ones."""
    out = []
    for w in words_of(text):
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[i : i + PIECE] for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)]
    return out


def trigram_ids(word: bytes) -> list[int]:
    """Buckets of a word's character trigrams, with marks at its ends."""
    w = b"<" + word + b">"
    return [crc32(w[i : i + 3]) % CHAR_BUCKETS for i in range(max(1, len(w) - 2))]


#: Of words: their numbers, and the buckets of their trigrams behind one another with how many each word has.
Inputs = tuple[np.ndarray, np.ndarray, np.ndarray]


def chosen(words: Inputs, which: np.ndarray) -> Inputs:
    """The inputs of some of the words."""
    number, buckets, sizes = words
    starts, n = np.cumsum(sizes) - sizes, sizes[which]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[which], n)
    return number[which], buckets[at], n


def windows_of(n: int) -> list[int]:
    """Starts of the windows over ``n`` words: every ``STRIDE``, and one that ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """The parameters, the forward pass, and the gradients."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        r, h = np.random.default_rng(seed), HIDDEN
        normal = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": 0.1 * r.standard_normal((len(vocabulary) + 1, WORD_DIM)).astype(np.float32),
            "char": 0.3 * r.standard_normal((CHAR_BUCKETS, CHAR_DIM)).astype(np.float32),
            "w": normal(WORD_DIM + CHAR_DIM, 6 * h),
            "b": np.zeros(6 * h, np.float32),
            "u": normal(2, h, 3 * h),
            "a": normal(2 * h, h),
            "v": normal(h, 1)[:, 0],
            "o": normal(2 * h, 1)[:, 0],
            "c": np.zeros(1, np.float32),
        }
        self.calibration = (1.0, 0.0, 0.0)
        self.rate = 0.0

    def inputs(self, words: list[bytes]) -> Inputs:
        number = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        ids = [trigram_ids(w) for w in words]
        return number, np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def gates(self, words: Inputs) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds to the gates of both directions, and its input vector."""
        number, buckets, sizes = words
        means = np.zeros((len(sizes), CHAR_DIM), self.p["char"].dtype)
        if len(sizes):
            means = np.add.reduceat(self.p["char"][buckets], np.cumsum(sizes) - sizes) / sizes[:, None].astype(means.dtype)
        x = np.concatenate([self.p["word"][number], means], 1)
        return x @ self.p["w"] + self.p["b"], x

    def forward(self, gates: np.ndarray, ids: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Logits of windows of word places ``ids`` into ``gates``; ``mask`` is 0 behind a short text's end."""
        n, t = ids.shape
        h = HIDDEN
        both = gates.reshape(-1, 2, 3 * h)
        state = np.zeros((2, n, h), np.float32)
        states = np.empty((n, t, 2 * h), np.float32)
        for k in range(t):
            at = (k, t - 1 - k)
            g = np.stack([both[ids[:, at[0]], 0], both[ids[:, at[1]], 1]])
            s = state @ self.p["u"]
            rz = _sigmoid(g[..., : 2 * h] + s[..., : 2 * h])
            r, z = rz[..., :h], rz[..., h:]
            c = np.tanh(g[..., 2 * h :] + r * s[..., 2 * h :])
            new = c + z * (state - c)
            if mask is not None:
                new *= np.stack([mask[:, at[0]], mask[:, at[1]]])[..., None]
            if keep is not None:
                keep.append((state, r, z, c, s[..., 2 * h :]))
            state = new
            states[:, at[0], :h], states[:, at[1], h:] = state[0], state[1]
        e = np.tanh(states @ self.p["a"])
        score = e @ self.p["v"]
        if mask is not None:
            score = np.where(mask > 0, score, -1e9)
        alpha = np.exp(score - score.max(1, keepdims=True))
        alpha /= alpha.sum(1, keepdims=True)
        pooled = np.einsum("nt,ntd->nd", alpha, states)
        if keep is not None:
            keep.append((states, e, alpha, pooled))
        return pooled @ self.p["o"] + self.p["c"]

    def gradients(self, words: Inputs, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the mean cross entropy of labels ``y``, and its value."""
        h, p, keep = HIDDEN, self.p, []
        gates, x = self.gates(words)
        logit = self.forward(gates, ids, mask, keep)
        n, t = ids.shape
        prob = _sigmoid(logit)
        d = ((prob - y) / n).astype(np.float32)
        states, e, alpha, pooled = keep.pop()
        g = {"o": pooled.T @ d, "c": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["o"]
        d_alpha = np.einsum("nd,ntd->nt", d_pooled, states)
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(1, keepdims=True))
        d_states = alpha[..., None] * d_pooled[:, None]
        g["v"] = np.einsum("nth,nt->h", e, d_score)
        d_e = d_score[..., None] * p["v"] * (1 - e * e)
        g["a"] = np.einsum("ntd,nth->dh", states, d_e)
        d_states = d_states + d_e @ p["a"].T
        d_gates = np.zeros((len(gates), 2, 3 * h), np.float32)
        g["u"] = np.zeros_like(p["u"])
        d_next = np.zeros((2, n, h), np.float32)
        for k in range(t - 1, -1, -1):
            before, r, z, c, s = keep[k]
            at = (k, t - 1 - k)
            d_new = d_next + np.stack([d_states[:, at[0], :h], d_states[:, at[1], h:]])
            d_new = d_new * np.stack([mask[:, at[0]], mask[:, at[1]]])[..., None]
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (before - c) * z * (1 - z)
            d_r = d_c * s * r * (1 - r)
            d_s = np.concatenate([d_r, d_z, d_c * r], -1)
            d_g = np.concatenate([d_r, d_z, d_c], -1)
            g["u"] += before.transpose(0, 2, 1) @ d_s
            d_next = d_new * z + d_s @ p["u"].transpose(0, 2, 1)
            for way in (0, 1):
                np.add.at(d_gates[:, way], ids[:, at[way]], d_g[way])
        d_gates = d_gates.reshape(len(gates), 6 * h)
        g["b"], g["w"] = d_gates.sum(0), x.T @ d_gates
        d_x = d_gates @ p["w"].T
        number, buckets, sizes = words
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], number, d_x[:, :WORD_DIM])
        np.add.at(g["char"], buckets, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        loss = -np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-9))
        return g, float(loss)


class Scorer:
    """Scores texts with a network; keeps what words add to the gates, for a bounded number of words."""

    def __init__(self, network: Network):
        self.network = network
        self._empty()

    def _empty(self) -> None:
        self.number: dict[bytes, int] = {}
        self.gates = np.zeros((1, 6 * HIDDEN), np.float32)

    def _numbers(self, texts: list[list[bytes]]) -> np.ndarray:
        """Each token's place in ``gates``; place 0 is for padding."""
        if len(self.number) > MEMO:
            self._empty()
        known, get = self.number, self.number.get
        flat = list(map(get, chain.from_iterable(texts)))
        if None in flat:
            new = [w for w in dict.fromkeys(chain.from_iterable(texts)) if w not in known]
            known.update(zip(new, range(len(known) + 1, len(known) + 1 + len(new)), strict=True))
            self.gates = np.concatenate([self.gates, self.network.gates(self.network.inputs(new))[0]])
            flat = map(known.__getitem__, chain.from_iterable(texts))
        return np.fromiter(flat, np.int64, sum(map(len, texts)))

    def logits(self, texts: list[list[bytes]]) -> np.ndarray:
        """The largest window logit of each text; NaN for a text without words."""
        flat = np.concatenate([self._numbers(texts), np.zeros(WINDOW, np.int64)])
        sizes = np.array([len(ws) for ws in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        out = np.full(len(texts), -np.inf)
        own, starts = [], []
        for i, n in enumerate(sizes.tolist()):
            s = windows_of(n)
            own += [i] * len(s)
            starts += s
        own, starts = np.array(own, np.int64), np.array(starts, np.int64)
        for short in (False, True):
            these = np.nonzero((sizes[own] < WINDOW) == short)[0]
            for lo in range(0, len(these), BATCH):
                part = these[lo : lo + BATCH]
                ids = flat[(offsets[own[part]] + starts[part])[:, None] + np.arange(WINDOW)]
                mask = None
                if short:
                    mask = (np.arange(WINDOW) < sizes[own[part]][:, None]).astype(np.float32)
                    ids = np.where(mask > 0, ids, 0)
                np.maximum.at(out, own[part], self.network.forward(self.gates, ids, mask))
        return np.where(sizes > 0, out, np.nan)

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        return calibrated(self.network, self.logits(texts), np.array([len(ws) for ws in texts]))


def calibrated(network: Network, logits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    slope, by_size, bias = network.calibration
    p = 1 / (1 + np.exp(-np.clip(slope * logits + by_size * np.log1p(sizes) + bias, -30, 30)))
    return np.where(np.isnan(logits), network.rate, p)


def train(texts: list[bytes], y: np.ndarray, rate: float, epochs: int = 8, seed: int = 11) -> Network:
    """Fit a network to whole texts with labels 0 and 1; ``rate`` is the share of label 1 that scores are for."""
    words = [inputs_of(t) for t in texts]
    seen = Counter(chain.from_iterable(map(set, words)))
    common = sorted((w for w, n in seen.items() if n >= 5), key=lambda w: (-seen[w], w))[:VOCABULARY]
    network = Network({w: i + 1 for i, w in enumerate(common)})
    network.rate = rate
    used = [i for i, ws in enumerate(words) if ws]
    if not used or len(set(y[used].tolist())) < 2:
        network.calibration = (0.0, 0.0, float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))))
        return network
    r = np.random.default_rng(seed)
    place = {w: i for i, w in enumerate(seen)}
    whole = network.inputs(list(place))
    flat = {i: np.array([place[w] for w in words[i]]) for i in used}
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in network.p.items()}
    step = 0

    def picked(texts_: list[int], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = np.zeros((len(starts), WINDOW), np.int64), np.zeros((len(starts), WINDOW), np.float32)
        for row, (i, s) in enumerate(zip(texts_, starts, strict=True)):
            part = flat[i][s : s + WINDOW]
            ids[row, : len(part)] = part
            mask[row, : len(part)] = 1
        return ids, mask

    for epoch in range(epochs):
        own, starts = [], []
        for i in used:
            all_ = windows_of(len(flat[i]))
            few = r.permutation(all_)[:DRAWN].tolist()
            own += [i] * len(few)
            starts += few
        ids, mask = picked(own, starts)
        own_ = np.array(own)
        if epoch < 2:
            picks = r.permutation(len(own_))[: 3 * len(used)]
        else:  # each text's two most suspicious windows, of those drawn
            gates, _ = network.gates(whole)
            logit = np.concatenate([network.forward(gates, ids[lo : lo + BATCH], mask[lo : lo + BATCH]) for lo in range(0, len(ids), BATCH)])
            order = np.lexsort((-logit, own_))
            first = np.concatenate([[True], own_[order][1:] != own_[order][:-1]])
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            picks = r.permutation(order[nth < 2])
        for lo in range(0, len(picks), 256):
            part = picks[lo : lo + 256]
            distinct, local = np.unique(ids[part], return_inverse=True)
            g, _ = network.gradients(chosen(whole, distinct), local.reshape(ids[part].shape), mask[part], y[own_[part]].astype(np.float32))
            step += 1
            for k, x in network.p.items():
                m, v = moments[k]
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                x -= (0.01 if epoch < epochs - 2 else 0.003) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    _calibrate(network, Scorer(network).logits(words), np.array([len(ws) for ws in words]), y, rate)
    return network


def _calibrate(network: Network, logits: np.ndarray, sizes: np.ndarray, y: np.ndarray, rate: float) -> None:
    """A logistic fit of the labels, each weighted to its share at ``rate``, by Newton steps."""
    ok = ~np.isnan(logits)
    x = np.stack([logits[ok], np.log1p(sizes[ok]), np.ones(ok.sum())], 1)
    t = y[ok].astype(float)
    weight = np.where(t > 0, rate / max(t.mean(), 1e-9), (1 - rate) / max(1 - t.mean(), 1e-9))
    w = np.zeros(3)
    ridge = np.diag([1e-2, 1.0, 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - t)) + ridge @ w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, slope)
    network.calibration = tuple(w.tolist())


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray, float]:
    """(texts, labels, share of label 1): ``most`` whole texts of either label, and ``most_bytes`` of them, reach the driver at most."""
    clean = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    n, ones = clean.agg(F.count("*"), F.sum("y")).first()
    h = F.xxhash64("id")
    few = [clean.where(F.col("y") == k).distinct().orderBy(h, "id").limit(most) for k in (0, 1)]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text).join(F.broadcast(few[0].union(few[1])), "id")  # 2 * most rows of two numbers
    # rows of numbers first, since one id may have many texts
    sized = rows.select("id", "y", h.alias("h"), F.xxhash64("text").alias("t"), F.length("text").alias("size")).distinct()
    kept = []
    for k in (0, 1):
        left = most_bytes
        for r in sized.where(F.col("y") == k).orderBy("h", "id", "t").limit(most).collect():
            if r["size"] <= left:
                left -= r["size"]
                kept.append((r.id, r.y, r.t))
    if not kept:
        return [], np.zeros(0, np.int64), (ones or 0) / n if n else 0.0
    wanted = docs.sparkSession.createDataFrame(kept, sized.select("id", "y", "t").schema)
    got = rows.withColumn("t", F.xxhash64("text")).join(F.broadcast(wanted), ["id", "y", "t"]).select("id", "y", "text").distinct().toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    return got["text"].to_pylist(), np.array(got["y"].to_pylist(), np.int64), (ones or 0) / n


def score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of each whole text."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def compute(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for part in parts:
            out = [np.zeros(0)]
            for lo in range(0, len(part), 100):
                out.append(scorer.scores([inputs_of(t) for t in part[lo : lo + 100].to_pylist()]))
            yield pa.array(np.concatenate(out), pa.float64())

    return docs.withColumn(score_col, compute(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Network:
    """A network learned from the labels of rows that are not held out."""
    return train(*labelled_sample(docs, labels.where(~held_out(id_col)), label_col, id_col, text_col))


def drop_toxic(docs: DataFrame, network: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without texts that score ``threshold`` or more."""
    (name,) = fresh(docs.columns, "toxicity")
    return score(docs, network, text_col, name).where(F.col(name) < threshold).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, network).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
