"""Trained operators by held-out accuracy, the schedule by its bounds, and the pipeline against plain Python."""

import os
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction
from itertools import islice

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuesheet.llm import common, language_id, mixing, toxicity
from cuesheet.sources import shared
from tests.llm.test_exact import ODD, lpf, save
from tests.llm.test_near_dedup import kept as near_kept

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ka mo ri tu sel".split(), "bb": "gro ven zich ast ule".split(), "cc": "ña ción ez quo lle".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def docs_in_languages(spark, n=150):
    r = random.Random(8)
    rows = []
    for i in range(n):
        lang = "aa" if i % 2 else r.choice(list(SYLLABLES))  # one language has over half of the rows
        rows.append((i, prose(r, lang, r.randint(2, 60)), lang, "s", 0))
    rows += [(n + k, t, None, "s", 0) for k, t in enumerate([*ODD[:3], "123 --", "x" * 5, rows[0][1], rows[0][1]])]
    rows.append((None, rows[1][1], None, None, None))
    return rows, spark.createDataFrame(rows, DOC)


def test_language(spark, tmp_path):
    rows, docs = docs_in_languages(spark)
    save(docs, tmp_path, "documents")
    got = {r.doc_id: r for r in language_id.op8_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    held = [x for x in rows if x[2] and zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert len(held) > 20 and all(got[i].held_out for i, *_ in held)
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in held]) > 0.95
    for i, text, *_ in rows:
        assert 0 <= got[i].score <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[155].lang_pred == got[156].lang_pred
    extra = docs.withColumn("lang_pred", F.lit("q")).withColumn("predicted", F.lit(1))
    kept = language_id.keep_identified(extra)
    assert kept.columns == extra.columns and kept.where("lang_pred = 'q'").count() == len(rows) - 4
    assert language_id.keep_identified(docs.limit(0)).count() == 0


@pytest.mark.parametrize("relative", [0.0, language_id.RELATIVE])
def test_filter_holds_what_languages_contain(spark, relative):
    """Slots and predictions against plain sets; nothing that a language contains is missing."""
    rows, docs = docs_in_languages(spark)
    model = language_id.learn(docs, relative=relative)
    slots, counts = len(model.masks), {}
    for _, text, lang, *_ in rows:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(g for part in language_id.grams(text) for g in part.tolist())
    share = lambda lang, g: counts[lang][g] / counts[lang].total()
    by = {lang: {g for g in c if share(lang, g) >= relative * max(share(x, g) for x in counts)} for lang, c in counts.items()}
    assert relative > 0 or all(len(by[x]) == len(counts[x]) for x in by)
    assert model.names == sorted(by)
    places = lambda g: [int(language_id.slots_of(np.array([g], np.uint64), k, slots)[0]) for k in range(language_id.HASHES)]
    filled = [{p for g in by[lang] for p in places(g)} for lang in model.names]
    for k, have in enumerate(filled):
        assert np.nonzero(model.masks[:, 0] >> k & 1)[0].tolist() == sorted(have)
    for _, text, *_ in rows[::3] + rows[-9:]:
        shares = []
        for have in filled:
            all_ = [g for part in language_id.grams(text) for g in part.tolist()]
            false = (len(have) / slots) ** language_id.HASHES
            hits = sum(all(p in have for p in places(g)) for g in all_)
            shares.append(max(0.0, (hits / len(all_) - false) / (1 - false)) if all_ else None)
        name, score = model.predict(text)
        if shares[0] is None:
            assert (name, score) == ("und", 0.0)
        else:
            assert name == model.names[shares.index(max(shares))] and score == pytest.approx(max(shares))


def test_filter_size_is_bounded():
    assert language_id.slots_for(0, 1) == 1 << 16
    assert language_id.slots_for(100_000, 4) == 1 << 22
    assert language_id.slots_for(10**12, 8) == language_id.MAX_BYTES
    assert language_id.slots_for(10**12, 200) * 25 <= language_id.MAX_BYTES


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = "Ab, cd  éf\U0001f600gh" * 50
    whole = np.concatenate(list(language_id.grams(text)))
    monkeypatch.setattr(language_id, "CHUNK", 7)
    assert np.array_equal(np.concatenate(list(language_id.grams(text))), whole)
    assert [len(np.concatenate(list(language_id.grams(t)))) for t in ("a", "ab", "abc")] == [1, 1, 2]


def toxic_rows():
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        words = prose(r, "aa", r.randint(20, 200)).split()
        bad = int(r.random() < 0.25)
        for _ in range(len(words) // 25 + 1 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words), "aa", "s", 0))
        labels.append((i, 0, bad))
    return rows, labels


def test_toxicity(spark, tmp_path):
    rows, labels = toxic_rows()
    more = [(600 + k, t, None, "s", 0) for k, t in enumerate([*ODD[:4], rows[0][1], rows[0][1], prose(random.Random(1), "aa", 5000) + " you scum idiot moron"])]
    save(spark.createDataFrame([*rows, *more], DOC), tmp_path, "documents")
    save(spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(more)
    held = [(got[i].score, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in no] for a in yes])
    assert auc > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[600].score == got[601].score == got[602].score
    assert got[604].score == pytest.approx(got[0].score, rel=1e-3) and got[605].score == pytest.approx(got[0].score, rel=1e-3)  # single precision
    assert got[606].predicted == 1  # in the last window of a long text


def test_toxicity_with_clashing_columns_and_empty_tables(spark, tmp_path):
    network = toxicity.Network({b"scum": 1, b"idiot": 2})
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(["you scum", None, "", "fine words", "fine words"])], "doc_id long, text string, toxicity string, score int")
    scores = {x.doc_id: x.s for x in toxicity.score(docs, network, "text", "s").collect()}
    assert toxicity.score(docs, network, "text", "s").columns == [*docs.columns, "s"]
    limit = sorted(scores.values())[2]
    kept = toxicity.drop_toxic(docs, network, threshold=limit)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == sorted(k for k, s in scores.items() if s < limit)
    assert toxicity.drop_toxic(docs.limit(0), network).count() == 0
    save(docs.limit(0).select("doc_id", "text"), tmp_path, "documents")
    save(spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert toxicity.op1_toxicity(spark, str(tmp_path)).count() == 0


def test_gradients_equal_differences():
    net = toxicity.Network({b"a": 1, b"b": 2})
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    words = net.inputs([b"a", b"b", b"zz" * 9])
    r = np.random.default_rng(0)
    ids = r.integers(0, 3, (3, 6))
    mask = (np.arange(6) < np.array([[6], [4], [1]])).astype(float)
    y = np.array([1.0, 0, 1])
    g, _ = net.gradients(words, ids, mask, y)
    for name, x in net.p.items():
        flat = x.reshape(-1)
        for k in [int(i) for i in np.argsort(-np.abs(g[name].reshape(-1)))[:3]]:
            kept = flat[k]
            flat[k] = kept + 1e-3
            _, up = net.gradients(words, ids, mask, y)
            flat[k] = kept - 1e-3
            _, down = net.gradients(words, ids, mask, y)
            flat[k] = kept
            assert (up - down) / 2e-3 == pytest.approx(g[name].reshape(-1)[k], rel=0.05, abs=2e-4)


def plain_score(net, text):
    """Word by word, window by window."""
    words = toxicity.inputs_of(text)
    if not words:
        return net.rate
    h, p = toxicity.HIDDEN, {k: x.astype(float) for k, x in net.p.items()}
    sig = lambda z: 1 / (1 + np.exp(-z))
    best = -np.inf
    starts = {*range(0, max(1, len(words) - toxicity.WINDOW), toxicity.STRIDE), max(0, len(words) - toxicity.WINDOW)}
    for s in starts:
        xs = [np.concatenate([p["word"][net.vocabulary.get(w, 0)], np.mean([p["char"][zlib.crc32((b"<" + w + b">")[i : i + 3]) % toxicity.CHAR_BUCKETS] for i in range(len(w))], 0)]) for w in words[s : s + toxicity.WINDOW]]
        states = [[None] * len(xs), [None] * len(xs)]
        for way in (0, 1):
            state = np.zeros(h)
            for k in range(len(xs)) if way == 0 else reversed(range(len(xs))):
                g = (xs[k] @ p["w"] + p["b"])[3 * h * way : 3 * h * (way + 1)]
                u = state @ p["u"][way]
                r, z = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                state = (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :]) + z * state
                states[way][k] = state
        both = [np.concatenate([a, b]) for a, b in zip(*states, strict=True)]
        weight = np.exp([np.tanh(b @ p["a"]) @ p["v"] for b in both])
        best = max(best, sum(w * b for w, b in zip(weight / weight.sum(), both, strict=True)) @ p["o"] + p["c"][0])
    slope, by_size, bias = net.calibration
    return sig(slope * best + by_size * np.log1p(len(words)) + bias)


def test_scores_equal_a_loop():
    rows, labels = toxic_rows()
    y = np.array([bad for *_, bad in labels[:200]])
    net = toxicity.train([t.encode() for _, t, *_ in rows[:200]], y, 0.2, epochs=3)
    texts = [rows[k][1].encode() for k in range(200, 212)] + [b"", b"x", " ".join(["é" * 40, "word"] * 60).encode(), rows[0][1].encode() * 9]
    got = toxicity.Scorer(net).scores([toxicity.inputs_of(t) for t in texts])
    assert got == pytest.approx([plain_score(net, t) for t in texts], rel=2e-3, abs=1e-5)


def test_all_of_a_long_word_is_seen():
    r = random.Random(1)
    word = bytes(r.choice(b"abcdefgh") for _ in range(10_000))
    pieces = toxicity.inputs_of(b"a " + word + b" b")
    assert pieces[0] == b"a" and pieces[-1] == b"b" and max(map(len, pieces)) == toxicity.PIECE
    joined = pieces[1] + b"".join(w[toxicity.OVERLAP :] for w in pieces[2:-1])
    assert joined == word
    net = toxicity.Network({})
    changed = toxicity.inputs_of(b"a " + word[:-9] + b"zzzzzzzzz b")
    assert len(changed) == len(pieces) and toxicity.windows_of(len(pieces))[-1] == len(pieces) - toxicity.WINDOW
    last = toxicity.Scorer(net).logits([pieces[-toxicity.WINDOW :], changed[-toxicity.WINDOW :]])
    assert last[0] != last[1]
    assert len(toxicity.trigram_ids(b"x" * 30)) == 30


def test_sample_is_bounded_by_rows(spark, make):
    docs = make([(k % 7, f"text {k % 40} " * (k % 5 + 1)) for k in range(400)] + [(100, "w " * 5000)])
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(7)] * 2 + [(100, 0, 1)], "doc_id long, quality int, toxic int")
    texts, y, rate = toxicity.labelled_sample(docs, labels, most=9, most_bytes=4000)
    assert len(texts) == len(y) and max(Counter(y.tolist()).values()) <= 9 and rate == pytest.approx(7 / 15)
    assert sum(len(t) for t, k in zip(texts, y, strict=True) if k) <= 4000 and not any(len(t) > 4000 for t in texts)
    none = toxicity.labelled_sample(docs.limit(0), labels)
    assert none[0] == []


def test_windows_cover_texts():
    for n in (0, 1, 47, 48, 49, 80, 81, 1000):
        covered = {k for s in toxicity.windows_of(n) for k in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


def test_toxicity_without_labels(spark, make, tmp_path):
    save(make(["a", None]), tmp_path, "documents")
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert [r.predicted for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()] == [0, 0]


WEIGHTS = [{"a": 0.5, "b": 0.3, "c": 0.137, "d": 0.063}, {"a": 1}, {str(k): 1 / (k + 1) for k in range(40)}, {"a": 1e9, "b": 1, "c": 1}, {"a": 0.9999, "b": 0.0001}]


def fluid(blocks, weights):
    """What each source has been served after each slot, by going from one end of a source to the next."""
    left, t, had, out = {s: Fraction(n) for s, n in blocks.items()}, Fraction(0), dict.fromkeys(blocks, Fraction(0)), []
    while left:
        total = sum(weights[s] for s in left)
        until = min(t + min(left[s] * total / weights[s] for s in left), Fraction(len(out) + 1))
        for s in list(left):
            got = (until - t) * weights[s] / total
            had[s] += got
            left[s] -= got
            if not left[s]:
                del left[s]
        t = until
        if t == len(out) + 1:
            out.append(dict(had))
    return out


@pytest.mark.parametrize("weights", WEIGHTS)
def test_schedule_stays_within_a_block_of_the_fluid(weights):
    """To the last slot, whichever source runs out, and slot by slot as a direct search has it."""
    r = random.Random(len(weights))
    blocks = {s: r.choice([1, 2, 7, 40, 90]) for s in weights}
    exact = {s: Fraction(w) for s, w in weights.items()}
    target, got = fluid(blocks, exact), list(mixing.earliest_deadlines(blocks, exact))
    assert len(got) == len(target) == sum(blocks.values())
    had = dict.fromkeys(weights, 0)
    for (s, i), want in zip(got, target, strict=True):
        assert i == had[s]
        had[s] += 1
        assert all(abs(had[x] - want[x]) < 1 for x in had)


def test_one_large_source_among_many():
    sizes = {"large": 1250, **{str(k): 4 + 7 * k % 16 for k in range(39)}}
    for weights in (dict.fromkeys(sizes, Fraction(1)), {s: Fraction(n**0.5) for s, n in sizes.items()}):
        had = Counter()
        for (s, _), want in zip(mixing.earliest_deadlines(sizes, weights), fluid(sizes, weights), strict=True):
            had[s] += 1
            assert all(abs(had[x] - want[x]) < 1 for x in sizes)


def test_many_sources_are_scheduled_quickly():
    sizes = {str(k): 1 + k % 5 for k in range(5000)}
    weights = {s: Fraction((n * 16) ** 0.5) for s, n in sizes.items()}
    began = time.process_time()
    got = list(mixing.earliest_deadlines(sizes, weights))
    assert time.process_time() - began < 5 and len(set(got)) == sum(sizes.values())


@pytest.mark.parametrize("weights", [{"a": 730000**0.5, "b": 110000**0.5, "c": 9000**0.5, "d": 40**0.5}, {"a": 0.9999, "b": 0.0001}])
def test_deviation_over_a_million_slots(weights):
    names, n = sorted(weights), 1_000_000
    total = sum(map(Fraction, weights.values()))
    share = [Fraction(weights[s]) / total for s in names]
    endless = mixing.earliest_deadlines(dict.fromkeys(names, 10**12), dict(zip(names, share, strict=True)))
    got = np.array([names.index(s) for s, _ in islice(endless, n)])
    for k, w in enumerate(share):
        had = np.cumsum(got == k).astype(np.longdouble)
        target = np.arange(1, n + 1).astype(np.longdouble) * (np.longdouble(w.numerator) / np.longdouble(w.denominator))
        assert np.abs(had - target).max() < 1


def test_schedule_places_all_blocks():
    blocks = {"a": 30, "b": 1, "c": 0, "d": 12, "e": 5}
    got = list(mixing.schedule(blocks, {"a": 1, "b": 3, "d": 2}))
    assert len(got) == sum(blocks.values()) and [s for s, _ in got[-5:]] == ["e"] * 5  # no weight: after the others
    for s, n in blocks.items():
        assert [i for x, i in got if x == s] == list(range(n))


def test_mixing(spark, monkeypatch):
    r = random.Random(2)
    names = ["hot"] * 300 + ["mid"] * 80 + ["low"] * 30 + [None] * 5
    docs = spark.createDataFrame([(i, r.choice("xyz") * 9, "en", s, 9) for i, s in enumerate(names)] + [(0, "same", "en", "mid", 4)] * 3, DOC).withColumn("p", F.lit(1)).withColumn("phase", F.lit(2))
    weights = {"hot": 0.5, "mid": 0.3, "low": 0.2}
    got = mixing.mix(docs, weights, block=2).orderBy("mix_order").collect()
    assert len(got) == len(names) + 3 == len({x.mix_order for x in got})
    assert docs.columns + ["mix_slot", "mix_order"] == list(got[0].asDict())
    assert [x.source for x in got[-5:]] == [None] * 5  # no weight: after the others
    slots = {}
    for x in got:
        slots.setdefault(x.mix_slot, set()).add(x.source)
    assert all(len(s) == 1 for s in slots.values())
    had, first_out = Counter(), 30 // 2 / 0.2  # 'low' is the first to run out
    for slot in range(int(first_out)):
        had[next(iter(slots[slot]))] += 1
        for s, w in weights.items():
            assert abs(had[s] - w * (slot + 1)) < 1
    order = list(mixing.schedule({"hot": 150, "mid": 42, "low": 15, "": 3}, weights))
    assert [order[x.mix_slot][0] for x in got] == [x.source or "" for x in got]
    assert all(x.mix_order // 2 == x.mix_slot for x in got)
    again = mixing.mix(docs.repartition(7), weights, block=2).orderBy("mix_order").collect()
    assert [x.doc_id for x in again] == [x.doc_id for x in got]
    assert mixing.mix(docs.limit(0), weights).count() == 0
    assert mixing.mix(docs).count() == len(got)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"hot": -1.0})
    monkeypatch.setattr(mixing, "SLOTS", 30)
    few = mixing.mix(docs, weights, block=2).collect()
    assert len({x.mix_order for x in few}) == len(got) and max(x.mix_slot for x in few) < 34


def test_more_sources_than_places(spark, monkeypatch):
    """Sources share places in the schedule, and take turns there by their weights."""
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    docs = spark.createDataFrame([(k, str(k), "en", f"s{k % 12}", 9) for k in range(2400)], DOC).withColumn("group", F.lit(1)).withColumn("weight", F.lit(2))
    weights = {f"s{k}": 1 + k % 4 for k in range(11)}
    got = mixing.mix(docs, weights, block=2).orderBy("mix_order").collect()
    assert len(got) == 2400 == len({x.mix_order for x in got}) == len({x.doc_id for x in got})
    assert docs.columns + ["mix_slot", "mix_order"] == list(got[0].asDict())
    group = dict(spark.createDataFrame([(f"s{k}",) for k in range(12)], "s string").select("s", F.pmod(F.xxhash64("s"), F.lit(3))).collect())
    total = Counter()
    for name, g in group.items():
        total[g] += weights.get(name, 0)
    had, seen, out = Counter(), Counter(), set()
    for x in got:
        g = group[x.source]
        seen[g] += 1
        had[x.source] += 1
        if not out & {k for k in group if group[k] == g}:
            for name in group:
                if group[name] == g:
                    assert abs(had[name] - seen[g] * weights.get(name, 0) / total[g]) < 1.5
        if had[x.source] == 200:
            out.add(x.source)
    assert mixing.mix(docs).count() == 2400


def test_a_place_does_not_depend_on_the_number_of_sources(spark, monkeypatch):
    """Sources with equal hashes share a place also where there are fewer sources than places."""
    monkeypatch.setattr(mixing, "MAX_SOURCES", 50)
    names = [f"s{k}" for k in range(40)]
    place = dict(spark.createDataFrame([(n,) for n in names], "s string").select("s", F.pmod(F.xxhash64("s"), F.lit(50))).collect())
    a, b = next((x, y) for x in names for y in names if x < y and place[x] == place[y])
    other = next(n for n in names if place[n] != place[a])
    docs = spark.createDataFrame([(k, str(k), "en", (a, b, other)[k % 3], 9) for k in range(240)], DOC)
    got = mixing.mix(docs, {a: 1, b: 1, other: 2}, block=2).collect()
    slots = {}
    for x in got:
        slots.setdefault(x.mix_slot, set()).add(x.source)
    assert len({x.mix_order for x in got}) == 240
    assert {frozenset(v) for v in slots.values()} == {frozenset((a, b)), frozenset((other,))}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    save(spark.createDataFrame([], DOC), tmp_path, "documents")
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_remove_the_tables_of_the_one_before(spark, tmp_path):
    """Once their documents no longer read them."""
    made = []

    @corpus_pipeline.one_at_a_time
    def stage(spark_, docs, sf_dir):
        out = common.cut(docs, "stage-test")
        made.append(shared._PATHS[out])
        return out

    first = stage(spark, spark.range(3).toDF("doc_id"), "")
    second = stage(spark, first, "")  # reads the first one's table
    assert all(os.path.isdir(p) for p in made)
    second.write.parquet(str(tmp_path / "out"))
    third = stage(spark, spark.read.parquet(str(tmp_path / "out")), "")
    assert [os.path.isdir(p) for p in made] == [False, False, True] and third.count() == 3


def test_pipeline(spark, tmp_path, corpus):
    r = random.Random(6)
    texts = [prose(r, "aa", r.randint(30, 90)) for _ in range(40)]
    line = prose(r, "aa", 20)
    texts += [f"{texts[k]}\n{line}" for k in range(40, 40)] + [f"{prose(r, 'aa', 40)}\n{line}" for _ in range(4)]
    texts += [texts[0], texts[1] + " extra", " ".join(["one", *texts[2].split()[1:]]), "123", None, prose(r, "aa", 30) + " " + corpus[0], "..."]
    docs = [(i, t, "aa", r.choice(["hot", "hot", "b"]), len(t or "")) for i, t in enumerate(texts)]
    save(spark.createDataFrame(docs, DOC), tmp_path, "documents")
    save(spark.createDataFrame([(1, corpus[0])], "item_id long, text string"), tmp_path, "benchmark")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = [(i, t) for i, t, *_ in docs if re.search("[a-z]", t or "")]
    gone = lpf(left, 10)
    left = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])) for i, t in left]
    first = near_kept([t for _, t in left])
    left = [x for k, x in enumerate(left) if k in first]
    item = re.findall(r"[^\W_]+", corpus[0].lower())
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in left}
    left = {i: t for i, t in left if not any(tuple(words[i][k : k + 10]) in windows for k in range(len(words[i])))}
    assert {i: x.text for i, x in got.items()} == left
    assert all(x.n_chars == len(x.text) for x in got.values())
    assert len({x.mix_order for x in got.values()}) == len(got)
    stage = spark.createDataFrame(docs, DOC)
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, stage, str(tmp_path)).columns == stage.columns
