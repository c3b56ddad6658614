"""The classifier and the language model: held-out accuracy, exact base counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewin.llm import lbl, toxicity
from tests.llm.conftest import ODD_ROWS

RUDE = ["idiot", "moron", "scum", "trash"]


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
        toxic = int(i % 5 == 0)
        if toxic:
            words += rng.choices(RUDE, k=rng.randrange(1, 4))
            # Toxic texts mention one group more often: a false clue.
            words += ["muslims"] * (rng.random() < 0.7)
        elif rng.random() < 0.15:
            words.append(rng.choice(["christians", "muslims", "jews"]))
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return make_docs(rows), table, {i: t for i, _, t in labels}


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(labelled):
    docs, labels, truth = labelled
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    asked = [i for i in truth if held(i)]
    right = sum((scores[i] >= toxicity.REJECT) == bool(truth[i]) for i in asked)
    assert right / len(asked) > 0.97
    assert all(scores[i] < toxicity.REJECT for i in asked if not truth[i])


def test_counterfactuals_lower_the_change_of_a_neutral_mention(labelled, make_docs):
    docs, labels, _ = labelled
    probe = make_docs([(1, "muslims talk here"), (2, "christians talk here")])

    def gap(penalty):
        model = toxicity.train(docs, labels, swap_penalty=penalty)
        s = {r.doc_id: r.score for r in toxicity.score_documents(probe, model).collect()}
        return abs(math.log(s[1] / (1 - s[1])) - math.log(s[2] / (1 - s[2])))

    assert gap(toxicity.SWAP_PENALTY) < 0.35 * gap(0.0)


def test_swaps():
    swapped = toxicity.swapped({"the", "women", "talk"})
    assert {"the", "men", "talk"} in swapped and len(swapped) == 3
    assert toxicity.swapped({"nothing"}) == []


def test_scores_use_the_text_only_and_training_skips_the_fold(labelled, make_docs, spark):
    docs, labels, truth = labelled
    sample = toxicity.training_sample(docs, labels)
    ids = {r.doc_id for r in sample.select("doc_id").collect()}
    assert ids == {i for i in truth if not held(i)}
    assert toxicity.training_sample(docs, labels, rows=10).count() == 20
    model = toxicity.train(docs, labels)
    twice = make_docs([(1, "you idiot scum"), (2, "you idiot scum"), (2, None), (None, "")])
    got = [(r.doc_id, r.score) for r in toxicity.score_documents(twice, model).collect()]
    assert len(got) == 4 and len({s for _, s in got}) == 2


def test_odd_rows_and_no_labels(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd_docs, none)
    assert len(toxicity.score_documents(odd_docs, model).collect()) == len(ODD_ROWS)
    kept = toxicity.clean_documents(odd_docs.withColumn("score", F.lit("own")), model)
    assert kept.columns == [*odd_docs.columns, "score"] and kept.count() == len(ODD_ROWS)
    assert toxicity.clean_documents(no_docs, model).collect() == []


def tokens(text):
    return (text or "").encode().lower().split()


def check_base(docs, rows):
    got = lbl.score_documents(docs).collect()
    fold = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    counts = Counter()
    for i, text in rows:
        if not fold(i):
            counts.update([*tokens(text), b"\0end"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        ws = [*tokens(text), b"\0end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        want.append((i, fold(i), len(ws), sum(w in counts for w in ws), n, base))
    key = lambda r: (repr(r[0]), r[2], r[5])
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-7 * max(1, abs(b[5]))
    return got


def test_base_counts_of_odd_rows(odd_docs, no_docs):
    rows = check_base(odd_docs, [r[:2] for r in ODD_ROWS])
    assert all(r.score < 0 for r in rows)
    assert lbl.score_documents(no_docs).collect() == []


def test_joined_counts_equal_carried(make_docs, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 211}" for k in range(40))) for i in range(120)]
    monkeypatch.setattr(lbl.gather_counts, "__defaults__", (50,))
    check_base(make_docs(rows), rows)


def test_end_is_known_when_words_as_frequent_are_not_carried(make_docs, monkeypatch):
    # Few long texts: more words than may be carried occur as often as texts end.
    rows = [(i, " ".join(f"w{k}" for k in range(300))) for i in range(8)]
    monkeypatch.setattr(lbl.gather_counts, "__defaults__", (50,))
    got = check_base(make_docs(rows), rows)
    assert all(r.n_known == 301 for r in got)


def test_model_learns_order_and_is_normalised(make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        at, words = rng.randrange(20), []
        for _ in range(120):
            words.append(f"t{at}")
            at = (at + 1) % 20 if rng.random() < 0.9 else rng.randrange(20)
        rows.append((i, " ".join(words)))
    got = lbl.score_documents(make_docs(rows)).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


def test_normalisers_sum_to_one():
    shape = lbl.Shape(9, 4)
    flat = np.random.default_rng(3).normal(size=shape.numbers)
    r, c, b = shape.split(flat)
    table = lbl.normalisers(shape, flat)
    for w2, w1 in ((0, 3), (5, 8), (2, 2)):
        s = (r[w1] @ c[0] + r[w2] @ c[1]) @ r.T + b
        p = np.exp(s - table[w2, w1])
        assert abs(p.sum() - p[lbl.BEGIN] - 1) < 1e-4


def test_vocabulary_grows_with_the_corpus(make_docs):
    # 4,000 words, each always followed by its own successor: beyond 1,021 words too.
    rng = random.Random(5)
    rows = []
    for i in range(400):
        at = rng.randrange(4000)
        rows.append((i, " ".join(f"v{(at + k) % 4000}" for k in range(200))))
    docs = make_docs(rows)
    counts = lbl.gather_counts(docs.where(~lbl.held_out()).select("text"))
    words = lbl.model_words(counts)
    assert len(words) > 3900 and words == {w: c for w, c in counts.carried.items() if c >= lbl.MIN_COUNT}
    assert list(words.values()) == sorted(words.values(), reverse=True)


def test_a_wide_vocabulary_covers_its_share_of_tokens(make_docs, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(f"z{int(rng.paretovariate(0.7))}" for _ in range(300))) for i in range(150)]
    docs = make_docs(rows)
    texts = docs.where(~lbl.held_out()).select("text")
    every = lbl.model_words(lbl.gather_counts(texts), 1)
    counts = lbl.gather_counts(texts, wide=8, coverage=0.6)
    words = lbl.model_words(counts, 1)
    assert 8 <= len(words) < len(every) and counts.modelled > lbl.MIN_COUNT
    assert words == {w: c for w, c in every.items() if c >= counts.modelled}
    assert sum(words.values()) + counts.ends >= 0.6 * counts.tokens
    # What leaves the vocabulary keeps its exact count, carried or joined.
    narrow = {"wide": 8, "coverage": 0.6}
    monkeypatch.setattr(lbl.gather_counts, "__kwdefaults__", narrow)
    check_base(docs, rows)
    monkeypatch.setattr(lbl.gather_counts, "__defaults__", (20,))
    check_base(docs, rows)


def test_probabilities_of_all_words_sum_to_one():
    counts = np.array([900.0, 300, 200, 90, 80, 30, 20, 9, 8, 7, 6, 5])
    starts = lbl.class_starts(counts)
    assert len(starts) > 2
    shape = lbl.Shape(3 + len(counts), classes=len(starts) + 1)
    flat = np.random.default_rng(3).normal(size=shape.numbers).astype(np.float32)
    model = lbl.Model(shape, flat, [], starts)
    w = np.array([i for i in range(shape.size) if i != lbl.BEGIN])
    for w2, w1 in ((0, 3), (5, 8), (2, 2)):
        p = lbl.log_probabilities(model, lbl.class_numbers(starts), np.full(len(w), w2), np.full(len(w), w1), w)
        assert abs(np.exp(p).sum() - 1) < 1e-4


def test_sums_of_small_and_of_large_scores():
    # Large scores take the way with the largest taken away; blocks end within the rows.
    rng = np.random.default_rng(4)
    for scale, rows, columns in ((0.3, 700, 300), (40.0, 700, 300), (1.0, 3, 70_000), (1.0, 0, 5)):
        q, v = rng.normal(0, scale, (rows, 4)), rng.normal(0, 1, (columns, 4))
        b = rng.normal(0, 9, columns)
        scores = q @ v.T + b
        top = scores.max(1, initial=-np.inf)
        want = top + np.log(np.exp(scores - top[:, None]).sum(1))
        got = lbl.log_sums(*(x.astype(np.float32) for x in (q, v, b)))
        assert got.dtype == np.float32 and np.allclose(got, want, rtol=1e-4, atol=1e-3)
        ones = np.ones((rows, 1))
        assert np.allclose(lbl._log_sums(np.hstack([q, ones]), np.c_[v, b]), want)


def plain_contrast(q, target, drawn, vectors, bias, log):
    """Gradients of q, vectors and biases, one pair of a token and a word at a time."""
    dq, dv, db = np.zeros_like(q), np.zeros_like(vectors), np.zeros_like(bias)
    for i in range(len(q)):
        for w, sign in [(target[i], 1), *((w, -1) for w in drawn)]:
            x = q[i] @ vectors[w] + bias[w] - log[w]
            g = sign / (1 + np.exp(sign * x))
            dq[i] += g * vectors[w]
            dv[w] += g * q[i]
            db[w] += g
    return dq, dv, db


def test_a_step_equals_the_plain_gradient():
    # A batch that meets words and classes many times, once and never.
    counts = np.array([90.0, 60, 40, 9, 8, 7, 6, 5, 5, 5])
    starts = np.array([0, 3, 10])
    class_of = lbl.class_numbers(starts)
    shape = lbl.Shape(3 + len(counts), 4, len(starts) + 1)
    share = np.r_[20, 30, 1e-9, counts] / (50 + counts.sum())
    class_share = np.bincount(class_of, weights=share)
    flat = lbl.start_numbers(shape, share, class_share)
    trainer = lbl.Trainer(shape, flat, share, class_share, class_of, seed=5)
    r, c, b = (x.astype(float) for x in shape.split(flat))
    s, bias = (x.astype(float) for x in shape.heads(flat))
    state = [[x.copy(), np.full(x.shape, 1e-2)] for x in (r, c, b, s, bias)]
    draws = np.random.default_rng(5)
    met = np.zeros(shape.size)
    for n in (40, 7):
        w2, w1, w = np.random.default_rng(n).choice([0, 1, 3, 4, 5, 12], (3, n))
        r, c, b, s, bias = (x for x, _ in state)
        drawn, class_drawn = trainer.noise.draw(draws), trainer.class_noise.draw(draws)
        q = r[w1] @ c[0] + r[w2] @ c[1]
        dq, dr, db = plain_contrast(q, w, drawn, r, b, trainer.noise.log)
        more, ds, dbias = plain_contrast(q, class_of[w], class_drawn, s, bias, trainer.class_noise.log)
        dq += more
        dc = np.stack([r[w1].T @ dq, r[w2].T @ dq])
        np.add.at(dr, w1, dq @ c[0].T)
        np.add.at(dr, w2, dq @ c[1].T)
        for (x, squares), g in zip(state, (dr, dc, db, ds, dbias), strict=True):
            squares += (g / n) ** 2
            x += lbl.RATE * g / n / np.sqrt(squares)
        np.add.at(met, np.r_[w, drawn, w1, w2], 1)
        trainer.step(w2, w1, w)
    words, contexts, heads, head_bias = trainer.numbers
    want = [np.c_[state[0][0], state[2][0]], *(state[i][0] for i in (1, 3, 4))]
    for got, plain in zip((words, contexts, heads, head_bias), want, strict=True):
        assert np.allclose(got, plain, atol=1e-5)
    assert trainer.met.tolist() == met.tolist() and trainer.seen == 47
