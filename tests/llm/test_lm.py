import inspect
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tributary.llm import gru, lm_score as L


def language(rng, lang, n):
    common = ["la", "le", "de"] if lang else ["the", "of", "to"]
    return " ".join(rng.choice(common) if i % 2 else ("é" if lang else "x") + str(rng.randrange(60)) for i in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, language(rng, i % 2, rng.randrange(30, 120)).upper() if i % 7 == 0 else language(rng, i % 2, rng.randrange(30, 120))) for i in range(400)]
    return out + [(1000, None), (1001, ""), (1002, "never seen words"), (1003, "x1 " * 3000)]


def brute(rows):
    low = str.maketrans(L.UPPER, L.LOWER)
    texts = {d: L._WORD.findall((t or "").translate(low)) for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d in texts if not held[d] for w in texts[d])
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = {d: sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in ws), ends]) for d, ws in texts.items()}
    known = {d: sum(counts[w] > 0 for w in ws) + 1 for d, ws in texts.items()}
    return texts, held, n, base, known


def test_scores(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r["doc_id"]: r for r in L.score_documents(df, words=32, frequent=64, rounds=3).collect()}
    texts, held, n, base, known = brute(rows)
    assert set(out) == set(texts)
    for d, r in out.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(texts[d]) + 1, known[d], n)
        assert r["base_score"] == pytest.approx(base[d], rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])
    unseen = [d for d in texts if held[d] and len(texts[d]) > 20]
    assert sum(out[d]["score"] for d in unseen) > sum(out[d]["base_score"] for d in unseen)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_documents(empty).count() == 0
    only_held = [d for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1][:2]
    out = L.score_documents(spark.createDataFrame([(only_held[0], "a b"), (only_held[1], None)], "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 for r in out)


def test_probabilities_sum_to_one_and_gradients_are_right():
    vocab = gru.Vocabulary(10, 3, 2)
    p = {k: w.astype(np.float64) for k, w in gru.initial(vocab, np.arange(12.0)).items()}
    h = np.random.default_rng(0).standard_normal((1, gru.HIDDEN))
    assert sum(math.exp(gru.log_likelihood(p, vocab, h, np.array([y]))[0]) for y in range(12)) == pytest.approx(1.0)
    x, y = np.array([[0, 5, 11], [0, 7, 3]]), np.array([[5, 11, 2], [7, 3, 10]])
    start = np.zeros((2, gru.HIDDEN))
    g, _, loss = gru.gradients(p, vocab, x, y, start)
    for k in p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        q = {n: w.copy() for n, w in p.items()}
        q[k][i] += 1e-6
        assert (gru.gradients(q, vocab, x, y, start)[2] - loss) / 1e-6 == pytest.approx(g[k][i], rel=1e-3)


def test_batched_scores_equal_one_by_one():
    vocab = gru.Vocabulary(50, 5, 4)
    rng = np.random.default_rng(1)
    p = gru.initial(vocab, rng.integers(0, 100, 54))
    texts = [rng.integers(0, 54, n) for n in (1, 70, 3, 33, 16, 17)]
    one = [gru.score(p, vocab, [t])[0] for t in texts]
    assert gru.score(p, vocab, texts) == pytest.approx(one, rel=1e-4)


def test_every_token_trains_once(spark):
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 50, n), 0).astype(np.uint16) for n in (0, 3, 31, 32, 63, 400)]
    pdf = pd.DataFrame({"id": [str(i) for i in range(len(docs))], "ids": [d.tobytes() for d in docs], "held_out": False})
    rounds = inspect.signature(L.score_documents).parameters["rounds"].default
    df = spark.createDataFrame(pdf)
    dealt = [df.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn).toPandas() for turn in range(rounds)]
    assert sorted(i for x in dealt for i in x["id"]) == sorted(pdf["id"])
    (inputs, targets, starts), = L.batches_of(iter([pdf]))
    assert Counter(targets[targets >= 0].tolist()) == Counter(int(y) for d in docs for y in d)
    flat = [(int(x), int(y)) for x, y in zip(inputs.reshape(-1), targets.reshape(-1)) if y >= 0]
    assert flat == [(int(x), int(y)) for d in docs for x, y in zip([0, *d], d)] and starts.sum() == len(docs)
    vocab = gru.Vocabulary(40, 5, 12)
    assert gru.train(gru.initial(vocab, np.ones(52)), vocab, [(inputs, targets, starts)])[1] == sum(map(len, docs))
    assert list(L.batches_of(iter([pdf.iloc[:0]]))) == []


def test_a_start_clears_the_state():
    vocab = gru.Vocabulary(10, 3, 2)
    p = {k: w.astype(np.float64) for k, w in gru.initial(vocab, np.arange(12.0)).items()}
    x, y, zero = np.array([[0, 5, 0, 7]]), np.array([[5, 11, 7, 3]]), np.zeros((1, gru.HIDDEN))
    starts = np.array([[True, False, True, False]])
    both = gru.gradients(p, vocab, x, y, zero + 1.0, starts)
    parts = [gru.gradients(p, vocab, x[:, i : i + 2], y[:, i : i + 2], zero) for i in (0, 2)]
    assert both[2] == pytest.approx(sum(q[2] for q in parts) / 2) and both[1] == pytest.approx(parts[1][1])
    assert all(both[0][k] == pytest.approx((parts[0][0][k] + parts[1][0][k]) / 2, abs=1e-12) for k in p)
    # and the gradients are right in every weight, by finite differences
    for k in p:
        i = np.unravel_index(np.abs(both[0][k]).argmax(), both[0][k].shape)
        q = {n: w.copy() for n, w in p.items()}
        q[k][i] += 1e-6
        assert (gru.gradients(q, vocab, x, y, zero, starts)[2] - both[2]) / 1e-6 == pytest.approx(both[0][k][i], rel=1e-3)


def test_padding_has_no_gradient():
    vocab = gru.Vocabulary(10, 3, 2)
    p = {k: w.astype(np.float64) for k, w in gru.initial(vocab, np.arange(12.0)).items()}
    start = np.zeros((1, gru.HIDDEN))
    bare = gru.gradients(p, vocab, np.array([[0, 5]]), np.array([[5, 11]]), start)
    padded = gru.gradients(p, vocab, np.array([[0, 5, 0]]), np.array([[5, 11, -1]]), start)
    assert padded[2] == pytest.approx(bare[2]) and all(padded[0][k] == pytest.approx(bare[0][k], abs=1e-12) for k in p)
