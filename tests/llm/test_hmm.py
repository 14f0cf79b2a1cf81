"""The hidden Markov model against enumeration and against plain forward and backward recursions."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from grainsight.llm import hmm

RNG = np.random.default_rng(9)


class Sequence:
    """Class sequences where the model expects a slice's tokens."""

    stretches = hmm.Tokens.stretches

    def __init__(self, texts):
        self.size = np.array([len(t) for t in texts])
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.classes = np.concatenate(texts).astype(np.int32)


def model(states, seed=0):
    rng = np.random.default_rng(seed)
    move = rng.random((states, states)) + 0.05
    emit = np.zeros((states, hmm.CLASSES))
    emit[:, :7] = rng.random((states, 7)) + 0.05
    start = rng.random(states)
    return hmm.Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def plain(text, p):
    """(log10 likelihood, state chances, expected moves) of one sequence by unscaled-per-step recursions."""
    alpha, scale = np.zeros((len(text), len(p.start))), np.zeros(len(text))
    for t, c in enumerate(text):
        alpha[t] = (p.start if t == 0 else alpha[t - 1] @ p.move) * p.emit[:, c]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    beta = np.ones_like(alpha)
    moves = np.zeros_like(p.move)
    for t in range(len(text) - 2, -1, -1):
        beta[t] = p.move @ (p.emit[:, text[t + 1]] * beta[t + 1]) / scale[t + 1]
        moves += np.outer(alpha[t], p.emit[:, text[t + 1]] * beta[t + 1]) * p.move / scale[t + 1]
    return np.log10(scale).sum(), alpha * beta, moves


def test_enumeration():
    p = model(3)
    texts = [RNG.integers(0, 7, n) for n in (1, 2, 5)]
    want = []
    for t in texts:
        ways = (np.prod([p.start[w[0]] * p.emit[w[0], t[0]]] + [p.move[a, b] * p.emit[b, c] for a, b, c in zip(w, w[1:], t[1:])]) for w in itertools.product(range(3), repeat=len(t)))
        want.append(np.log10(sum(ways)))
    assert hmm.log10_likelihood(Sequence(texts), p) == pytest.approx(want)


@pytest.mark.parametrize("stretch", [1, 3, 7, 512])
def test_stretches_change_nothing(monkeypatch, stretch):
    """Counts and likelihoods are those of whole texts, wherever they are cut."""
    monkeypatch.setattr(hmm, "STRETCH", stretch)
    p = model(4, 1)
    texts = [RNG.integers(0, 7, n) for n in (1, 3, 6, 7, 20, 1, 50, 14)]
    each = [plain(t, p) for t in texts]
    assert hmm.log10_likelihood(Sequence(texts), p) == pytest.approx([x[0] for x in each])
    got = hmm.expected_counts(Sequence(texts), p)
    emit = np.zeros_like(p.emit)
    for t, (_, gamma, _) in zip(texts, each, strict=True):
        for c, g in zip(t, gamma, strict=True):
            emit[:, c] += g
    assert np.allclose(got["emit"].reshape(emit.shape), emit)
    assert np.allclose(got["move"].reshape(4, 4), sum(x[2] for x in each))
    assert np.allclose(got["start"], sum(x[1][0] for x in each))


def test_rounds_never_lose(spark):
    """The likelihood of the training texts, with the prior, doesn't fall from round to round."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "a"]) + " " + rng.choice(["cat", "dog", "house"]) + " " + rng.choice(["runs", "sleeps"]) for _ in range(rng.integers(1, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string")
    v = hmm.vocabulary(hmm.cut(hmm.count_words(docs)), docs.count())
    tokens = hmm.Tokens(pa.array([r[1] for r in rows]), v)
    seen = [hmm.log10_likelihood(tokens, hmm.train(docs, v, 3, 0, n)).sum() for n in (0, 1, 4, 8)]
    assert seen == sorted(seen) and seen[-1] > seen[0] * 0.95
    assert hmm.log10_likelihood(tokens, hmm.train(docs, v, 3, 2, 1)).sum() > seen[0]


@pytest.mark.parametrize("states", [1, 3])
def test_texts_are_read_once(spark, states):
    """Training reads each text once, for its class sequence, and counts all of them in every step: the parameters are those of plain steps over the folds."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in rng.geometric(0.1, rng.integers(0, 900)))) for i in range(80)] + [(80, ""), (81, "\n"), (3, "w1 W1 w2")]
    reads = spark.sparkContext.accumulator(0)

    def seen(row):
        reads.add(1)
        return row

    plain_docs = spark.createDataFrame(rows, "id long, text string")
    v = hmm.vocabulary(hmm.cut(hmm.count_words(plain_docs)), len(rows))
    got = hmm.train(spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), "id long, text string"), v, states, 2, 1)
    assert reads.value == len(rows)
    fold = [r[0] for r in plain_docs.selectExpr(f"pmod(xxhash64(text), {hmm.FOLDS})").collect()]
    want = hmm.first_guess(v.mass, states)
    for step in [*range(hmm.FOLDS), *range(hmm.FOLDS), None]:
        texts = [t for (_, t), k in zip(rows, fold, strict=True) if step in (None, k)]
        want = hmm.maximise(hmm.expected_counts(hmm.Tokens(pa.array(texts), v), want), v.mass)
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(got, name), getattr(want, name), rtol=1e-9)


def test_blocks(spark):
    """The class sequences of all texts are written, a long text's in one row, two bytes a token."""
    rows = [(i, "a b c " * n) for i, n in enumerate([1, 0, 200_000, 3, 5])]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    v = hmm.vocabulary(hmm.cut(hmm.count_words(docs)), len(rows))
    got = hmm.encode(docs, v).collect()
    sizes = [n for r in got for n in np.frombuffer(r.size, np.int64).tolist()]
    assert sorted(sizes) == [1, 4, 10, 16, 600_001]
    assert all(len(r.classes) == 2 * np.frombuffer(r.size, np.int64).sum() for r in got)
