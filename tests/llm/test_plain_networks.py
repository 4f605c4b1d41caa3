"""Both byte networks against plain loops over one text at a time, over block borders, and the classifier's gradient."""

import math

import numpy as np
import pytest

from tessera.llm import language_gru as G
from tessera.llm import quality_cnn as Q


def texts(seed, n=14):
    rng = np.random.default_rng(seed)
    some = lambda k: bytes(rng.choice(list(b"abc defg\n"), k))
    return [b"", b"a", b"12345678", b"x" * 90, b"ab" * 60 + some(50), some(40) + b"0123456789" * 9, *[some(int(k)) for k in rng.integers(1, 700, n)], "ä€😀 Wörter ".encode() * 12]


# quality classifier


def plain_symbols(text):
    out = []
    for i, b in enumerate(text):
        runs = i >= Q.RUN + Q.PERIODS[-1] and any(all(text[i - j] == text[i - j - p] for j in range(Q.RUN)) for p in Q.PERIODS)
        out.append(b + 256 if runs else b)
    strides = max(1, -(-len(text) // Q.STRIDE))
    return out + [Q.PAD] * ((strides + 1) * Q.STRIDE - len(text)), strides


def plain_score(model, text):
    symbols, strides = plain_symbols(text)
    embed, halves = model["embed"].astype(float), model["halves"].astype(float)
    best = [-math.inf] * Q.FILTERS
    for s in range(strides):
        chunk = [embed[x] for x in symbols[s * Q.STRIDE : s * Q.STRIDE + Q.CHUNK]]
        first, second = np.concatenate(chunk[: Q.STRIDE]), np.concatenate(chunk[Q.STRIDE :])
        for f in range(Q.FILTERS):
            best[f] = max(best[f], float(first @ halves[:, f] + second @ halves[:, Q.FILTERS + f]))
    active = [max(0.0, b + float(c)) for b, c in zip(best, model["bias"])]
    hidden = [math.tanh(sum(a * float(w) for a, w in zip(active, model["dense"][:, h])) + float(model["dense_bias"][h])) for h in range(Q.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * float(w) for a, w in zip(hidden, model["out"])) + float(model["out_bias"][0]))))


def quality_model(steps=30):
    rng = np.random.default_rng(3)
    clean = [bytes(rng.choice(list(b"abcdefgh "), 200)) for _ in range(30)]
    bad = [t[:-40] + b"#" * 40 for t in clean]
    return Q.fit(clean + bad, np.array([1.0] * 30 + [0.0] * 30), 0.5, 1, steps), clean + bad


@pytest.mark.parametrize("block", [1 << 14, 3])
def test_quality_scores_against_plain_loops(monkeypatch, block):
    """Texts of many blocks, borders inside texts and between them."""
    model, _ = quality_model()
    monkeypatch.setattr(Q, "BLOCK", block)
    some = texts(5, 6)
    assert max(len(t) for t in some) > 8 * Q.STRIDE * 3
    want = [plain_score(model, t) for t in some]
    assert np.allclose(Q.score_texts(model, some), want, atol=1e-4)
    symbols, start = Q.layout(some)
    assert np.allclose(Q.strongest(model, symbols, start)[0], Q.pooled(model, symbols, start))


def test_quality_gradient_has_the_numeric_sign():
    """Adam's first step goes against the sign of the gradient: a weight that moved must lower the plain loss."""
    _, some = quality_model(1)
    some, labels = some[24:36], np.array([1.0] * 6 + [0.0] * 6)
    before, after = Q.fit(some, labels, 0.5, 0, 0, batch=12), Q.fit(some, labels, 0.5, 1, 1, batch=12)

    def loss(model):
        p = [plain_score(model, t) for t in some]
        return -sum(math.log(x if y else 1 - x) for x, y in zip(p, labels)) / len(p)

    rng, seen = np.random.default_rng(1), 0
    for name in ("out", "out_bias", "dense", "dense_bias", "bias", "halves", "embed"):
        moved = np.argwhere(np.abs(after[name] - before[name]) > 1e-4)
        for at in moved[rng.permutation(len(moved))[:4]]:
            sides = []
            for step in (1e-3, -1e-3):
                model = {k: v.astype(float).copy() for k, v in before.items()}
                model[name][tuple(at)] += step
                sides.append(loss(model))
            slope = (sides[0] - sides[1]) / 2e-3
            if abs(slope) > 1e-5:
                assert (slope > 0) == (after[name][tuple(at)] < before[name][tuple(at)]), (name, at, slope)
                seen += 1
    assert seen > 12


# language identification


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_states(side, codes):
    """The states of one direction, number by number."""
    h, out = [0.0] * G.HIDDEN, []
    gates, state, given = (side[k].astype(float) for k in ("gates", "state", "in"))
    for c in codes:
        x = given[:, c]
        g = [sigmoid(float(gates[k] @ np.array(h)) + x[k]) for k in range(2 * G.HIDDEN)]
        q = [float(state[k] @ np.array(h)) for k in range(G.HIDDEN)]
        n = [math.tanh(g[k] * q[k] + x[2 * G.HIDDEN + k]) for k in range(G.HIDDEN)]
        h = [(h[k] - n[k]) * g[G.HIDDEN + k] + n[k] for k in range(G.HIDDEN)]
        out.append(h)
    return out


def plain_prediction(model, text):
    total, positions = np.zeros(len(model["bias"])), 0
    for begin in range(0, max(1, len(text)), G.WINDOW):
        places = range(begin - G.MARGIN, begin + G.WINDOW + G.MARGIN)
        codes = [text[p] if 0 <= p < len(text) else 256 for p in places]
        ahead, back = plain_states(model["forward"], codes), plain_states(model["backward"], codes[::-1])[::-1]
        for k in range(G.MARGIN, G.MARGIN + G.WINDOW):
            if begin + k - G.MARGIN < len(text):
                score = model["out"].astype(float) @ np.array(ahead[k] + back[k]) + model["bias"]
                odds = np.exp(score - score.max())
                total += odds / odds.sum()
                positions += 1
    return total / max(1, positions)


@pytest.mark.parametrize("block", [2048, 2])
def test_language_against_plain_loops(monkeypatch, block):
    """Texts of one window and of many, over block borders: the same labels, pooled alike."""
    learn = [b"the cat and the dog " * 5, "der Hund und die Maus ".encode() * 5, b"le chat et la souris " * 5]
    model = G.fit(learn, np.array([0, 1, 2]), 3, steps=25)
    monkeypatch.setattr(G, "BLOCK", block)
    some = [t for t in texts(6, 1) if t] + [x * 2 for x in learn]
    best, score = G.predict(model, some)
    for t, b, s in zip(some, best, score):
        want = plain_prediction(model, t)
        assert abs(want[b] - s) < 1e-3 and want[b] >= want.max() - 1e-3
