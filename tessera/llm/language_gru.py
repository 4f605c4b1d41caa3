"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes that together cover the whole text. A
window is read with MARGIN bytes more on both sides: one gated recurrent layer runs over it forwards
and one backwards, so every position is labelled with at least MARGIN bytes of context to its left
and right (fewer only at the text's ends). The two states label each of the window's own positions
with a probability per language, and a document's probabilities are the mean over all its positions.

Weights are learned on the driver by backpropagation through time over all positions of windows of
a bounded sample: about SAMPLE_ROWS whole documents of each language, chosen by hash, and about
MOST_ROWS in all (at least one row's share of each language). Predictions read every byte of every
text on the executors, BLOCK windows at a time, however long the text.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text if
nothing can be learned from. Null languages aren't learned. Rows with repeated ids are predicted one
by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_remainder, table, text_slices, utf8

WINDOW, MARGIN, HIDDEN = 64, 16, 8
SAMPLE_ROWS, MOST_ROWS = 400, 4000
#: Windows that are labelled at once.
BLOCK = 2048


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(1) / (1 + np.exp(np.minimum(-x, 80)))


def tanh(x: np.ndarray) -> np.ndarray:
    return 1 - np.float32(2) / (1 + np.exp(np.minimum(2 * x, 80)))


def run(side: dict, codes: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States [time, HIDDEN, row] of one direction over codes [time, row]; tape keeps what the backward pass needs."""
    h = np.zeros((HIDDEN, codes.shape[1]), "f4")
    out = np.empty((len(codes), *h.shape), "f4")
    weights = np.concatenate([side["gates"], side["state"]])
    for t in range(len(codes)):
        x = side["in"].take(codes[t], axis=1)
        both = weights @ h
        both[: 2 * HIDDEN] += x[: 2 * HIDDEN]
        s, q = sigmoid(both[: 2 * HIDDEN]), both[2 * HIDDEN :]
        r, z = s[:HIDDEN], s[HIDDEN:]
        a = r * q
        a += x[2 * HIDDEN :]
        n = tanh(a)
        if tape is not None:
            tape.append((h, r, z, q, n))
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
        if tape is not None:
            h = h.copy()
    return out


def states(model: dict, codes: np.ndarray) -> np.ndarray:
    """States [time, 2 * HIDDEN, row] of both directions."""
    return np.concatenate([run(model["forward"], codes), run(model["backward"], codes[::-1])[::-1]], axis=1)


def probabilities(model: dict, both: np.ndarray) -> np.ndarray:
    """Language probabilities [time, language, row] of every position."""
    score = model["out"] @ both
    score += model["bias"][:, None]
    score -= score.max(axis=1, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=1, keepdims=True)
    return score


def layout(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as symbols (256 is padding, a margin at both ends), where each window begins there, and each text's first window."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    counts = np.maximum(1, -(-sizes // WINDOW))
    start = np.concatenate([[0], np.cumsum(counts)])
    places = start[:-1] * WINDOW + 2 * MARGIN * np.arange(len(texts))
    symbols = np.full(int(start[-1]) * WINDOW + 2 * MARGIN * len(texts), 256, np.int16)
    for at, t in zip((places + MARGIN).tolist(), texts):
        symbols[at : at + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    return symbols, places[owner] + WINDOW * (np.arange(start[-1]) - start[owner]), start


def read(symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Codes [time, window] of the windows with their margins."""
    return symbols[begins + np.arange(WINDOW + 2 * MARGIN)[:, None]].astype(np.int64)


def windows(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes [time, window] of all texts, and the window at which each text begins."""
    symbols, begins, start = layout(texts)
    return read(symbols, begins), start


def own(codes: np.ndarray) -> np.ndarray:
    """1 for the positions that are a window's own and in the text."""
    real = (codes < 256).astype("f4")
    real[:MARGIN] = real[MARGIN + WINDOW :] = 0
    return real


def predict(model: dict, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Index of the likeliest language and its pooled probability, for each text (bytes)."""
    symbols, begins, start = layout(texts)
    sums, sizes = np.zeros((len(begins), len(model["bias"]))), np.zeros(len(begins))
    mine = slice(MARGIN, MARGIN + WINDOW)
    for a in range(0, len(begins), BLOCK):
        codes = read(symbols, begins[a : a + BLOCK])
        real = (codes[mine] < 256).astype("f4")
        sums[a : a + BLOCK] = (probabilities(model, states(model, codes)[mine]) * real[:, None]).sum(axis=0).T
        sizes[a : a + BLOCK] = real.sum(axis=0)
    total = np.add.reduceat(sums, start[:-1], axis=0) / np.maximum(np.add.reduceat(sizes, start[:-1]), 1)[:, None]
    best = total.argmax(axis=1)
    return best, np.clip(total[np.arange(len(best)), best], 0, 1)


def through_time(side: dict, codes: np.ndarray, tape: list, grad: np.ndarray, out: dict) -> None:
    """Add to out the gradients of one direction, given those of its states [time, HIDDEN, row]."""
    back = np.zeros_like(grad[0])
    inputs = np.empty((3 * HIDDEN, *codes.shape), "f4")
    for t in range(len(codes) - 1, -1, -1):
        h, r, z, q, n = tape[t]
        back = back + grad[t]
        da = back * (1 - z) * (1 - n * n)
        dgates = np.concatenate([da * q * r * (1 - r), back * (h - n) * z * (1 - z)])
        dq = da * r
        inputs[: 2 * HIDDEN, t], inputs[2 * HIDDEN :, t] = dgates, da
        out["gates"] += dgates @ h.T
        out["state"] += dq @ h.T
        back = back * z + side["gates"].T @ dgates + side["state"].T @ dq
    where = codes.ravel()
    for k in range(3 * HIDDEN):
        out["in"][k] += np.bincount(where, inputs[k].ravel(), out["in"].shape[1])


def fit(texts: list, classes: np.ndarray, languages: int, steps: int = 240, rows: int = 192, seed: int = 11) -> dict:
    """Adam on the mean log loss of all positions; windows are drawn alike from all languages."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype("f4")
    side = lambda: {"in": normal(3 * HIDDEN, 257, scale=0.5), "gates": normal(2 * HIDDEN, HIDDEN, scale=0.4), "state": normal(HIDDEN, HIDDEN, scale=0.4)}
    model = {"forward": side(), "backward": side(), "out": normal(languages, 2 * HIDDEN, scale=0.3), "bias": np.zeros(languages, "f4")}
    flat = [("out", model), ("bias", model), *((k, model[d]) for d in ("forward", "backward") for k in ("in", "gates", "state"))]
    moments = [(np.zeros_like(o[k]), np.zeros_like(o[k])) for k, o in flat]
    symbols, begins, start = layout(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(start))
    by_class = [np.flatnonzero(classes[owner] == c) for c in range(languages)]
    present = [c for c in range(languages) if len(by_class[c])]
    for step in range(1, steps + 1):
        drawn = rng.choice(present, rows)
        mine = np.array([rng.choice(by_class[c]) for c in drawn])
        x = read(symbols, begins[mine])
        tapes: tuple = ([], [])
        both = np.concatenate([run(model["forward"], x, tapes[0]), run(model["backward"], x[::-1], tapes[1])[::-1]], axis=1)
        score = probabilities(model, both)
        real = own(x)
        score[:, drawn, np.arange(rows)] -= 1
        score *= (real / real.sum())[:, None]
        grads: dict = {d: {k: np.zeros_like(v) for k, v in model[d].items()} for d in ("forward", "backward")}
        grads |= {"out": np.einsum("tlr,thr->lh", score, both, optimize=True), "bias": score.sum(axis=(0, 2))}
        back = model["out"].T @ score
        through_time(model["forward"], x, tapes[0], back[:, :HIDDEN], grads["forward"])
        through_time(model["backward"], x[::-1], tapes[1], back[::-1, HIDDEN:], grads["backward"])
        all_grads = [grads["out"], grads["bias"], *(grads[d][k] for d in ("forward", "backward") for k in ("in", "gates", "state"))]
        rate = 0.02 * (1 - step / (steps + 1)) + 5e-4
        for (k, o), (m, s), g in zip(flat, moments, all_grads):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            o[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return model


def fit_languages(docs: DataFrame) -> tuple[dict, list]:
    """The model and its languages, from rows that may be learned from."""
    usable = docs.selectExpr("cast(doc_id as long) doc_id", "text", "lang").where(F.col("lang").isNotNull() & (id_remainder("doc_id", 3) != 1))
    counts = dict(usable.groupBy("lang").count().collect())
    languages = sorted(counts)
    if not languages:
        return {}, []
    each = max(1, min(SAMPLE_ROWS, MOST_ROWS // len(languages)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, min(1.0, each / v))])[F.col("lang")], F.lit(0.0))
    some = usable.where((draw < share) & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    rows = some.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "text").limit(2 * each * len(languages)).collect()
    if not rows:
        return {}, []
    place = {k: i for i, k in enumerate(languages)}
    return fit([r["text"].encode() for r in rows], np.array([place[r["lang"]] for r in rows]), len(languages)), languages


PREDICTION_SCHEMA = "doc_id long, lang_pred string, score double"


def identify(docs: DataFrame, model: dict, languages: list) -> DataFrame:
    """(doc_id, lang_pred, score) of each document's whole text. The model is a few KB of arrays."""

    def label(batches):
        for batch in batches:
            texts, lettered = utf8(batch.column(1)), np.array(batch.column(2).to_pylist(), bool)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if model:
                for a, b in text_slices(texts):
                    best[a:b], score[a:b] = predict(model, texts[a:b])
            named = [languages[k] if ok and model else "und" for k, ok in zip(best.tolist(), lettered)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")).mapInArrow(label, PREDICTION_SCHEMA)


def op3_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, *fit_languages(docs))
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_gru": op3_language_gru}
