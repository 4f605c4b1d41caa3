"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are embedded (a byte that ends RUN bytes equal to those of one of the
PERIODS before is another symbol, so that filters of one chunk can see repetition), cut into chunks of CHUNK bytes every STRIDE bytes so that
they overlap and cover the whole document, and FILTERS learned filters answer every chunk. The
answers are max-pooled over the document and a small dense layer turns them into one probability.

It is fitted on the driver, on the whole texts of at most SAMPLE_ROWS labelled documents of each class
(the ones of least hash, so reruns agree); that bound is the only one. Scoring reads every byte of
every text on the executors, BLOCK strides at a time, however long the text.

Defined cases: null and empty texts are scored as a document of padding; a label that is null or
neither 0 nor 1 isn't used; without labels of both classes the score is the share of label 1 (0.5 if
there are none). Repeated ids keep one row each. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_remainder, table, text_slices, utf8

STRIDE, CHUNK = 8, 16
EMBED, FILTERS, HIDDEN = 8, 32, 16
PAD = 512
#: A byte is marked if it and the RUN - 1 bytes before equal those a period earlier.
RUN, PERIODS = 16, range(2, 21)
SAMPLE_ROWS = 1500
#: Strides that are answered at once.
BLOCK = 1 << 14
KEEP_SCORE = 0.3


def repeated(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """256 for each byte that ends a repeated run inside its own document, else 0."""
    found = np.zeros(len(data), bool)
    for period in PERIODS:
        if len(data) < period + RUN:
            break
        same = data[period:] == data[:-period]
        for shift in (1, 2, 4, 8):
            same = same[shift:] & same[:-shift]
        found[period + RUN - 1 :] |= same
    for a in starts.tolist():
        found[a : a + RUN + PERIODS[-1]] = False
    return found.astype(np.int16) << 8


def layout(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded to whole strides and one more, and the stride at which each begins."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    strides = np.maximum(1, -(-sizes // STRIDE)) + 1
    start = np.concatenate([[0], np.cumsum(strides)])
    symbols = np.full(int(start[-1]) * STRIDE, PAD, np.int16)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = data + repeated(data, begins[:-1])
    for at, a, b in zip((start * STRIDE).tolist(), begins.tolist(), begins[1:].tolist()):
        symbols[at : at + b - a] = data[a:b]
    return symbols, start


def responses(model: dict, rows: np.ndarray) -> np.ndarray:
    """Every filter's answer to the chunk that begins at each stride of rows [stride, STRIDE] but the last."""
    both = model["embed"][rows].reshape(len(rows), -1) @ model["halves"]
    return both[:-1, :FILTERS] + both[1:, FILTERS:]


def blocks(model: dict, symbols: np.ndarray, start: np.ndarray):
    """Yield (texts, answers, their first stride, where each text begins and ends in them) over blocks that overlap by a stride."""
    rows = symbols.reshape(-1, STRIDE)
    for a in range(0, len(rows) - 1, BLOCK):
        b = min(len(rows) - 1, a + BLOCK)
        # the chunk at a text's last stride holds padding only: it is left out
        low, high = np.maximum(start[:-1], a), np.minimum(start[1:] - 1, b)
        inside = np.flatnonzero(low < high)
        yield inside, responses(model, rows[a : b + 1]), a, low[inside] - a, high[inside] - a


def pooled(model: dict, symbols: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The largest answer of each filter over all chunks of each text."""
    best = np.full((len(start) - 1, FILTERS), -np.inf, "f4")
    for inside, answer, _, low, high in blocks(model, symbols, start):
        edges = np.stack([low, high], 1).ravel()
        if len(edges):
            most = np.maximum.reduceat(answer, edges[:-1] if edges[-1] == len(answer) else edges, axis=0)[::2]
            best[inside] = np.maximum(best[inside], most)
    return best


def strongest(model: dict, symbols: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pooled, and the stride at which each filter's largest answer begins."""
    best, place = np.full((len(start) - 1, FILTERS), -np.inf, "f4"), np.zeros((len(start) - 1, FILTERS), np.int64)
    for inside, answer, first, low, high in blocks(model, symbols, start):
        for d, a, b in zip(inside.tolist(), low.tolist(), high.tolist()):
            at = answer[a:b].argmax(axis=0) + a
            found = answer[at, np.arange(FILTERS)]
            better = found > best[d]
            best[d, better], place[d, better] = found[better], at[better] + first
    return best, place


def head(model: dict, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    active = np.maximum(pooled + model["bias"], 0)
    hidden = np.tanh(active @ model["dense"] + model["dense_bias"])
    return active, hidden, 1 / (1 + np.exp(-np.clip(hidden @ model["out"] + model["out_bias"], -40, 40)))


def score_texts(model: dict, texts: list) -> np.ndarray:
    """Probability of label 1 for each text (bytes), over all of its chunks."""
    symbols, start = layout(texts)
    return head(model, pooled(model, symbols, start))[2] if "share" not in model else np.full(len(texts), model["share"])


def fit(texts: list, labels: np.ndarray, prior: float, least_epochs: int = 6, least_steps: int = 360, batch: int = 48, seed: int = 7) -> dict:
    """Adam, for a number of epochs and of steps at least, on the log loss of classes weighed alike; the prior's log odds are added to the output at the end."""
    if len(set(labels.tolist())) < 2:
        return {"share": float(labels.mean()) if len(labels) else 0.5, "embed": np.zeros((PAD + 1, EMBED), "f4"), "halves": np.zeros((STRIDE * EMBED, 2 * FILTERS), "f4")}
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype("f4")
    model = {"embed": normal(PAD + 1, EMBED, scale=0.5), "halves": normal(STRIDE * EMBED, 2 * FILTERS, scale=0.1), "bias": np.zeros(FILTERS, "f4"), "dense": normal(FILTERS, HIDDEN, scale=0.2), "dense_bias": np.zeros(HIDDEN, "f4"), "out": normal(HIDDEN, scale=0.3), "out_bias": np.zeros(1, "f4")}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    each = -(-len(texts) // batch)
    epochs = max(least_epochs, -(-least_steps // each))
    steps, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            symbols, start = layout([texts[i] for i in mine])
            most, best = strongest(model, symbols, start)
            active, hidden, p = head(model, most)
            rows = symbols.reshape(-1, STRIDE)
            grad = ((p - labels[mine]) * weight[mine] / len(mine)).astype("f4")
            g = {"out": hidden.T @ grad, "out_bias": grad.sum(keepdims=True)}
            back = np.outer(grad, model["out"]) * (1 - hidden**2)
            g |= {"dense": active.T @ back, "dense_bias": back.sum(0)}
            back = (back @ model["dense"].T) * (active > 0)
            g["bias"] = back.sum(0)
            g["halves"] = np.concatenate([np.einsum("df,dfk->kf", back, model["embed"][rows[best + k]].reshape(*best.shape, -1)) for k in (0, 1)], axis=1)
            g["embed"] = np.zeros_like(model["embed"])
            for k in (0, 1):
                kernel = model["halves"][:, k * FILTERS : (k + 1) * FILTERS].T.reshape(FILTERS, STRIDE, EMBED)
                np.add.at(g["embed"], rows[best + k].ravel(), (back[:, :, None, None] * kernel).reshape(-1, EMBED))
            steps += 1
            rate = 4e-3 * (1 - steps / (total + 1)) + 2e-4
            for k, v in model.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(s / (1 - 0.99**steps)) + 1e-7)
    model["out_bias"] = model["out_bias"] + np.float32(np.log(prior / (1 - prior)))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list, np.ndarray, float]:
    """At most SAMPLE_ROWS texts of each class from rows that may be learned from, their labels, and the share of label 1."""
    usable = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").where(F.col("quality").isin(0, 1) & (id_remainder("doc_id", 5) != 0))
    counts = dict(usable.groupBy("quality").count().collect())
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE_ROWS) for q in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * SAMPLE_ROWS rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").orderBy(F.xxhash64("doc_id", F.lit("row")), "doc_id", "text").limit(2 * SAMPLE_ROWS).collect()
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    return [(r["text"] or "").encode() for r in rows], np.array([r["quality"] for r in rows], np.float32), (n1 / (n0 + n1) if n0 and n1 else 0.5)


def fit_quality(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(*labelled_sample(docs, labels))


SCORE_SCHEMA = "doc_id long, score double"


def score_quality(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of each document's whole text. The model is a few KB of arrays."""

    def score(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            out = [score_texts(model, texts[a:b]) for a, b in text_slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).astype(float) if out else [], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(score, SCORE_SCHEMA)


def drop_low_quality(docs: DataFrame, model: dict, threshold: float = KEEP_SCORE) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least threshold."""
    names, kinds = docs.columns, docs.schema

    def keep(batches):
        for batch in batches:
            texts = utf8(batch.column(names.index("text")))
            out = [score_texts(model, texts[a:b]) for a, b in text_slices(texts)]
            yield batch.filter(pa.array(np.concatenate(out) >= threshold if out else [], pa.bool_()))

    return docs.mapInArrow(keep, kinds)


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of label 1, learned from labelled documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


QUERIES = {"op1_quality_cnn": op1_quality_cnn}
