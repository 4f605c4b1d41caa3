"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read as memory-mapped sorted hash arrays.

Tokens are the words (A-Z lower-cased) and one end for each text. With c the count of a pair, and
its continuation count the number of different words before a word,

    p(w | v) = max(c(v w) - D(c), 0) / c(v .) + g(v) p(w)        g(v) gives back what D took
    p(w)     = max(k(w) - E(k), 0) / k(.)     + g / (V + 1)      k: continuation counts

with three discounts each (for 1, 2, 3 and more) from the counts of counts; V + 1 leaves room for
an unknown word. A context that was never seen leaves p(w) alone.

The work is cut by blocks of texts, of about BLOCK_TOKENS tokens each, and by shards of hashes:

1. each block counts its different words and pairs and sends each shard its sorted hash arrays;
2. a pair shard merges what all blocks sent, sends each block the counts of its pairs back (in the
   order sent, so no hash travels twice), and word shards what its pairs add to their words;
3. word shards merge that with the blocks' word counts to word statistics; their counts of counts
   are the only figures that reach the driver;
4. word shards send each block the statistics of its words;
5. a block's own part of the model is written to an unlinked file, memory-mapped, and its texts,
   kept as word numbers, are scored from it.

A common word is one entry for each block, so no key is hot. The number of shards follows from the
bytes of all texts, about SHARD_BYTES each, so that what a shard or a block holds at once is the same
for any input and any splits of it. Everything is counted over all training rows; pairs that only held-out
texts have come back as 0. Words are told apart by 64 bits of hash, in pairs by 48 each.

The blocks are made anew for each use, which needs an input that gives the same rows in the same
order when it is read again (files do); a difference is detected and raises ValueError.

Defined cases: a null text is empty, one end token. Null and repeated ids are scored row by row.
Without training texts the model is uniform: 1 / (V + 1) with V = 0.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import id_remainder, materialise, table

BLOCK_TOKENS = 1_000_000
#: Text bytes whose pairs and words meet in one shard, and rows of an Arrow batch that are Python objects at once.
SHARD_BYTES, SLICE_ROWS = 16 << 20, 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Tokens that no word can be: words hold no white space.
BEGIN, END = b" begin", b" end"
LOW = np.uint64(16)
BLOB_SCHEMA = "shard long, block long, kind string, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as byte planes, so that equal high bytes lie together; each with dtype and length."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return b"".join(out)


def unpack(data: bytes) -> list:
    arrays, at = [], 0
    while at < len(data):
        kind, n = np.dtype(data[at : at + 4].decode().strip()), int.from_bytes(data[at + 4 : at + 12], "little")
        at += 12
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        arrays.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * kind.itemsize
    return arrays


def small(values: np.ndarray) -> np.ndarray:
    """The values in the least unsigned type that holds them all."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def mixed(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each hash."""
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(shards)


def dealt(shard: np.ndarray, shards: int) -> list:
    """The positions of each shard's entries, in order."""
    order = np.argsort(shard.astype(np.min_scalar_type(shards)), kind="stable")
    return np.split(order, np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))[:-1])


class Block:
    """Texts as word numbers, the block's words and its pairs."""

    def __init__(self) -> None:
        self.number: dict = {}
        self.tokens: list = []
        self.ids: list = []
        self.lengths: list = []
        self.train: list = []

    def add(self, doc_id, text: bytes, train: bool) -> None:
        found = [BEGIN, *text.translate(_LOWER).split(), END]
        number = self.number
        self.tokens.append(np.array([number.setdefault(w, len(number)) for w in found], np.int32))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.train.append(train)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the words, and each word number's place among them."""
        h = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.number), np.uint64, len(self.number))
        order = np.argsort(h, kind="stable")
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        return h[order], place

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all tokens, which of them begin a text, and which are of training texts."""
        lengths = np.array(self.lengths)
        begin = np.zeros(int(lengths.sum()), bool)
        begin[np.cumsum(lengths) - lengths] = True
        return np.concatenate(self.tokens), begin, np.repeat(np.array(self.train), lengths)


def pair_keys(stream: np.ndarray, begin: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs (place of the first word << 32 | of the second) in order, and each non-begin token's pair."""
    at = place[stream]
    keys = (at[:-1] << 32 | at[1:])[~begin[1:]]
    return np.unique(keys, return_inverse=True)


def trained_pairs(stream: np.ndarray, begin: np.ndarray, train: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs as in pair_keys, and how often each is in training texts: one sort, with the train flag as lowest bit."""
    at = place[stream]
    keys = (at[:-1] << 32 | at[1:] << 1 | train[1:])[~begin[1:]]
    keys.sort()
    pairs = keys >> 1
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    pairs = pairs[starts]
    return pairs >> 31 << 32 | pairs & 0x7FFFFFFF, np.add.reduceat(keys & 1, starts)


def blocks(batches, block_tokens: int = BLOCK_TOKENS):
    """Yield (block id, Block) of Arrow batches (doc_id, text, train)."""
    split, k, block, held = TaskContext.get().partitionId(), 0, Block(), 0
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            for i, text, train in zip(*(c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns)):
                block.add(i, (text or "").encode(), train)
                held += block.lengths[-1]
                if held >= block_tokens:
                    yield split << 20 | k, block
                    k, block, held = k + 1, Block(), 0
    if block.ids:
        yield split << 20 | k, block


def blob_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=["shard", "block", "kind", "data"])


def send_pairs(shards: int):
    """Step 1, pairs: to each shard the block's pairs, as 48-bit hashes of both words, with training counts."""

    def run(batches):
        for name, block in blocks(batches):
            h, place = block.words()
            stream, begin, train = block.stream()
            keys, count = trained_pairs(stream, begin, train, place)
            first, second = h[keys >> 32] >> LOW, h[keys & 0xFFFFFFFF] >> LOW
            shard = mixed(first * np.uint64(0x9E3779B97F4A7C15) + second, shards)
            rows = []
            for s, mine in enumerate(dealt(shard, shards)):
                rows.append((s, name, "pairs", pack(*halves(first[mine]), *halves(second[mine]), small(count[mine]))))
            yield blob_batch(rows)

    return run


def halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 48-bit hash as its upper 32 and lower 16 bits."""
    return (h >> np.uint64(16)).astype(np.uint32), (h & np.uint64(0xFFFF)).astype(np.uint16)


def whole(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return upper.astype(np.uint64) << np.uint64(16) | lower


def merge_pairs(shards: int):
    """Step 2: sum a shard's pairs over blocks; send blocks their counts, and word shards the pairs' part in each word."""

    def run(keys, group):
        names, parts = group.column("block").to_pylist(), [unpack(d) for d in group.column("data").to_pylist()]
        sizes = [len(p[4]) for p in parts]
        first = np.concatenate([whole(p[0], p[1]) for p in parts])
        second = np.concatenate([whole(p[2], p[3]) for p in parts])
        count = np.concatenate([p[4].astype(np.int64) for p in parts])
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        total = np.add.reduceat(count[order], starts) if len(starts) else count[:0]
        back = np.empty(len(a), np.int64)
        back[order] = np.repeat(total, np.diff(np.append(starts, len(a))))
        rows, at = [], 0
        for name, n in zip(names, sizes):
            rows.append((keys[0].as_py(), name, "counts", pack(small(back[at : at + n]))))
            at += n
        seen = total > 0
        a, b, total = a[starts][seen], b[starts][seen], total[seen]
        # of words as contexts: sum of counts, pairs of count 1, 2, 3 and more; of words that follow: pairs
        context, where = np.unique(a, return_inverse=True)
        sums = [np.bincount(where, x, len(context)).astype(np.int64) for x in (total, total == 1, total == 2, total >= 3)]
        follows, kinds = np.unique(b, return_counts=True)
        for s, (mine, other) in enumerate(zip(dealt(mixed(context, shards), shards), dealt(mixed(follows, shards), shards))):
            rows.append((s, -1, "words", pack(*halves(context[mine]), *[small(x[mine]) for x in sums], *halves(follows[other]), small(kinds[other]))))
        rows.append((-1, -1, "kinds", pack(np.array([(total == k).sum() for k in (1, 2, 3, 4)], np.int64))))
        return pa.Table.from_batches([blob_batch(rows)])

    return run


def send_words(shards: int):
    """Step 1, words: to each shard the block's words, as 64-bit hashes, with training counts (begin isn't a token)."""

    def run(batches):
        for name, block in blocks(batches):
            h, place = block.words()
            stream, begin, train = block.stream()
            count = np.bincount(place[stream[train & ~begin]], minlength=len(h))
            yield blob_batch([(s, name, "block", pack(h[mine], small(count[mine]))) for s, mine in enumerate(dealt(mixed(h >> LOW, shards), shards))])

    return run


def merge_words(keys, group):
    """Step 3: a shard's word statistics as sorted hash arrays, and the figures that they add to the corpus."""
    kinds, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
    own = [unpack(d) for k, d in zip(kinds, data) if k == "block"]
    h = np.concatenate([p[0] for p in own] or [np.zeros(0, np.uint64)])
    words, where = np.unique(h, return_inverse=True)
    count = np.bincount(where, np.concatenate([p[1].astype(np.int64) for p in own] or [np.zeros(0)]), len(words)).astype(np.int64)
    parts = [unpack(d) for k, d in zip(kinds, data) if k == "words"]
    short = np.unique(words >> LOW)
    stats = np.zeros((5, len(short)), np.int64)  # sum, pairs of 1, 2, 3 and more, words before
    for p in parts:
        at = np.searchsorted(short, whole(p[0], p[1]))
        for i in range(4):
            stats[i, at] += p[2 + i].astype(np.int64)
        stats[4, np.searchsorted(short, whole(p[6], p[7]))] += p[8].astype(np.int64)
    figures = np.array([count.sum(), (count > 0).sum(), stats[4].sum(), *[(stats[4] == k).sum() for k in (1, 2, 3, 4)], (stats[4] >= 3).sum()], np.int64)
    rows = [(keys[0].as_py(), -1, "table", pack(words, small(count), short, *[small(x) for x in stats])), (-1, -1, "figures", pack(figures))]
    return pa.Table.from_batches([blob_batch(rows)])


def answer_words(keys, group):
    """Step 4: to each block the statistics of its words, in the order sent: count, context sums, words before."""
    kinds, names, data = (group.column(c).to_pylist() for c in ("kind", "block", "data"))
    words, count, short, *stats = unpack(data[kinds.index("table")])
    rows = []
    for k, name, d in zip(kinds, names, data):
        if k == "block":
            h = unpack(d)[0]
            at, low = np.searchsorted(words, h), np.searchsorted(short, h >> LOW)
            rows.append((keys[0].as_py(), name, "stats", pack(small(count[at].astype(np.int64)), *[small(x[low].astype(np.int64)) for x in stats])))
    return pa.Table.from_batches([blob_batch(rows)])


def send_texts(batches):
    """Step 5: a block's texts as word numbers, with what scoring needs to put the answers in order."""
    for name, block in blocks(batches):
        h, place = block.words()
        stream, begin, _ = block.stream()
        frequency = np.argsort(-np.bincount(place[stream], minlength=len(h)), kind="stable")
        rank = np.empty(len(h), np.int64)
        rank[frequency] = np.arange(len(h))  # common words get small numbers, which pack well
        ids = [0 if i is None else i for i in block.ids]
        data = pack(h, frequency.astype(np.uint32), rank[place[stream]].astype(np.uint32), np.array(block.lengths, np.uint32), np.array(ids, np.int64), np.array([i is None for i in block.ids], np.uint8), np.array(block.train, np.uint8))
        yield blob_batch([(-1, name, "texts", data)])


def discounts(kinds: list) -> list:
    """Modified Kneser-Ney discounts for counts 1, 2, 3 and more, from the numbers of kinds with count 1 to 4."""
    n1, n2, n3, n4 = kinds
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def taken(count: np.ndarray, d: list) -> np.ndarray:
    return np.where(count == 0, 0.0, np.where(count == 1, d[0], np.where(count == 2, d[1], d[2])))


def mapped(arrays: list) -> list:
    """The arrays in an unlinked file of the worker's temporary folder, memory-mapped."""
    out = []
    fd, path = tempfile.mkstemp()
    with os.fdopen(fd, "w+b") as file:
        os.unlink(path)
        for a in arrays:
            at = file.tell() + -file.tell() % 16
            file.seek(at)
            file.write(np.ascontiguousarray(a).tobytes())
            file.flush()
            out.append(np.memmap(file, a.dtype, "r", at, a.shape) if a.size else a)
    return out


SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_block(shards: int, model: dict):
    """Step 5: score a block's texts from the memory-mapped part of the model that came back to it."""

    def run(keys, group):
        kinds, shard, data = (group.column(c).to_pylist() for c in ("kind", "shard", "data"))
        of = {(k, s): d for k, s, d in zip(kinds, shard, data)}
        if ("texts", -1) not in of or len(of) != 2 * shards + 1:
            raise ValueError("the input gave other rows when it was read again")
        h, frequency, ranks, lengths, ids, no_id, _ = unpack(of["texts", -1])
        lengths = lengths.astype(np.int64)
        begin = np.zeros(len(ranks), bool)
        begin[np.cumsum(lengths) - lengths] = True
        at = frequency[ranks].astype(np.int64)
        pairs, which = pair_keys(at, begin, np.arange(len(h)))
        stats = np.zeros((6, len(h)), np.int64)
        word_place = dealt(mixed(h >> LOW, shards), shards)
        first, second = h[pairs >> 32] >> LOW, h[pairs & 0xFFFFFFFF] >> LOW
        pair_place = dealt(mixed(first * np.uint64(0x9E3779B97F4A7C15) + second, shards), shards)
        counts = np.zeros(len(pairs), np.int64)
        for s in range(shards):
            mine, theirs = pair_place[s], unpack(of["counts", s])[0]
            if len(theirs) != len(mine):
                raise ValueError("the input gave other rows when it was read again")
            counts[mine] = theirs
            stats[:, word_place[s]] = np.stack([x.astype(np.int64) for x in unpack(of["stats", s])])
        h, pairs, counts, stats = mapped([h, pairs, counts, stats])
        d, e, v = model["pair_discounts"], model["word_discounts"], model["words"]
        count, total, one, two, more, before = (np.asarray(x, float) for x in stats)
        uniform = 1 / (v + 1)
        if model["pairs"]:
            p1 = np.maximum(before - taken(before, e), 0) / model["pairs"] + model["word_mass"] * uniform
        else:
            p1 = np.full(len(h), uniform)
        context, word = pairs >> 32, pairs & 0xFFFFFFFF
        known = total[context] > 0
        below = np.where(known, total[context], 1)
        given = (d[0] * one + d[1] * two + d[2] * more)[context] / below
        p = np.where(known, np.maximum(counts - taken(counts, d), 0) / below + given * p1[word], p1[word])
        base = np.log10((count + 1) / (model["tokens"] + v + 1))
        starts = np.cumsum(lengths - 1) - (lengths - 1)
        words = at[~begin]
        columns = [np.add.reduceat(x, starts) for x in (base[words], np.log10(p)[which], (count[words] > 0).astype(np.int64))]
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=no_id.astype(bool)), "n_tokens": pa.array(lengths - 1), "n_known": pa.array(columns[2]), "base_score": pa.array(columns[0]), "score": pa.array(columns[1])})

    return run


def perplexity(docs: DataFrame, train) -> tuple[DataFrame, dict]:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs, and the model's figures.

    train: a boolean column, the rows to learn from. docs has doc_id and text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    sent = materialise(rows.mapInArrow(send_pairs(shards), BLOB_SCHEMA).groupBy("shard").applyInArrow(merge_pairs(shards), BLOB_SCHEMA), "pairs")
    words = rows.mapInArrow(send_words(shards), BLOB_SCHEMA)
    tables = materialise(words.unionByName(sent.where("kind = 'words'")).groupBy("shard").applyInArrow(merge_words, BLOB_SCHEMA), "words")
    kinds = [sum(x) for x in zip(*(unpack(r["data"])[0].tolist() for r in sent.where("kind = 'kinds'").select("data").collect()))] or [0] * 4
    figures = [sum(x) for x in zip(*(unpack(r["data"])[0].tolist() for r in tables.where("kind = 'figures'").select("data").collect()))] or [0] * 8
    tokens, v, pairs, n1, n2, n3, n4, n3_up = figures
    e = discounts([n1, n2, n3, n4])
    model = {"tokens": tokens, "words": v, "pairs": pairs, "pair_discounts": discounts(kinds), "word_discounts": e, "word_mass": (e[0] * n1 + e[1] * n2 + e[2] * n3_up) / pairs if pairs else 1.0}
    answers = words.unionByName(tables.where("kind = 'table'")).groupBy("shard").applyInArrow(answer_words, BLOB_SCHEMA)
    parts = rows.mapInArrow(send_texts, BLOB_SCHEMA).unionByName(sent.where("kind = 'counts'")).unionByName(answers)
    return parts.groupBy("block").applyInArrow(score_block(shards, model), SCORE_SCHEMA), model


def op9_lm_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from documents outside the held-out seventh."""
    scored, model = perplexity(table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (id_remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op9_lm_kneser_ney": op9_lm_kneser_ney}
