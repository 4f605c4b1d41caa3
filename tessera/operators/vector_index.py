"""An approximate index over vectors: a coarse quantiser, product-quantised residuals, exact re-scoring.

fit() learns from a bounded sample, the SAMPLE vectors of smallest hash: LISTS middles, and for each of
PARTS pieces of what is left after the nearest middle is taken off, 256 codewords. Every vector of the
table is indexed: its list, and a byte for each piece.

A search reads codes alone, PARTS bytes a vector instead of four for each of its numbers. A dot product
with a vector is about that with its middle plus those with its codewords, which are looked up in a
table made once for each query. Of the lists, a query looks into the `probes` whose middles score best
with it; of each collection the `keep` best by that estimate are joined with their vectors and scored
exactly, and the first k of those are the result. So scores are exact; what may be missed is a passage
in a list that isn't looked into, or one estimated too low. exact=True searches all vectors instead.

Passages without a vector, or with one of another length than most have, are in no list.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.retrieval import BLOCK_SCORES, MAX_QUERIES, TOP, small, top_k, vector_top_k

SAMPLE, ROUNDS = 20_000, 10
LISTS, PARTS, WORDS = 32, 16, 256
#: Lists that a search looks into: of 51,282 vectors without bundles, 24 of 32 find 0.96 of the first eight, 16 find 0.87.
PROBES = 24
#: Queries whose candidates a task sends in one batch.
ROWS = 500


@dataclass
class Codebook:
    """middles [lists, width], words [parts, codewords, width of a part]."""

    middles: np.ndarray
    words: np.ndarray

    @property
    def width(self) -> int:
        return self.middles.shape[1]

    def pieces(self, vectors: np.ndarray) -> np.ndarray:
        """[parts, rows, width of a part], filled with zeros where the width can't be divided."""
        parts, _, each = self.words.shape
        filled = np.zeros((len(vectors), parts * each))
        filled[:, : self.width] = vectors
        return filled.reshape(len(vectors), parts, each).transpose(1, 0, 2)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code [rows, parts]) of vectors."""
        where = nearest(vectors, self.middles)
        left = self.pieces(vectors - self.middles[where])
        return where, np.stack([nearest(p, w) for p, w in zip(left, self.words)], axis=1).astype(np.uint8)

    def estimates(self, queries: np.ndarray) -> np.ndarray:
        """[queries, parts, codewords]: what a codeword adds to a query's score."""
        return np.einsum("pqe,pwe->qpw", self.pieces(queries), self.words)


def nearest(vectors: np.ndarray, middles: np.ndarray) -> np.ndarray:
    return ((middles * middles).sum(axis=1) - 2 * vectors @ middles.T).argmin(axis=1)


def middles_of(vectors: np.ndarray, many: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from vectors drawn at random; a middle without vectors stays where it is."""
    draw = np.random.default_rng(seed)
    found = vectors[draw.permutation(len(vectors))[:many]].copy()
    for _ in range(ROUNDS):
        where = nearest(vectors, found)
        count = np.bincount(where, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, where, vectors)
        found[count > 0] = sums[count > 0] / count[count > 0, None]
    return found


def fit(passages: DataFrame, lists: int = LISTS, parts: int = PARTS, sample: int = SAMPLE) -> Codebook | None:
    """A codebook for passages(chunk_id, vector), from a sample of the most frequent width; None without vectors."""
    known = passages.where("vector is not null")
    most = known.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if most is None or most["w"] < 1:
        return None
    rows = known.where(F.size("vector") == most["w"]).orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").collect()
    vectors = np.array([r["vector"] for r in rows], float)
    middles = middles_of(vectors, lists, 1)
    each = -(-most["w"] // min(parts, most["w"]))
    book = Codebook(middles, np.zeros((-(-most["w"] // each), 1, each)))
    left = book.pieces(vectors - middles[nearest(vectors, middles)])
    return Codebook(middles, np.stack([middles_of(p, min(WORDS, len(p)), 2 + i) for i, p in enumerate(left)]))


def indexed(passages: DataFrame, book: Codebook) -> DataFrame:
    """(chunk_id, collection, list, code, vector): every passage that the codebook's width fits."""
    fits = passages.select("chunk_id", "collection", "vector").where(F.size("vector") == book.width)
    out = T.StructType([*[passages.schema[c] for c in ("chunk_id", "collection")], T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType()), passages.schema["vector"]])

    def run(batches):
        for batch in batches:
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, book.width)
            where, code = book.encode(vectors)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(where.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(2)], names=out.names)

    return fits.mapInArrow(run, out)


def write_index(passages: DataFrame, book: Codebook, path: str) -> DataFrame:
    """The index as a table with a folder for each list. A list may hold any share of the rows: its files are made by the tasks that read them."""
    indexed(passages, book).write.partitionBy("list").parquet(path)
    kinds = [passages.schema["chunk_id"], passages.schema["collection"], T.StructField("code", T.BinaryType()), passages.schema["vector"], T.StructField("list", T.IntegerType())]
    return passages.sparkSession.read.schema(T.StructType(kinds)).parquet(path)


class Best:
    """The keep best of each query so far: score, what decides between equal scores, and place (-1: none)."""

    def __init__(self, queries: int, keep: int):
        self.score = np.full((queries, keep), -np.inf)
        self.tie = np.full((queries, keep), np.iinfo(np.int64).max)
        self.place = np.full((queries, keep), -1, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, tie: np.ndarray, place: np.ndarray) -> None:
        """Scores of query with the vectors at place, which come in the order of tie."""
        score = np.where(np.isnan(score), -np.inf, score)
        better = score.max(axis=1) >= self.score[query, -1]
        query, score = query[better], score[better]
        keep = self.score.shape[1]
        first = np.argsort(-score, axis=1, kind="stable")[:, :keep]
        new = (np.take_along_axis(score, first, axis=1), tie[first], place[first])
        score, tie, place = (np.concatenate([old[query], x], axis=1) for old, x in zip((self.score, self.tie, self.place), new))
        order = np.lexsort((tie, -score), axis=1)[:, :keep]
        self.score[query], self.tie[query], self.place[query] = (np.take_along_axis(x, order, axis=1) for x in (score, tie, place))


def candidates(index: DataFrame, book: Codebook, names: list, matrix: np.ndarray, kind: T.StructField, probes: int, keep: int) -> DataFrame:
    """(query_id, collection, chunk_id, score): the keep best by estimate for each query and collection; a task sends no more of each, whatever it reads."""
    coarse = matrix @ book.middles.T
    looked = np.argsort(-coarse, axis=1, kind="stable")[:, :probes]
    asks = {int(x): np.flatnonzero((looked == x).any(axis=1)) for x in np.unique(looked)}
    sent = index.sparkSession.sparkContext.broadcast((names, coarse, book.estimates(matrix).astype(np.float32), asks))
    out = T.StructType([kind, *[index.schema[c] for c in ("collection", "chunk_id")], T.StructField("score", T.DoubleType())])
    ids = pa.int64() if isinstance(kind.dataType, T.LongType) else pa.int32() if isinstance(kind.dataType, T.IntegerType) else pa.string()

    def run(batches):
        names, coarse, tables, asks = sent.value
        parts, chunks, read, best = tables.shape[1], [], 0, {}
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(1)))
            lists = batch.column(2).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
            kind_of, groups = batch.column(0).type, batch.column(0).dictionary_encode()
            values, groups = groups.dictionary.to_pylist(), groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            # equal estimates go to the least chunk, or where ids are no integers to the first that is read
            tie = batch.column(1).fill_null(0).to_numpy() if pa.types.is_integer(batch.column(1).type) else np.arange(read, read + batch.num_rows)
            for x in np.unique(lists).tolist():
                own = asks.get(x, ())
                for c in np.unique(groups[lists == x]).tolist():
                    mine = np.flatnonzero((lists == x) & (groups == c))
                    held = best.setdefault(None if c < 0 else values[c], Best(len(names), keep))
                    step = max(1, BLOCK_SCORES // len(mine))
                    for a in range(0, len(own), step):
                        query = own[a : a + step]
                        score = coarse[query, x, None] + sum(tables[query, p][:, codes[mine, p]] for p in range(parts))
                        held.add(query, score, tie[mine], read + mine)
            chunks.append(batch.column(1))
            read += batch.num_rows
        if not read:
            return
        chunks = pa.chunked_array(chunks)
        for c, held in best.items():
            for a in range(0, len(names), ROWS):
                q, at = np.nonzero(held.place[a : a + ROWS] >= 0)
                q += a
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()], ids), pa.array([c] * len(q), kind_of), chunks.take(pa.array(held.place[q, at])).combine_chunks(), pa.array(held.score[q, at])], names=out.names)

    found = index.where(F.col("list").isin(sorted(asks))).select("collection", "chunk_id", "list", "code").mapInArrow(run, out)
    return top_k(found, ["query_id", "collection"], keep, [F.desc("score"), "chunk_id"]).drop("rank")


def search(index: DataFrame, book: Codebook, queries: DataFrame, k: int = TOP, probes: int = PROBES, keep: int = 16 * TOP, threshold: float | None = None, exact: bool = False) -> DataFrame:
    """(query_id, collection, chunk_id, score, rank) as retrieval.vector_top_k gives them, from the index; exact=True goes through all vectors."""
    if exact:
        return vector_top_k(queries, index.select("chunk_id", "collection", "vector"), k, threshold, book.width)
    known = queries.where(F.col("query_id").isNotNull() & (F.size("vector") == book.width)).select("query_id", "vector")
    n = known.count()
    if not n:
        return vector_top_k(known, index.select("chunk_id", "collection", "vector").limit(0), k, threshold, book.width)
    passes = -(-n // MAX_QUERIES)
    found = None
    for i in range(passes):
        rows = (known if passes == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)).collect()
        if not rows:
            continue
        names, matrix = [r["query_id"] for r in rows], np.array([r["vector"] for r in rows], float)
        part = candidates(index, book, names, matrix, known.schema["query_id"], probes, keep)
        found = part if found is None else found.unionByName(part)
    asked = known.dropDuplicates(["query_id"]).withColumnRenamed("vector", "_q")
    near = found.drop("score").join(small(asked), "query_id")
    scored = index.select("chunk_id", "collection", "vector").join(small(near), F.col("vector").isNotNull() & (index["chunk_id"] == near["chunk_id"]) & index["collection"].eqNullSafe(near["collection"]))
    dot = F.aggregate(F.zip_with("vector", "_q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = scored.select("query_id", index["collection"], index["chunk_id"], dot.alias("score"))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    return top_k(rows, ["query_id", "collection"], k, [F.desc(F.round("score", 12)), "chunk_id"])
