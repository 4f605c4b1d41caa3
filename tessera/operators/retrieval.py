"""Retrieval: vector and keyword rankings, reciprocal rank fusion, evidence lists."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import postings

RRF_K, TOP, THRESHOLD = 60, 8, 0.45
#: Query rows that are searched in one pass over the passages, and scores that a task holds at once.
MAX_QUERIES, BLOCK_SCORES = 10_000, 1 << 21
#: Rows up to which small() marks a side for broadcast; above, Spark joins by its own choice.
MAX_BROADCAST_ROWS = 200_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v)


def top_k(scored: DataFrame, by: list, k: int, order: list) -> DataFrame:
    """The first k rows of each group, with rank; Spark limits each partition's groups before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, passages: DataFrame, k: int = TOP, threshold: float | None = THRESHOLD, width: int | None = None) -> DataFrame:
    """(query_id, collection, chunk_id, score, rank): queries(query_id, vector) against passages(chunk_id, collection, vector).

    The query side is a stated set: MAX_QUERIES of them make a matrix that is multiplied with each
    batch of passages, BLOCK_SCORES products at a time, of which only a batch's first k for each query
    and collection are left; a larger set takes more passes. Scores are dot products, so of unit vectors
    cosines. width is the length of vectors, by default that of most passages (of equals the greater);
    passages and queries without a vector, or with one of another length, are in no ranking.
    """
    spark, known = queries.sparkSession, queries.where("query_id is not null and vector is not null")
    if width is None:
        most = passages.where("vector is not null").groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
        width = most["w"] if most else 0
    known = known.where(F.size("vector") == width)
    n = known.count()
    if n > MAX_QUERIES:
        parts = -(-n // MAX_QUERIES) * 2
        cut = F.pmod(F.xxhash64("query_id"), F.lit(parts))
        return reduce(DataFrame.unionByName, [vector_top_k(known.where(cut == i), passages, k, threshold, width) for i in range(parts)])
    rows = known.collect()
    names, matrix = [r["query_id"] for r in rows], np.array([r["vector"] for r in rows], float).reshape(len(rows), width)
    sent = spark.sparkContext.broadcast((names, matrix))
    schema = T.StructType([known.schema["query_id"], *[passages.schema[c] for c in ("collection", "chunk_id")], T.StructField("score", T.DoubleType())])

    def search(batches):
        names, matrix = sent.value
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(2)), width))
            if not (batch.num_rows and names):
                continue
            batch = batch.take(pc.sort_indices(batch.column(1)))  # ties go to the least chunk
            vectors = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            code = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            step = max(1, BLOCK_SCORES // batch.num_rows)
            for a in range(0, len(names), step):
                query, place, scores = first_of_batch(matrix[a : a + step], vectors, code, k, threshold)
                kept = batch.take(pa.array(place))
                yield pa.RecordBatch.from_arrays([pa.array([names[a + i] for i in query.tolist()], ids), kept.column(0), kept.column(1), pa.array(scores)], names=schema.names)

    ids = pa.int64() if isinstance(schema[0].dataType, T.LongType) else pa.int32() if isinstance(schema[0].dataType, T.IntegerType) else pa.string()
    found = passages.select("collection", "chunk_id", "vector").mapInArrow(search, schema)
    return top_k(found, ["query_id", "collection"], k, [F.desc(F.round("score", 12)), "chunk_id"])


def first_of_batch(matrix: np.ndarray, vectors: np.ndarray, code: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score): the first k vectors of each collection code for each query, in the order that breaks ties."""
    score, query, place = matrix @ vectors.T, [], []
    for c in np.unique(code).tolist():
        mine = np.flatnonzero(code == c)
        first = np.argsort(-np.round(score[:, mine], 12), axis=1, kind="stable")[:, :k]
        which = np.repeat(np.arange(len(matrix)), first.shape[1])
        good = np.ones(len(which), bool) if threshold is None else score[which, mine[first.ravel()]] >= threshold
        query.append(which[good])
        place.append(mine[first.ravel()][good])
    query, place = np.concatenate(query), np.concatenate(place)
    return query, place, score[query, place]


def small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has so few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def keyword_top_k(queries: DataFrame, index: DataFrame, k: int = TOP, stem=None) -> DataFrame:
    """(query_id, chunk_id, score, rank): queries(query_id, text) matched by any token in an index of postings."""
    found = postings.search(index, queries, k, stem)
    return top_k(found, ["query_id"], k, [F.desc(F.round("score", 6)), "chunk_id"])


def share_of_best(ranked: DataFrame, score: str = "score") -> Column:
    best = F.max(score).over(W.partitionBy("query_id"))
    return F.col(score) / F.when(best == 0, 1.0).otherwise(best)


def rankings(vectors: DataFrame, keywords: DataFrame) -> DataFrame:
    """One table (query_id, chunk_id, score, rank, ranking): a vector ranking for each collection, in their order, then the keywords."""
    number = F.col("collection").try_cast("double")
    ordered = F.struct(F.lit(0).alias("kind"), number.alias("number"), F.col("collection").cast("string").alias("name"))
    last = F.struct(F.lit(1).alias("kind"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("name"))
    row = lambda df, ranking: df.select("query_id", "chunk_id", F.col("score").cast("double").alias("score"), "rank", ranking.alias("ranking"))
    return row(vectors, ordered).unionByName(row(keywords, last))


def fuse(ranked: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rrf, raw_score, first) of rankings (query_id, chunk_id, score, rank, ranking)."""
    return ranked.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.max("score").alias("raw_score"), F.min(F.struct("ranking", "rank")).alias("first"))


def fused_top_k(ranked: DataFrame, k: int = 3) -> DataFrame:
    return top_k(fuse(ranked), ["query_id"], k, [F.desc(F.round("rrf", 9)), "first", "chunk_id"])


def rerank(candidates: DataFrame, scorer, first: int = 16, threshold: float = 0.0) -> DataFrame:
    """The first candidates of each query, scored by scorer(query texts, chunk texts) on Arrow batches, cut and sorted again."""

    def score(batches):
        for pdf in batches:
            yield pdf.assign(score=[float(x) for x in scorer(pdf["query_text"], pdf["chunk_text"])])

    kept = candidates.where(F.col("rank") <= first).drop("rank")
    scored = kept.mapInPandas(score, kept.schema).where(F.col("score") >= threshold)
    return top_k(scored, ["query_id"], first, [F.desc("score"), "chunk_id"])


def hits(ranked: DataFrame, width: int = 600) -> DataFrame:
    """What a caller sees of a ranking (query_id, chunk_id, snippet, source_type, reference, url, metadata map<string,string>, score, rank).

    A chunk without id is named after its place; snippets are cut to width; metadata without null values.
    """
    name = F.coalesce(F.col("chunk_id").cast("string"), F.concat(F.lit("hit-"), F.col("rank").cast("string")))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return ranked.select("query_id", "rank", name.alias("chunk_id"), empty("source_type"), empty("reference"), empty("url"), F.substring(F.coalesce("snippet", F.lit("")), 1, width).alias("snippet"), kept.alias("metadata"), "score")


def expanded_query(text: Column, nutrient: Column, substance: Column) -> Column:
    """A claim's search text: the wording, its nutrient, and its substance if that is another."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.concat_ws(" — ", text, filled(nutrient), F.when(~substance.eqNullSafe(nutrient), filled(substance)))


def evidence_lists(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims with evidence, an array of struct<rank, chunk_id, score>, empty where nothing was found."""
    lists = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))).alias("evidence"))
    empty = F.array().cast("array<struct<rank:int,chunk_id:bigint,score:double>>")
    return claims.join(lists, "query_id", "left").withColumn("evidence", F.coalesce("evidence", empty))
