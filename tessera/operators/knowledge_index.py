"""A knowledge table that is kept up to date: only chunks that changed are embedded, only sources that changed are written.

The table holds each chunk with a digest of its content and its vector, in a folder for each source. A
refresh takes the chunks of one or more sources as they are now. A chunk whose digest is in the table
keeps its vector; others are embedded in batches of BATCH; chunks of those sources that are no longer
there go. Folders of sources without any change, and of sources that weren't given, aren't touched.

A search ranks the table's chunks of each source by vector, and all of them by keywords of reference and
snippet, and fuses the rankings.

chunk_id is the key within a source: of several chunks with one key the first by digest stays; chunks
without an id or a source are left out. The new state is written to the shared folder before a folder of
the table is replaced, so a refresh that fails half-way is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import postings as P
from tessera.operators import retrieval as R
from tessera.sources.tables import materialise, new_path, read_if_there

#: Chunks that an embedder is given at once.
BATCH = 32
CONTENT = ("snippet", "reference", "url", "embedding_text", "metadata")
TABLE = "chunk_id string, snippet string, reference string, url string, embedding_text string, metadata string, digest string, vector array<float>, source_type string"

Embedder = Callable[[list], list]


def hashed(texts: list, width: int = 64) -> list:
    """The embedder without a model: words hashed to signed dimensions, normalised, as functions.embedding has it."""
    import re
    import zlib

    import numpy as np

    out = np.zeros((len(texts), width))
    for row, text in zip(out, texts):
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode())
            row[h % width] += 1 if (h >> 16) % 2 == 0 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).tolist()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return read_if_there(spark, path, TABLE)


def embedded(chunks: DataFrame, embedder: Embedder, batch: int = BATCH) -> DataFrame:
    """chunks with vector, made from embedding_text by the embedder, batch rows at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["embedding_text"].fillna("").tolist()
            vectors = [v for a in range(0, len(texts), batch) for v in embedder(texts[a : a + batch])]
            yield frame.assign(vector=vectors)

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def refresh(chunks: DataFrame, path: str, embedder: Embedder = hashed, batch: int = BATCH) -> DataFrame:
    """Bring the table at path to the state of chunks(chunk_id, source_type, ...); (source_type, embedded, kept, removed) of what was done.

    Chunks of sources that aren't in chunks stay. A source that is to go whole is given by its folder being deleted.
    """
    spark = chunks.sparkSession
    content = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in CONTENT]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    now = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), *[F.col(c).cast("string").alias(c) for c in CONTENT], "source_type").withColumn("digest", content)
    now = now.where("chunk_id is not null and source_type is not null")
    now = now.withColumn("_k", F.row_number().over(W.partitionBy("source_type", "chunk_id").orderBy("digest"))).where("_k = 1").drop("_k")
    now = materialise(now, "knowledge-now")
    was = read_table(spark, path)
    key = ["source_type", "chunk_id", "digest"]
    same = now.join(was.select(*key, "vector"), key)
    fresh = embedded(now.join(was.select(*key), key, "left_anti"), embedder, batch)
    columns = [f.name for f in T._parse_datatype_string(TABLE)]
    state = materialise(fresh.withColumn("_new", F.lit(True)).unionByName(same.withColumn("_new", F.lit(False))).select(*columns, "_new"), "knowledge-state")
    gone = was.join(now.select("source_type").distinct(), "source_type", "left_semi").join(now.select("source_type", "chunk_id"), ["source_type", "chunk_id"], "left_anti").groupBy("source_type").agg(F.count("*").alias("removed"))
    done = state.groupBy("source_type").agg(F.count_if("_new").alias("embedded"), F.count_if(~F.col("_new")).alias("kept")).join(gone, "source_type", "left").select("source_type", "embedded", "kept", F.coalesce("removed", F.lit(0)).alias("removed"))
    done = materialise(done, "knowledge-done")
    changed = done.where("embedded > 0 or removed > 0").select("source_type")
    rows = state.drop("_new").join(F.broadcast(changed), "source_type", "left_semi").select(*columns)  # a row a source
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_type").parquet(path)
    return done


def rankings(table: DataFrame, queries: DataFrame, embedder: Embedder = hashed, k: int = R.TOP, threshold: float | None = 0.0) -> DataFrame:
    """(query_id, chunk_id, score, rank, ranking) for queries(query_id, text): a ranking by vector for each source, and one by keywords."""
    asked = embedded(queries.select("query_id", "text", F.col("text").alias("embedding_text")), embedder).select("query_id", "vector")
    asked = materialise(asked, "knowledge-queries")
    passages = table.select(F.concat_ws("/", "source_type", "chunk_id").alias("chunk_id"), F.col("source_type").alias("collection"), "vector")
    by_vector = R.vector_top_k(asked, passages, k, threshold)
    chunks = table.select(F.concat_ws("/", "source_type", "chunk_id").alias("chunk_id"), "reference", "snippet")
    path = new_path(table.sparkSession, "knowledge-postings")
    P.write_index(chunks, path)
    by_words = R.keyword_top_k(queries, P.read_index(table.sparkSession, path, chunks.schema["chunk_id"].dataType), k)
    return R.rankings(by_vector, by_words)


def search(table: DataFrame, queries: DataFrame, embedder: Embedder = hashed, k: int = 3, **more) -> DataFrame:
    """(query_id, chunk_id, rrf, raw_score, first, rank): the first k of the fused rankings; chunk_id is source/chunk."""
    return R.fused_top_k(rankings(table, queries, embedder, **more), k)
