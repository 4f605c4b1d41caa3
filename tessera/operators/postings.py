"""A stored inverted index over chunks, and keyword top-k that skips what can't be among the first.

A run is up to RUN chunks of one scan partition, in order of their ids. For each run the index has a row
with its chunk ids and, for each token in it, a block: the places of the chunks that have the token, what
the token adds to each of their scores (the sum of its occurrences' field weights), and the largest of
these. Blocks are stored by a hash of their token, so a search reads the buckets of its own tokens only.

A search deals the blocks of its tokens to shards, SHARD runs each. In a shard, a query's bound for a run
is the sum of the largest contributions of its tokens there. Runs are scored from the highest bound down,
until the bound is below the k-th score so far; a shard returns at most k rows for each query. So what
meets for the last top-k is at most k rows for each shard and query, however frequent the tokens are.

chunk_id is the key of the chunks. Null texts have no tokens; a null id is a chunk like others.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import query_tokens
from tessera.sources.tables import exists, new_path, shared_dir

# Weights of a term in a chunk's reference and in its snippet.
FIELD_WEIGHT = {"reference": 1.0, "snippet": 0.4}
#: Chunks of a run, runs of a shard, buckets of tokens (a bucket of their own has the runs' ids).
RUN, SHARD, BUCKETS, IDS = 1024, 16, 64, -1
#: Runs of which a bucket's blocks are written by one task.
SLAB = 1 << 16
#: Queries of one pass over the index.
MAX_QUERIES = 10_000
_WORD = r"(?U)\w+"


def _schema(ids: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("run", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("most", T.DoubleType()), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("chunks", T.ArrayType(ids))])


def bucket_of(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=4).digest(), "little") % BUCKETS


def blocks_of_run(number: int, ids: pa.Array, fields: list, weights: list, stem=None) -> dict:
    """The index rows of one run: its ids, and a block for each token of fields (a list of token lists for each weight)."""
    tokens = pa.concat_arrays([f.flatten() for f in fields])
    sizes = [f.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for f in fields]
    place = np.concatenate([np.repeat(np.arange(len(ids)), n) for n in sizes])
    weight = np.concatenate([np.full(n.sum(), w) for n, w in zip(sizes, weights)])
    coded = tokens.dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    if stem is not None:
        again = pa.array([stem(t) for t in names], pa.string()).dictionary_encode()
        names, code = again.dictionary.to_pylist(), again.indices.to_numpy(zero_copy_only=False)[code] if len(code) else code
    key, at = np.unique(code.astype(np.int64) * RUN + place, return_inverse=True)
    score = np.bincount(at, weights=weight, minlength=len(key)) if len(key) else np.zeros(0)
    first = np.flatnonzero(np.diff(key // RUN, prepend=-1))
    stops = np.append(first, len(key))[1:]
    chosen = [names[c] for c in (key[first] // RUN).tolist()]
    lists = lambda x: [None] + [x[a:b] for a, b in zip(first, stops)]
    return {
        "run": [number] * (len(first) + 1),
        "bucket": [IDS] + [bucket_of(t) for t in chosen],
        "token": [None] + chosen,
        "most": [None] + (np.maximum.reduceat(score, first).tolist() if len(first) else []),
        "places": lists((key % RUN).astype(np.int32)),
        "weights": lists(score),
        "chunks": [ids.to_pylist()] + [None] * len(first),
    }


def index_rows(chunks: DataFrame, fields: dict = FIELD_WEIGHT, stem=None) -> DataFrame:
    """The rows of the index over chunks(chunk_id, one column for each of fields). stem maps a token, as a Python function."""
    words = [F.regexp_extract_all(F.lower(F.coalesce(f, F.lit(""))), F.lit(_WORD), F.lit(0)).alias(f) for f in fields]
    schema, weights = _schema(chunks.schema["chunk_id"].dataType), list(fields.values())
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, RUN):
                part = batch.slice(a, RUN)
                part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                rows = blocks_of_run(number, part.column(0), part.columns[1:], weights, stem)
                arrays = [pa.array(rows[f.name], k) for f, k in zip(schema, [*kinds, pa.list_(part.column(0).type)])]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                number += 1

    return chunks.select("chunk_id", *words).mapInArrow(run, schema)


def write_index(chunks: DataFrame, path: str, fields: dict = FIELD_WEIGHT, stem=None) -> None:
    rows = index_rows(chunks, fields, stem)
    dealt = rows.repartition(F.col("bucket"), F.floor(F.col("run") / SLAB)).sortWithinPartitions("bucket", "token", "run")
    dealt.write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, ids: T.DataType) -> DataFrame:
    return spark.read.schema(_schema(ids)).parquet(path)


def kept_index(chunks: DataFrame, source: str, fields: dict = FIELD_WEIGHT, stem=None) -> DataFrame:
    """The index over chunks made from the table at source: the one in the shared folder if its files are as they were, else a new one."""
    spark = chunks.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for f in fs.listStatus(p)]
    files = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found)
    plan = [str(sorted(fields.items())), getattr(stem, "__qualname__", ""), str(chunks.schema["chunk_id"].dataType), chunks._jdf.queryExecution().analyzed().canonicalized().toString()]
    name = hashlib.sha256("\n".join([*files, *plan]).encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/postings-{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        made = new_path(spark, "postings-making")
        write_index(chunks, made, fields, stem)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(made), target):
            path = made  # another run has put its own there meanwhile
    return read_index(spark, path, chunks.schema["chunk_id"].dataType)


class Shard:
    """The blocks of a shard that a set of queries asks for."""

    def __init__(self, rows: pa.Table):
        self.ids, self.blocks = {}, {}
        run, token, most = (rows.column(c).to_pylist() for c in ("run", "token", "most"))
        columns = [rows.column(c).combine_chunks() for c in ("places", "weights")]
        spans = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in columns]
        chunks = rows.column("chunks")
        for i, (r, t, m) in enumerate(zip(run, token, most)):
            if t is None:
                self.ids[r] = chunks[i].as_py()
            else:
                self.blocks.setdefault(t, []).append((r, m, *(values[at[i] : at[i + 1]] for at, values in spans)))
        self.scored = 0

    def top(self, tokens: list, k: int) -> list:
        """(score, chunk) of the best k of a query: by score to six places, ties by chunk."""
        of_run: dict = {}
        for t in tokens:
            for r, most, places, weights in self.blocks.get(t, ()):
                of_run.setdefault(r, []).append((most, places, weights))
        bounds = sorted(((sum(b[0] for b in found), r) for r, found in of_run.items()), reverse=True)
        best: list = []
        for bound, r in bounds:
            if len(best) == k and bound + 1e-6 < -best[-1][0]:
                break
            self.scored += 1
            found = of_run[r]
            score = np.round(np.bincount(np.concatenate([b[1] for b in found]), weights=np.concatenate([b[2] for b in found])), 6)
            place = np.flatnonzero(score)
            first = place[np.argsort(-score[place], kind="stable")[:k]].tolist()  # places follow ids
            ids = self.ids[r]
            best = sorted([*best, *((-score[p], ids[p] is not None, ids[p]) for p in first)])[:k]
        return [(-s, chunk) for s, _, chunk in best]


def _solver(sent, k: int, kind: T.DataType):
    """A function of a shard's rows: the best k for each query of the broadcast set."""
    ids = pa.int64() if isinstance(kind, T.LongType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.string()

    def solve(rows):
        shard = Shard(rows)
        out = [(q, chunk, score) for q, own in sent.value.items() for score, chunk in shard.top(sorted(own), k)]
        query, chunk, score = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(query, ids), "chunk_id": pa.array(chunk, rows.schema.field("chunks").type.value_type), "score": pa.array(score, pa.float64())})

    return solve


def search(index: DataFrame, queries: DataFrame, k: int, stem=None) -> DataFrame:
    """(query_id, chunk_id, score): at most k rows for each shard and query of queries(query_id, text), among them its first k.

    The query side is a stated set: its tokens go to every task, MAX_QUERIES queries in a pass.
    """
    spark = index.sparkSession
    asked = queries.select("query_id", query_tokens(F.col("text")).alias("tokens")).where("query_id is not null")
    schema = T.StructType([queries.schema["query_id"], T.StructField("chunk_id", index.schema["chunks"].dataType.elementType), T.StructField("score", T.DoubleType())])
    n = asked.count()
    passes = -(-n // MAX_QUERIES) if n > MAX_QUERIES else 1
    found = None
    for i in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
        held: dict = {}
        for r in part.collect():
            held.setdefault(r["query_id"], set()).update(t if stem is None else stem(t) for t in r["tokens"] or [])
        sent, tokens = spark.sparkContext.broadcast(held), sorted(set().union(*held.values()) if held else ())
        buckets = sorted({bucket_of(t) for t in tokens})
        wanted = F.broadcast(spark.createDataFrame([(t,) for t in tokens], "token string"))  # tokens of one pass
        blocks = index.where(F.col("bucket").isin(buckets)).join(wanted, "token", "left_semi").select(*index.columns) if tokens else index.limit(0)
        rows = blocks.unionByName(index.where(F.col("bucket") == IDS)).withColumn("shard", F.floor(F.col("run") / SHARD))
        own = rows.groupBy("shard").applyInArrow(_solver(sent, k, schema[0].dataType), schema)
        found = own if found is None else found.unionByName(own)
    return found
