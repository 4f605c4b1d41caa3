"""Centroid clustering of integer vectors, with scalar lookup tables for distances.

Vectors become integers floor(scale * x). The k of smallest hash are the first centroids; each round
assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number)
and moves every centroid that has vectors to the exact floor of their mean.

Tables. One pass collects which integers occur in each dimension. In a round each task tabulates, for
each dimension, the squared difference of every occurring integer and every centroid; the distances of
a block of vectors are then rows gathered from those tables and summed, with no multiplication left.
Where more than TABLE_PAIRS pairs of dimension and integer occur, nothing is collected: each block
tabulates the integers that occur in itself, which gives the same distances.

A task sends one row of sums and a count for each centroid, never vectors, and sums are added as
decimals, so a centroid may hold any share of the rows. The driver sees k rows a round.

Defined cases: vectors that are null, of another width, or hold a null, a NaN or an infinite component
take no part. A null id hashes as the empty text; equal hashes are ordered by id, then by vector.
Repeated rows all count. Fewer than k vectors make fewer centroids; an empty table has no rows. An
integer beyond LIMIT raises an error, as squared distances would leave a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, table

CENTROIDS, ROUNDS, WIDTH, SCALE = 40, 5, 64, 256
#: Pairs of dimension and integer that are tabulated once for all (8 bytes for each of them and each centroid).
TABLE_PAIRS = 1 << 16
#: The largest integer either way, and the vectors whose distances are held at once.
LIMIT, BLOCK = 1 << 27, 4096


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, as integers."""
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == width) & F.forall("embedding", finite))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    inside = F.forall("v", lambda x: F.abs(x) <= LIMIT)
    checked = F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))
    return kept.select("vec_id", whole.alias("v")).select("vec_id", checked.cast("array<int>").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def occurring(vectors: DataFrame, width: int) -> list[np.ndarray] | None:
    """The integers of each dimension in order, or None where there are more than TABLE_PAIRS in all."""

    def run(batches):
        found = [np.zeros(0, np.int32)] * width
        for batch in batches:
            block = matrix(batch.column(0), width)
            found = [np.union1d(f, block[:, d]) for d, f in enumerate(found)]
        sizes = [len(f) for f in found]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width, dtype=np.int32), sizes)), pa.array(np.concatenate(found))], names=["d", "x"])

    pairs = vectors.select("v").mapInArrow(run, "d int, x int").distinct().limit(TABLE_PAIRS + 1).toArrow()
    if pairs.num_rows > TABLE_PAIRS:
        return None
    d, x = pairs.column("d").to_numpy(), pairs.column("x").to_numpy()
    return [np.sort(x[d == i]) for i in range(width)]


def tabulate(values: list[np.ndarray], centroids: np.ndarray) -> list[np.ndarray]:
    """For each dimension the squared differences [integer, centroid], in the narrowest type that holds their sums."""
    differences = [v[:, None].astype(np.int64) - centroids[None, :, d] for d, v in enumerate(values)]
    most = sum(int(np.abs(x).max(initial=0)) ** 2 for x in differences)
    return [(x * x).astype(np.int32 if most < 1 << 31 else np.int64) for x in differences]


def nearest(block: np.ndarray, values: list[np.ndarray], tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid, for each row of a block."""
    total = np.zeros((len(block), tables[0].shape[1]), tables[0].dtype)
    for d, (v, t) in enumerate(zip(values, tables)):
        total += t[np.searchsorted(v, block[:, d])]
    cluster = total.argmin(axis=1)  # the first of equal ones
    return cluster, total[np.arange(len(block)), cluster].astype(np.int64)


def assigner(centroids: np.ndarray, values: list[np.ndarray] | None):
    """A function from a matrix of vectors to pieces (rows, cluster, distance)."""
    ready = values and tabulate(values, centroids)

    def run(vectors: np.ndarray):
        for a in range(0, len(vectors), BLOCK):
            block = vectors[a : a + BLOCK]
            own = values or [np.unique(block[:, d]) for d in range(block.shape[1])]
            yield block, *nearest(block, own, ready or tabulate(own, centroids))

    return run


def assigned(vectors: DataFrame, centroids: np.ndarray, values: list[np.ndarray] | None) -> DataFrame:
    """(vec_id, cluster, distance) of vectors(vec_id, v)."""
    width = centroids.shape[1]

    def run(batches):
        assign = assigner(centroids, values)
        for batch in batches:
            found = list(assign(matrix(batch.column(1), width)))
            if found:
                cluster, distance = (np.concatenate([x[i] for x in found]) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"]
    return vectors.select("vec_id", "v").mapInArrow(run, T.StructType([kind, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]))


def moved(vectors: DataFrame, centroids: np.ndarray, values: list[np.ndarray] | None) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def run(batches):
        assign, sums, counts = assigner(centroids, values), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for block, cluster, _ in assign(matrix(batch.column(0), width)):
                order = np.argsort(cluster, kind="stable")
                which, first, count = np.unique(cluster[order], return_index=True, return_counts=True)
                sums[which] += np.add.reduceat(block[order].astype(np.int64), first, axis=0)
                counts[which] += count
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    parts = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    found = parts.groupBy("cluster", "d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    after = centroids.copy()
    for r in found:
        after[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return after


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = "2:") -> tuple[np.ndarray, list[np.ndarray] | None]:
    """The centroids [number, dimension] of vectors(vec_id, v) after the rounds, and the integers that occur."""
    named = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.orderBy(named, "vec_id", "v").limit(k).select("v").collect()
    if not first:
        return np.zeros((0, 0), np.int64), []
    centroids = np.array([r["v"] for r in first], np.int64)
    values = occurring(vectors, centroids.shape[1])
    for _ in range(rounds):
        centroids = moved(vectors, centroids, values)
    return centroids, values


def op12_centroid_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster, distance, the inertia of its cluster and of all, and its centroid's digest."""
    vectors = materialise(quantised(table(spark, sf_dir, "embeddings")), "centroid-vectors")
    centroids, values = fit(vectors)
    if not len(centroids):
        none = ("cast(0 as int) cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
        return vectors.selectExpr("vec_id", *none)
    found = materialise(assigned(vectors, centroids, values), "centroid-assigned")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(inertia.values())
    # a row for each centroid, k at most
    about = spark.createDataFrame([(c, inertia[c], whole, ",".join(map(str, centroids[c].tolist()))) for c in inertia], "cluster int, cluster_inertia long, inertia long, components string")
    about = about.withColumn("centroid_sha256", F.sha2(F.col("components").cast("binary"), 256)).drop("components")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    square = "cast(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    assign = "a{0} as materialized (select rid, vec_id, v, c, distance from (select k.rid, k.vec_id, k.v, c.c, " + square + " distance from k, c{0} c) qualify row_number() over (partition by rid order by distance, c) = 1)"
    move = """c{1} as materialized (
      select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) v from (select c, i, cast(sum(x) as bigint) s, count(*) n from (select c, unnest(v) x, unnest(range(1, 65)) i from a{0}) group by c, i) group by c
      union all select c, v from c{0} where c not in (select c from a{0}))"""
    steps = [assign.format(0)]
    for r in range(ROUNDS):
        steps += [move.format(r, r + 1), assign.format(r + 1)]
    return f"""
with k as materialized (
  select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) v from embeddings
  where len(embedding) = {WIDTH} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('2:' || coalesce(cast(vec_id as varchar), '')), vec_id, v) - 1 c, v from k qualify c < {CENTROIDS}),
{", ".join(steps)}
select a.vec_id, cast(a.c as integer) cluster, a.distance, cast(sum(a.distance) over (partition by a.c) as bigint) cluster_inertia, cast(sum(a.distance) over () as bigint) inertia,
  sha256(array_to_string(c.v, ',')) centroid_sha256 from a{ROUNDS} a join c{ROUNDS} c using (c)"""


QUERIES = {"op12_centroid_tables": op12_centroid_tables}
ORACLES = {"op12_centroid_tables": _sql()}
