"""Exact top-k by inner product: a Voronoi join of queries and data.

Vectors become integers floor(SCALE * x). Pivots are drawn from the data by hash; every vector belongs to
the cell of its nearest pivot. Summaries of a cell are its number of vectors, their greatest distance
from the pivot, and the k + 1 vectors nearest to it (one more than k, as one may be the query itself).

Bounds. The vectors of all summaries are few and go to every task: the k-th best of a query's scores
against them is a score that its k-th neighbour has at least. A cell of queries with pivot p has as its
bound t the least of these, and r, the greatest distance of a query from p. A vector s scores at most
p.s + r|s| with any of them; from summaries alone, a cell of data with pivot c and greatest distance d
scores at most p.c + r|c| + n d, where n is the greatest length of a query. Data go to a group of query
cells only where a cell of it needs them by both tests; no row that could be in a result is left out.

Groups are made of neighbouring cells up to GROUP_QUERIES queries; a cell with more is split by hash.
The data of a group are dealt to slices of about SLICE_ROWS rows, so that no cell, however full, meets in
one task. A task holds one group of queries and one slice, solves it with blocks of products, and
returns at most k rows for each query; a window over queries keeps the best k of all slices.

Where data have no near neighbours (as random vectors of many dimensions) the bounds exclude little,
and the join reads all data once for each group of queries.

Defined cases: vectors that are null or hold a null, a NaN or an infinite component take no part, neither
as queries nor as data. Of vectors of different lengths the components that both have are multiplied
(an empty vector scores 0). A row is never its own neighbour, but another row with its id may be. Null
ids are never queries and come last among ties; rows with equal ids are all queries. Queries with fewer
than k other vectors get as many. A component beyond LIMIT, or a score beyond a long, raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.centroids import finite
from tessera.llm.common import materialise, table

TOP, SCALE, QUERY_EVERY = 10, 1024, 100
#: Pivots for each group of queries, and the most of them.
PIVOTS_A_GROUP, MOST_PIVOTS = 16, 512
GROUP_QUERIES, SLICE_ROWS = 8192, 1 << 16
#: Numbers of a block of scores, rows sent on at once, and the largest component either way (exact as a double).
BLOCK_SCORES, SENT_ROWS, LIMIT = 1 << 21, 1 << 15, 1 << 53
#: Relative slack of bounds, far above the rounding of doubles.
SLACK = 1e-9
_PACKED = "row long, vec_id long, query boolean, v binary, cell int, away double, length double"


def pack(block: np.ndarray) -> list[bytes]:
    """Rows as bytes: 16-bit integers where all components fit, else doubles."""
    narrow = (np.abs(block) < 1 << 15).all(axis=1).tolist()
    short, full = block.astype("<i2") if any(narrow) else None, block.astype("<f8")
    return [short[i].tobytes() if n else full[i].tobytes() for i, n in enumerate(narrow)]


def unpack(column, width: int) -> np.ndarray:
    """A matrix of doubles from packed rows; their size tells their type."""
    rows = column.to_pylist()
    narrow = np.fromiter((len(r) == 2 * width for r in rows), bool, len(rows))
    found = np.empty((len(rows), width))
    for kind, chosen in (("<i2", narrow), ("<f8", ~narrow)):
        at = np.flatnonzero(chosen)
        found[at] = np.frombuffer(b"".join([rows[i] for i in at.tolist()]), kind).reshape(-1, width)
    return found


def padded(column, width: int) -> np.ndarray:
    """A matrix of doubles from lists, cut or filled with zeros to width."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    found, start = np.zeros((len(sizes), width)), 0
    for i, n in enumerate(sizes.tolist()):
        found[i, : min(n, width)] = flat[start : start + min(n, width)]
        start += n
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products [row of a, row of b], as doubles where those are exact, else as longs."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return a @ b.T
    whole = [np.array([[int(x) for x in row] for row in m.tolist()], object) for m in (a, b)]
    return (whole[0] @ whole[1].T).astype(np.int64)  # raises where a long can't hold a score


def prepared(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, query, v): vectors that take part, as integers, numbered."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    kept = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", finite)).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    checked = F.when(F.forall("v", lambda x: F.abs(x) < LIMIT), F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact scores")))
    return kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.coalesce(F.col("vec_id") % QUERY_EVERY == 0, F.lit(False)).alias("query"), checked.cast("array<long>").alias("v"))


def draw_pivots(vectors: DataFrame, many: int, width: int) -> np.ndarray:
    """Up to many different vectors, those of smallest hash."""
    drawn = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(4 * many).toArrow().combine_chunks()
    block = padded(drawn.column("v").combine_chunks(), width)
    first = np.sort(np.unique(block, axis=0, return_index=True)[1])[:many]
    return block[first]


def in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Packed vectors with the cell of the nearest pivot, the distance from it and the length."""
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            block = padded(batch.column(3), width)
            cell = ((pivots * pivots).sum(axis=1) - 2 * (block @ pivots.T)).argmin(axis=1)
            away, length = np.linalg.norm(block - pivots[cell], axis=1), np.linalg.norm(block, axis=1)
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(pack(block), pa.binary()), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(length)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "query", "v", "cell", "away", "length"])

    return vectors.select("row", "vec_id", "query", "v").mapInArrow(run, _PACKED)


def with_bounds(queries: DataFrame, members: np.ndarray, rows: np.ndarray, k: int) -> DataFrame:
    """queries with least: a score that their k-th neighbour has at least (-infinity where summaries hold fewer than k)."""
    width = members.shape[1]

    def run(batches):
        for batch in batches:
            block, own = unpack(batch.column(3), width), batch.column(0).to_numpy()
            least = np.full(len(block), -np.inf)
            step = max(1, BLOCK_SCORES // max(1, len(members)))
            for a in range(0, len(block) if len(members) > k else 0, step):
                scores = products(block[a : a + step], members).astype(float)
                scores[own[a : a + step, None] == rows[None, :]] = -np.inf
                least[a : a + step] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"])

    return queries.mapInArrow(run, _PACKED + ", least double")


def grouping(counts: dict, pivots: np.ndarray) -> tuple[list, dict]:
    """Groups as lists of query cells, and for each cell its first group and number of parts. Neighbours come together."""
    left, groups, place, held = dict(counts), [], {}, 0
    near = min(left, default=None)
    while left:
        here = min(left, key=lambda c: (float(((pivots[c] - pivots[near]) ** 2).sum()), c))
        n, near = left.pop(here), here
        parts = -(-n // GROUP_QUERIES)
        if parts > 1:
            place[here] = (len(groups), parts)
            groups += [[here]] * parts
            held = GROUP_QUERIES  # the next cell begins a group
            continue
        if not groups or held + n > GROUP_QUERIES:
            groups.append([])
            held = 0
        groups[-1].append(here)
        held += n
        place[here] = (len(groups) - 1, 1)
    return groups, place


def dealt(row: np.ndarray, parts) -> np.ndarray:
    """A part of parts for each row number."""
    mixed = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.asarray(parts, np.uint64)).astype(np.int32)


def solve(queries: np.ndarray, least: np.ndarray, own: np.ndarray, data: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, position, score) of each query's best k of data, which are in the order that breaks ties."""
    n = len(queries)
    held_q, held_p, held_s = (np.zeros(0, np.int64) for _ in range(3))
    floor, full = least.copy(), np.zeros(n, bool)
    step = max(1, BLOCK_SCORES // max(1, n))
    for a in range(0, len(data), step):
        scores = products(queries, data[a : a + step])
        # once a query has k, a later equal score loses its tie
        keep = np.where(full[:, None], scores > floor[:, None], scores >= floor[:, None] - SLACK * np.abs(floor[:, None], where=np.isfinite(floor[:, None]), out=np.zeros((n, 1))))
        keep &= own[:, None] != rows[None, a : a + step]
        q, p = np.nonzero(keep)
        if not len(q):
            continue
        q, p, s = np.concatenate([held_q, q]), np.concatenate([held_p, p + a]), np.concatenate([held_s, scores[q, p].astype(np.int64)])
        order = np.lexsort((p, -s, q))
        q, p, s = q[order], p[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, p, s, rank = (x[rank < k] for x in (q, p, s, rank))
        floor[q[rank == k - 1]], full[q[rank == k - 1]] = s[rank == k - 1], True
        held_q, held_p, held_s = q, p, s
    return held_q, held_p, held_s


def knn_join(vectors: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors(row, vec_id, query, v) as prepared gives them, written once."""
    spark = vectors.sparkSession
    many, width = vectors.where("query").agg(F.count("*"), F.max(F.size("v"))).first()
    result = "query_row long, query_id long, vec_id long, row long, score long"
    if not many:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    pivots = draw_pivots(vectors, min(MOST_PIVOTS, PIVOTS_A_GROUP * -(-many // GROUP_QUERIES)), width)
    placed = materialise(in_cells(vectors, pivots), "voronoi-cells")

    nearest = placed.select("row", "v", "cell", F.row_number().over(Window.partitionBy("cell").orderBy("away", "row")).alias("n")).where(F.col("n") <= k + 1).toArrow()
    members, rows = unpack(nearest.column("v"), width), nearest.column("row").to_numpy()
    of_data = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    queries = materialise(with_bounds(placed.where("query"), members, rows, k), "voronoi-queries")
    of_queries = {r["cell"]: r for r in queries.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("length").alias("length"), F.min("least").alias("least")).collect()}

    cells = sorted(of_queries)
    groups, place = grouping({c: of_queries[c]["n"] for c in cells}, pivots)
    centre, reach, longest, least = pivots[cells], *(np.array([of_queries[c][x] for c in cells]) for x in ("away", "length", "least"))
    size = np.linalg.norm(pivots, axis=1)
    farthest = np.array([of_data[c]["away"] if c in of_data else 0.0 for c in range(len(pivots))])
    most = pivots @ centre.T + size[:, None] * reach + farthest[:, None] * longest  # [cell of data, cell of queries]
    slack = SLACK * (1 + (size[:, None] + farthest[:, None]) * (np.linalg.norm(centre, axis=1) + reach))
    meets = most + slack >= least
    belongs = np.zeros((len(cells), len(groups)), bool)
    for g, some in enumerate(groups):
        belongs[[cells.index(c) for c in some], g] = True
    full = np.array([of_data[c]["n"] if c in of_data else 0 for c in range(len(pivots))])
    sent = full @ ((meets.astype(int) @ belongs) > 0)
    slices = np.maximum(1, -(-sent // SLICE_ROWS))

    def to_groups(batches):
        scale = np.linalg.norm(centre, axis=1) + reach
        for batch in batches:
            block, row = unpack(batch.column(2), width), batch.column(0).to_numpy()
            cell, length = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            step = max(1, SENT_ROWS // len(groups))
            for a in range(0, len(block), step):
                part = slice(a, a + step)
                bound = block[part] @ centre.T + length[part, None] * reach
                needed = (bound + SLACK * (1 + length[part, None] * scale) >= least) & meets[cell[part]]
                at, g = np.nonzero(needed.astype(np.float32) @ belongs.astype(np.float32))
                if len(at):
                    chosen = pa.array(at + a)
                    yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(dealt(row[at + a], slices[g])), *(batch.column(i).take(chosen) for i in (0, 1, 2))], names=["group", "slice", "row", "vec_id", "v"])

    def queries_to_slices(batches):
        for batch in batches:
            row, cell = batch.column(0).to_numpy(), batch.column(3).to_pylist()
            first, parts = (np.array([place[c][i] for c in cell], np.int64) for i in (0, 1))
            group = first + dealt(row, parts)
            for a in range(len(row)):  # a query's copies, one for each slice, are sent in pieces
                n = int(slices[group[a]])
                for b in range(0, n, SENT_ROWS):
                    m = min(SENT_ROWS, n - b)
                    chosen = pa.array(np.full(m, a))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, group[a], np.int32)), pa.array(np.arange(b, b + m, dtype=np.int32)), *(batch.column(i).take(chosen) for i in (0, 1, 2, 4))], names=["group", "slice", "row", "vec_id", "v", "least"])

    def local(asked, data):
        if not asked.num_rows or not data.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "vec_id", "row", "score")})
        data = data.take(pc.sort_indices(data, sort_keys=[("vec_id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        own, rows = asked.column("row").to_numpy(), data.column("row").to_numpy()
        q, p, s = solve(unpack(asked.column("v"), width), asked.column("least").to_numpy(), own, unpack(data.column("v"), width), rows, k)
        return pa.table({"query_row": own[q], "query_id": asked.column("vec_id").take(pa.array(q)), "vec_id": data.column("vec_id").take(pa.array(p)), "row": rows[p], "score": s})

    sent_data = placed.select("row", "vec_id", "v", "cell", "length").mapInArrow(to_groups, "group int, slice int, row long, vec_id long, v binary")
    sent_queries = queries.select("row", "vec_id", "v", "cell", "least").mapInArrow(queries_to_slices, "group int, slice int, row long, vec_id long, v binary, least double")
    found = sent_queries.groupBy("group", "slice").cogroup(sent_data.groupBy("group", "slice")).applyInArrow(local, result)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op13_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other rows for every row whose id is divisible by QUERY_EVERY."""
    return knn_join(materialise(prepared(table(spark, sf_dir, "embeddings")), "voronoi-vectors"))


ORACLE_SQL = f"""
with k as materialized (
  select row_number() over () row, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)
select query_id, cast(rank as integer) rank, vec_id, score from (
  select q.vec_id query_id, d.vec_id, score, row_number() over (partition by q.row order by score desc, d.vec_id nulls last, d.row) rank
  from (select * from k where vec_id % {QUERY_EVERY} = 0) q join k d on d.row <> q.row
  cross join lateral (select cast(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0) as bigint) score)
) where rank <= {TOP}
"""

QUERIES = {"op13_voronoi_topk": op13_voronoi_topk}
ORACLES = {"op13_voronoi_topk": ORACLE_SQL}
