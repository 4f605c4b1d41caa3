"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern, the set of sources that hold them (one source each
is the simplest case). The flow network has a node per pattern and per source: a pattern offers its
words once at no cost and each repetition at one unit more than the last (convex), its words may go
to any of its sources, and each source takes up to its quota. Only pattern totals reach the driver;
more than MAX_PATTERNS patterns raise an error.

The flow out of a pattern is then drawn from its documents in seeded hash order: whole repetitions
of all of them, and for the rest each document in turn that still fits in. Of a rest over half of
the words those left out are drawn instead, so that there are always enough documents to fill a
gap. A histogram over hash buckets finds the first bucket that doesn't fit as a whole, and only that bucket is gone through in
order; what then is left is filled in the same way from all later documents that are small enough,
until the gap is closed or smaller than each of them. No task sees a whole source.

Defined cases: a null text has size 0 and is never needed; null sources form one source, last in
order; without words all targets are 0. A row's place in the order comes from its id, sources and
text, so rows with one id (or none) are drawn one by one; rows equal in all three are alike, and
each has a place of its own by its position in the input. Other columns stay as they are.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD_SPACE, materialise, table

WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
MAX_PATTERNS = 100_000
BUCKET_ROWS = 4096
SEED = 20


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WORD_SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict:
    """Words wanted of each source: share of all by weight, none above most times its size, excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, result = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            return result | {s: left * weight[s] / total for s in open_}
        result |= {s: float(most * sizes[s]) for s in over}
        left -= sum(result[s] for s in over)
        open_ = [s for s in open_ if s not in result]
    return result


def min_cost_flow(patterns: dict, quotas: dict, copies: int = MOST_COPIES) -> dict:
    """Words from each pattern (a tuple of sources, with its size) to each source: {(pattern, source): words}.

    Successive shortest paths: the cheapest open repetition is filled as far as re-routing between
    sources allows before the next one opens, which is optimal for costs on the pattern side.
    """
    flow: dict = defaultdict(int)
    used, got = defaultdict(int), defaultdict(int)
    members = defaultdict(list)
    for p in patterns:
        for s in p:
            members[s].append(p)
    for copy in range(1, copies + 1):
        for p in patterns:
            while used[p] < copy * patterns[p]:
                # breadth first from p: pattern to source is open, source to pattern where words already flow
                came, queue, end = {("p", p): None}, deque([("p", p)]), None
                while queue and end is None:
                    kind, at = queue.popleft()
                    for b in at if kind == "p" else members[at]:
                        nxt = ("s" if kind == "p" else "p", b)
                        if nxt in came or kind == "s" and not flow[b, at]:
                            continue
                        came[nxt] = (kind, at)
                        if kind == "p" and got[b] < quotas[b]:
                            end = nxt
                            break
                        queue.append(nxt)
                if end is None:
                    break
                path, at = [], end
                while came[at] is not None:
                    path.append((came[at], at))
                    at = came[at]
                amount = min([copy * patterns[p] - used[p], quotas[end[1]] - got[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "s")])
                for a, b in path:
                    if a[0] == "p":
                        flow[a[1], b[1]] += amount
                    else:
                        flow[b[1], a[1]] -= amount
                used[p] += amount
                got[end[1]] += amount
    return {k: v for k, v in flow.items() if v}


def members(sources: Column) -> Column:
    """The sources of a document in one order, each once."""
    return F.sort_array(F.array_distinct(sources))


def row_key(doc_id: Column, sources: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("long"), F.to_json(members(sources)), text)


def draw(key: Column, seed: int, row: Column | None = None) -> Column:
    """A row's place in the seeded order, below 2**40; row tells equal keys apart."""
    return F.pmod(F.xxhash64(key, F.lit(seed)) if row is None else F.xxhash64(key, F.lit(seed), row), F.lit(1 << 40))


def bucket(place: Column, buckets: Column) -> Column:
    return F.floor(place * buckets / float(1 << 40))


def mix(docs: DataFrame, sources: Column, seed: int = SEED) -> tuple[DataFrame, dict, dict, dict]:
    """Rows (row, doc_id, pattern, size, copies) of all docs, with sizes, targets and flow.

    sources: an array column, the sources that hold the document; docs has doc_id and text.
    """
    decided, _, *facts = decide(docs, sources, seed)
    return decided.drop("special", "key"), *facts


def decide(docs: DataFrame, sources: Column, seed: int) -> tuple[DataFrame, DataFrame, dict, dict, dict]:
    """mix's rows with key and special (the rule doesn't decide: a repeated key, or taken although the
    bucket isn't before the cut), the rule for all others as a row for each pattern (whole, rest,
    buckets, left_out, cut), and sizes, targets and flow."""
    spark = docs.sparkSession
    sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), members(sources).alias("held"), size_in_words(F.col("text")).alias("size"), row_key(F.col("doc_id"), sources, F.col("text")).alias("key"))
    sized = materialise(sized.withColumn("pattern", F.to_json("held")), "sized")
    alike = materialise(sized.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("alike")), "alike")
    sized = sized.join(alike, "key", "left").withColumn("alike", F.coalesce("alike", F.lit(False)))
    sized = sized.withColumn("draw", F.when(F.col("alike"), draw(F.col("key"), seed, F.col("row"))).otherwise(draw(F.col("key"), seed)))
    totals = sized.groupBy("pattern").agg(F.first("held").alias("held"), F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    sizes: dict = defaultdict(int)
    for r in totals:
        for s in r["held"]:
            sizes[s] += r["size"]
    wanted = targets(dict(sizes))
    order = sorted(totals, key=lambda r: r["pattern"])
    flow = min_cost_flow({tuple(r["held"]): r["size"] for r in order}, {s: int(t) for s, t in wanted.items()})
    out: dict = defaultdict(int)
    for (p, _), words in flow.items():
        out[p] += words
    plan = []
    for r in order:
        whole, rest = divmod(out[tuple(r["held"])], max(1, r["size"]))
        left_out = 2 * rest > r["size"]
        plan.append((r["pattern"], whole, r["size"] - rest if left_out else rest, -(-r["n"] // BUCKET_ROWS), left_out))
    plan = F.broadcast(spark.createDataFrame(plan, "pattern string, whole long, rest long, buckets long, left_out boolean"))  # at most MAX_PATTERNS rows
    drawn = sized.drop("held").join(plan, "pattern").withColumn("bucket", bucket(F.col("draw"), F.col("buckets")))
    named, cut = draw_rest(drawn.where("rest > 0"), {r["pattern"]: r["rest"] for r in plan.where("rest > 0").collect()})
    drawn = drawn.join(F.broadcast(cut), "pattern", "left").join(named.select("row", F.lit(True).alias("special")), "row", "left")  # cut: a row for each pattern at most
    before, special = F.coalesce((F.col("rest") > 0) & (F.col("bucket") < F.col("cut")), F.lit(False)), F.coalesce("special", F.lit(False))
    decided = drawn.select("row", "key", "doc_id", "pattern", "size", (F.col("whole") + ((before | special) != F.col("left_out")).cast("long")).alias("copies"), (special | F.col("alike")).alias("special"))
    return decided, plan.join(cut, "pattern", "left"), dict(sizes), wanted, flow


def fitting(group: pa.Table) -> pa.Table:
    """The rows of a bucket that fit into what is left of the gap, in the seeded order."""
    column = lambda c: group.column(c).fill_null(0).to_numpy()
    size, left, taken = column("size").tolist(), group.column("room")[0].as_py(), []
    for i in np.lexsort([column(c) for c in ("row", "size", "doc_id", "draw")]).tolist():
        if size[i] <= left:
            left -= size[i]
            taken.append(i)
    return group.select(["pattern", "row", "size"]).take(pa.array(taken, pa.int64()))


def draw_rest(rows: DataFrame, rest: dict) -> tuple[DataFrame, DataFrame]:
    """What is taken for the rest of each pattern: every row of a bucket below cut(pattern, cut), and the rows named(row).

    rows: row, doc_id, pattern, size, draw and bucket. A round takes the buckets up to the first
    that is too large and what fits of that one; later rounds see later buckets and sizes up to the
    gap only, so that all rounds do what one pass in the seeded order would.
    """
    spark = rows.sparkSession
    gaps, named, first = [(p, gap, -1) for p, gap in rest.items()], [], None
    while gaps or first is None:
        known = F.broadcast(spark.createDataFrame(gaps, "pattern string, gap long, last long"))  # at most MAX_PATTERNS rows
        fits = rows.join(known, "pattern").where("bucket > last and size > 0 and (last < 0 or size <= gap)")
        by_bucket = fits.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"), F.first("gap").alias("gap"))
        running = F.sum("size").over(W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        over = by_bucket.withColumn("upto", running).where("upto > gap").groupBy("pattern")
        cut = over.agg(F.min_by(F.struct("bucket", (F.col("gap") - F.col("upto") + F.col("size")).alias("room")), "bucket").alias("cut"))
        cut = materialise(cut.select("pattern", F.col("cut.bucket").alias("cut"), F.col("cut.room").alias("room")), "cut")
        placed = fits.join(F.broadcast(cut), "pattern", "left").select("pattern", "row", "doc_id", "size", "draw", "bucket", "cut", "room")
        chosen = placed.where("bucket = cut").groupBy("pattern").applyInArrow(fitting, "pattern string, row long, size long")
        if first is not None:
            chosen = chosen.unionByName(placed.where("cut is null or bucket < cut").select("pattern", "row", "size"))
        chosen = materialise(chosen, "chosen")
        named.append(chosen.select("row"))
        used = {r["pattern"]: r["size"] for r in chosen.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
        ends = {r["pattern"]: (r["cut"], r["room"]) for r in cut.collect()}
        if first is None:
            first = cut.select("pattern", "cut")
            gaps = [(p, room, -1) for p, (_, room) in ends.items()]
        gaps = [(p, gap - used.get(p, 0), ends[p][0]) for p, gap, _ in gaps if p in ends and gap > used.get(p, 0)]
    for more in named[1:]:
        named[0] = named[0].union(more)
    return named[0], first


def repeat_to_weights(docs: DataFrame, sources: Column, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it.

    Texts stay where they are: the place of a row in the seeded order against its pattern's cut
    decides it. Only rows taken from the cut's bucket and after it, and those with equal keys, are
    named, by their position, in a table that Spark broadcasts if its size allows. So docs must give
    the same rows in the same order each time it is read, as files do; a named row that isn't where
    it was raises an error. Columns of docs must not begin with _mix_.
    """
    decided, rule, *_ = decide(docs, sources, seed)
    special = decided.where("special").select(F.col("row").alias("_mix_row"), F.col("key").alias("_mix_named"), F.col("copies").alias("_mix_own"))
    special = materialise(special, "special")
    rule = F.broadcast(rule.select(*[F.col(c).alias(f"_mix_{c}") for c in ("pattern", "whole", "rest", "buckets", "left_out", "cut")]))  # at most MAX_PATTERNS rows
    placed = docs.withColumns({"_mix_row": F.monotonically_increasing_id(), "_mix_key": row_key(F.col("doc_id"), sources, F.col("text")), "_mix_pattern": F.to_json(members(sources))})
    joined = placed.join(rule, "_mix_pattern").join(special, "_mix_row", "left")
    before = (F.col("_mix_rest") > 0) & (bucket(draw(F.col("_mix_key"), seed), F.col("_mix_buckets")) < F.col("_mix_cut"))
    ruled = F.col("_mix_whole") + (F.coalesce(before, F.lit(False)) != F.col("_mix_left_out")).cast("long")
    moved = F.raise_error(F.lit("the input gave other rows when it was read again")).cast("long")
    copies = F.when(F.col("_mix_named").isNull(), ruled).when(F.col("_mix_named") == F.col("_mix_key"), F.col("_mix_own")).otherwise(moved)
    taken = joined.withColumn("_mix_copies", copies).where("_mix_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*docs.columns)


def op4_mixing_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    taken, sizes, wanted, _ = mix(table(spark, sf_dir, "documents"), F.array("source"))
    facts = spark.createDataFrame([(s, sizes[s], float(wanted[s])) for s in sizes] or [], "source string, source_size long, target double")
    facts = F.broadcast(facts.select(F.to_json(F.array("source")).alias("pattern"), "source_size", "target"))  # at most MAX_PATTERNS rows
    return taken.join(facts, "pattern").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op4_mixing_flow": op4_mixing_flow}
