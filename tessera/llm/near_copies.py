"""Near copies for the pipeline: SimHash comparison at a wide radius, then Jaccard similarity LEAST or more.

This is the operator of simhash.py for five-word shingles and a similarity instead of a radius. Each
text has the set of its shingles (simhash.shingle_hashes), a SimHash fingerprint of that set, and a
64-bit hash of it; texts with equal sets are one node. Who meets whom: choices of equal fingerprint
blocks, which op6 uses at radius 4, can't reach 0.8 (such pairs differ in ten bits on average, and
blocks of one or two bits are no buckets), so BANDS bands of ROWS min-hashes deal each node to
buckets; two nodes of similarity s meet with probability 1 - (1 - s**ROWS)**BANDS, 0.999997 at s = 0.8.

All who meet are compared bit-sliced (simhash.within_radius) at WIDE bits. A pair of similarity 0.8
differs in more bits with a probability of 2e-7 (1e-5 for sets of five shingles), an unrelated one
in fewer with 0.08. What is left is compared by whole sets, so nothing under LEAST is ever linked.

Comparison is in two passes. First every member of a bucket is compared with its least node. Then
the buckets whose other members are still in several components compare all of those. A group is
cut into tiles of TILE_WORDS shingles and TILE_ROWS nodes, and each pair of tiles is a group of its
own, so no task holds a hot bucket. Groups return links that span components, never all pairs.

Defined cases: texts without words are copies of each other and near nothing else; null ids are like
other ids, but name a component only if it has no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, text_slices, utf8
from tessera.llm.simhash import components, fingerprint, keep_one, planes, shingle_hashes, within_radius

SHINGLE, LEAST, WIDE = 5, 0.8, 26
#: Nodes of a group that are compared with all of it at once.
QUERY_ROWS = 64
BANDS, ROWS = 24, 4
TILE_WORDS, TILE_ROWS = 1 << 18, 1024
_RANDOM = np.random.default_rng(5)
_FLIP, _TIMES = _RANDOM.integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_TIMES |= np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def set_key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 42)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band; slices keep the memory for long texts small."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(found), 4096):
        least = np.minimum(least, ((found[a : a + 4096] ^ _FLIP) * _TIMES).min(axis=1))
    key = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, size, bands) of docs: the set's hash, its size and its band keys (none if it is empty)."""

    def compute(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            for start, stop in text_slices(texts):
                sets = [shingle_set(t) for t in texts[start:stop]]
                keys = pa.array(np.array([set_key(s) for s in sets], np.uint64).view(np.int64))
                bands = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                columns = [batch.column(0).slice(start, stop - start), keys, pa.array([len(s) for s in sets], pa.int64()), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "size", "bands"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(compute, "doc_id long, fp long, size long, bands array<long>")


def sets_of(docs: DataFrame) -> DataFrame:
    """(fp, sim, shingles) of docs: the set's hash, its SimHash fingerprint and its bytes."""

    def compute(batches):
        for batch in batches:
            texts = utf8(batch.column(0))
            for start, stop in text_slices(texts):
                sets = [shingle_set(t) for t in texts[start:stop]]
                numbers = [pa.array(np.array([f(s) for s in sets], np.uint64).view(np.int64)) for f in (set_key, fingerprint)]
                yield pa.RecordBatch.from_arrays([*numbers, pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "sim", "shingles"])

    return docs.select("text").mapInArrow(compute, "fp long, sim long, shingles binary")


def with_set_key(docs: DataFrame) -> DataFrame:
    """docs with the column _near_fp added."""
    place = docs.columns.index("text")

    def compute(batches):
        for batch in batches:
            keys = np.array([set_key(shingle_set(t)) for t in utf8(batch.column(place))], np.uint64).view(np.int64)
            yield batch.append_column("_near_fp", pa.array(keys, pa.int64()))

    return docs.mapInArrow(compute, docs.withColumn("_near_fp", F.lit(0).cast("long")).schema)


def links_between(sets: list, sims: np.ndarray, second: np.ndarray | None, root: list) -> list:
    """Pairs of positions (i, j) that are similar and span components: all pairs, or those of first and second.

    sims: fingerprints. root: the component that each is known to be in.
    """
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(int(code.max(initial=0)) + 1, bool)
    name = {r: k for k, r in enumerate(dict.fromkeys(root))}
    group = np.array([name[r] for r in root])
    rows = np.arange(len(sets)) if second is None else np.flatnonzero(~second)
    others = rows if second is None else np.flatnonzero(second)
    sliced, links = planes(sims[others].view(np.uint64)), []
    for start in range(0, len(rows), QUERY_ROWS):
        query, place = within_radius(sims[rows[start : start + QUERY_ROWS]].view(np.uint64), sliced, WIDE)
        real = place < len(others)
        i, j = rows[start + query[real]], others[place[real]]
        # J >= 4/5 in whole numbers: 5 common >= 4 union; so much as that can be common
        fits = (group[i] != group[j]) & (9 * np.minimum(size[i], size[j]) >= 4 * (size[i] + size[j]))
        i, j = i[fits], j[fits]
        for k in np.unique(i).tolist():
            near = j[i == k]
            near = near[group[near] != group[k]]
            if not len(near):
                continue
            own = code[first[k] : first[k] + size[k]]
            mine[own] = True
            n = size[near]
            begin = np.cumsum(n) - n
            common = np.add.reduceat(mine[code[np.repeat(first[near] - begin, n) + np.arange(n.sum())]].astype(np.int64), begin)
            mine[own] = False
            for m in near[9 * common >= 4 * (n + size[k])].tolist():
                if group[m] != group[k]:
                    group[group == group[m]] = group[k]
                    links.append((k, m))
    return links


def compared(placed: DataFrame, names: list, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the groups of placed(*names, fp, root, role): role 0 and 1 meet each other, a group of role 2 only meets itself."""
    rows = placed.join(sets, "fp")

    def compare(_, group):
        role = group.column("role").to_numpy()
        alone = bool((role == 2).all())
        if len(role) < 2 or not alone and (role == role[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        fp = group.column("fp").to_numpy()
        order = np.argsort(fp, kind="stable")
        shingles = group.column("shingles").to_pylist()
        root, sims = group.column("root").to_numpy()[order].tolist(), group.column("sim").to_numpy()[order]
        found = links_between([np.frombuffer(shingles[k], np.uint64) for k in order.tolist()], sims, None if alone else role[order] == 1, root)
        fp = fp[order]
        return pa.table({"a": pa.array([fp[i] for i, _ in found], pa.int64()), "b": pa.array([fp[j] for _, j in found], pa.int64())})

    return rows.groupBy(*names).applyInArrow(compare, "a long, b long")


def tiles(words: Column, rows: Column) -> Column:
    return F.greatest(F.ceil(words / TILE_WORDS), F.ceil(rows / TILE_ROWS), F.lit(1)).cast("int")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, root) for each row of docs(doc_id, text): root is the least set hash of its component."""
    prints = materialise(described(docs), "near-prints")
    nodes = materialise(prints.where("size > 0").groupBy("fp").agg(F.first("size").alias("size"), F.first("bands").alias("bands")), "near-nodes")
    dealt = nodes.select("fp", "size", F.posexplode("bands").alias("band", "key"))
    buckets = dealt.groupBy("band", "key").agg(F.min(F.struct("fp", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    buckets = buckets.select("band", "key", F.col("lead.fp").alias("lead"), F.col("lead.size").alias("lead_size"))
    met = materialise(dealt.join(buckets, ["band", "key"]).where("fp <> lead"), "near-met")
    # one set of each node, copies collapsed before the join, so that no node is a hot key
    each = sets_of(docs).groupBy("fp").agg(F.first("sim").alias("sim"), F.first("shingles").alias("shingles"))
    sets = materialise(each.join(met.select("fp").union(met.select("lead")).distinct(), "fp", "left_semi"), "near-sets")
    # sizes further apart than LEAST can't reach it
    fits = F.least("size", "lead_size") >= F.floor(LEAST * F.greatest("size", "lead_size"))
    pairs = materialise(met.where(fits).select("lead", "fp", "size").distinct(), "near-pairs")
    cut = materialise(pairs.groupBy("lead").agg(tiles(F.sum("size"), F.count("*")).alias("tiles")), "near-cut")
    seconds = pairs.join(cut, "lead").select("lead", F.pmod(F.xxhash64("fp"), "tiles").cast("int").alias("tile"), "fp", F.lit(1).alias("role"))
    firsts = cut.select("lead", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("lead").alias("fp"), F.lit(0).alias("role"))
    links = materialise(compared(firsts.unionByName(seconds).withColumn("root", F.col("fp")), ["lead", "tile"], sets), "near-links")
    named = materialise(components(links).select(F.col("node").alias("fp"), "root"), "near-named")
    # buckets whose members other than the least are in several components
    rooted = materialise(met.join(named, "fp", "left").withColumn("root", F.coalesce("root", "fp")).select("band", "key", "fp", "size", "root"), "near-rooted")
    split = rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), tiles(F.sum("size"), F.count("*")).alias("tiles")).where("low < high")
    left = rooted.join(materialise(split.select("band", "key", "tiles"), "near-split"), ["band", "key"])
    left = left.withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    role = F.when(F.col("tile") == F.col("u"), 2).when(F.col("tile") > F.col("u"), 1).otherwise(0)
    placed = left.select("band", "key", F.least("tile", "u").alias("t"), F.greatest("tile", "u").alias("o"), "fp", "root", role.alias("role"))
    more = materialise(compared(placed, ["band", "key", "t", "o"], sets), "near-links")
    named = components(links.union(more)).select(F.col("node").alias("fp"), "root")
    return prints.select("doc_id", "fp").join(named, "fp", "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: one with its least id, or one without id where no row has any."""
    return keep_one(docs, near_copies(docs), with_set_key)
