"""SimHash near-duplicates: fingerprints of word shingles, bit-sliced comparison, components.

Fingerprints. A-Z are lower-cased, words joined by one space, every run of SHINGLE words (the whole
sequence if there are fewer) is hashed with XXH64, seed 42; a bit is 1 if it is set in over half of
the hashes. No words: fingerprint zero.

Links join fingerprints that differ in RADIUS bits or fewer. Copies share a fingerprint and are
grouped first, so comparison sees each fingerprint once. With the 64 bits cut into BLOCKS blocks,
two linked fingerprints agree in at least BLOCKS - RADIUS of them; each fingerprint is dealt to one
bucket for every such choice of blocks. The number of blocks follows from the number of
fingerprints, so that buckets stay near TILE members; every choice finds the same links.

A bucket of more than TILE fingerprints is cut into tiles, and each pair of tiles is a group of its
own, so no task holds a hot bucket. In a group the bit planes lie vertically: bit k of 64
fingerprints in one word. Carry-save counters sum 64 distances at once, plane by plane, and a word
is abandoned once all of its distances exceed the radius. A group
returns a spanning forest of its links, at most as many as its members, never all pairs.

Components come from rounds of hooking to the smallest neighbour and pointer jumping over tables in
the shared folder, until no more than LOCAL_EDGES edges are left, which one task unites; nothing is
collected to the driver but counts.

Defined cases: a null text has no words; a null id takes part in its group but never names it (a
group of null ids only has a null component). Repeated rows stay, each with its component.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import materialise, table, utf8

SHINGLE, RADIUS, TILE = 4, 4, 2048
#: Fingerprints of a group that are compared with all of it at once.
QUERY_ROWS = 256
SEED = 42
#: Edges between components that are united in one task; more are contracted first.
LOCAL_EDGES = 1 << 19
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of a text's words, repeats included."""
    found = text.translate(_LOWER).split()  # bytes.split() cuts at the six ASCII white-space bytes
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    stop = np.cumsum(sizes) - 1
    start = (stop - sizes + 1)[: len(found) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, stop[shingle - 1 :].tolist())), np.uint64, len(start))


def fingerprint(hashes: np.ndarray) -> int:
    """Majority bits; np.unpackbits is taken over slices so that long texts need little memory."""
    count = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): each document's fingerprint as a signed 64-bit number."""

    def compute(batches):
        for batch in batches:
            texts = utf8(batch.column(1))
            values = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(compute, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """docs with the column _near_fp added."""
    place = docs.columns.index("text")

    def compute(batches):
        for batch in batches:
            values = np.array([fingerprint(shingle_hashes(t)) for t in utf8(batch.column(place))], np.uint64).view(np.int64)
            yield batch.append_column("_near_fp", pa.array(values, pa.int64()))

    return docs.mapInArrow(compute, T.StructType([*docs.schema.fields, T.StructField("_near_fp", T.LongType())]))


def block_count(fingerprints_: int, radius: int = RADIUS) -> int:
    """The least number of blocks with which equal buckets would hold TILE fingerprints or fewer."""
    blocks = radius + 1
    while blocks < 16 and fingerprints_ > TILE << (64 * (blocks - radius) // blocks):
        blocks += 1
    return blocks


def bucket_masks(blocks: int, radius: int = RADIUS) -> list:
    """A mask of the bits that must agree, for each choice of blocks - radius blocks, as signed numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(one[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    assert len(masks) == comb(blocks, radius)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes [64, words] of fingerprints: bit j of plane k's word w is bit k of fingerprint 64 w + j."""
    padded = np.concatenate([values, np.full(-len(values) % 64, values[-1])])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within_radius(queries: np.ndarray, sliced: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, position) of queries and a sliced block that differ in radius bits or fewer (padding included).

    Each (query, word) is a lane of 64 distances. Lanes in which all distances exceed the radius are
    abandoned after every eight planes.
    """
    width, ones = radius.bit_length(), np.uint64(0xFFFFFFFFFFFFFFFF)
    query, word = (x.ravel() for x in np.indices((len(queries), sliced.shape[1])))
    counters = [np.zeros(len(query), np.uint64) for _ in range(width)]
    over = np.zeros(len(query), np.uint64)
    for first in range(0, 64, 8):
        for k in range(first, first + 8):
            flip = np.where(queries >> np.uint64(k) & np.uint64(1), ones, np.uint64(0))
            carry = sliced[k][word] ^ flip[query]
            for c in range(width):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
        # compare the counters with the radius, bit by bit from the top; what is over stays over
        equal = ~over
        for c in range(width - 1, -1, -1):
            if radius >> c & 1:
                equal &= counters[c]
            else:
                over |= equal & counters[c]
                equal &= ~counters[c]
        open_ = np.flatnonzero(over != ones)
        if len(open_) < len(over):
            query, word, over = query[open_], word[open_], over[open_]
            counters = [c[open_] for c in counters]
        if not len(over):
            break
    lane, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return query[lane], word[lane] * 64 + bit


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> list:
    """Links that span the components of left (with right: of their union, by links between the two)."""
    other = left if right is None else right
    sliced = planes(other.view(np.uint64))
    parent = list(range(len(left) + (0 if right is None else len(right))))
    shift = 0 if right is None else len(left)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for start in range(0, len(left), QUERY_ROWS):
        begin = start // 64 if right is None else 0
        found, place = within_radius(left[start : start + QUERY_ROWS].view(np.uint64), sliced[:, begin:], radius)
        found, place = found + start, place + 64 * begin
        real = place < len(other) if right is not None else (place < len(other)) & (place > found)
        for i, j in zip(found[real].tolist(), place[real].tolist()):
            a, b = root(i), root(j + shift)
            if a != b:
                parent[b] = a
                links.append((i, j))
    return links


def compare_groups(fps: DataFrame, blocks: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that span all components of the table of distinct fingerprints fps(fp)."""
    masks = F.array(*map(F.lit, bucket_masks(blocks, radius)))
    dealt = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    large = materialise(dealt.groupBy("choice", "bits").count().where(f"count > {TILE}").select("choice", "bits", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "simhash-large")
    tiled = dealt.join(large, ["choice", "bits"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    # tile t meets every tile u: the pair (t, u) is one group, whose name has the smaller first
    pair = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("u")
    placed = tiled.select("fp", "choice", "bits", "tile", pair).select("fp", "choice", "bits", F.least("tile", "u").alias("t"), F.greatest("tile", "u").alias("u"), (F.col("tile") > F.col("u")).alias("second"))

    def compare(keys, group):
        values, second = group.column("fp").to_numpy(), np.asarray(group.column("second"))
        if keys[2].as_py() == keys[3].as_py():
            left, right = np.sort(values), None
        else:
            left, right = np.sort(values[~second]), np.sort(values[second])
        links = forest(left, right, radius) if len(left) and (right is None or len(right)) else []
        other = left if right is None else right
        return pa.table({"a": pa.array([left[i] for i, _ in links], pa.int64()), "b": pa.array([other[j] for _, j in links], pa.int64())})

    return placed.groupBy("choice", "bits", "t", "u").applyInArrow(compare, "a long, b long")


def united(edges: DataFrame) -> DataFrame:
    """(node, up) of at most LOCAL_EDGES edges (a, b), in one task: the least node of the component of every node but that one."""

    def run(batches):
        parent: dict = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
        found = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["node", "up"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, up long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the least node of its component.

    Rounds of hooking and jumping contract the graph, whatever its size, until at most LOCAL_EDGES
    edges are left between components; those are united in one task.
    """
    edges = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    named = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    left = edges.count()
    if left > LOCAL_EDGES:
        named = materialise(named, "nodes")
    while left > LOCAL_EDGES:
        # every root hooks to its least neighbour, if that is less; chains are then jumped to their end
        least = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        up = materialise(least, "hooks")
        while True:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("further"))
            jumped = materialise(up.join(over, "up", "left").select("node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "hooks")
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        to = up.select(F.col("node").alias("root"), F.col("up"))
        named = materialise(named.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "nodes")
        a = edges.join(up.select(F.col("node").alias("a"), F.col("up").alias("up_a")), "a", "left")
        b = a.join(up.select(F.col("node").alias("b"), F.col("up").alias("up_b")), "b", "left").select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"))
        edges = materialise(b.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        left = edges.count()
    if left:
        to = united(edges).withColumnRenamed("node", "root")
        named = named.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return materialise(named, "nodes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row of docs(doc_id, text): root is a component's least fingerprint."""
    prints = materialise(fingerprints(docs, shingle), "fingerprints")
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    named = components(compare_groups(groups.select("fp"), block_count(groups.count(), radius), radius))
    rooted = materialise(groups.join(named.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    owned = materialise(rooted.join(materialise(least, "components"), "root").select("fp", "root", "component_id"), "owned")
    return prints.join(owned, "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, with_key) -> DataFrame:
    """docs with one row of each component of found(doc_id, fp, root): one with its least id, or one without id where no row has any.

    with_key adds a row's fp as _near_fp. An id of one row says which row it is; rows of a repeated
    or null id are told apart by fp, and of those with equal ids and fp one stays.
    """
    found = materialise(found, "near-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fp")).alias("first")
    keep = materialise(found.groupBy("root").agg(first).select(F.col("first.doc_id").alias("_near_id"), F.col("first.fp").alias("_near_kept")), "near-kept")
    repeated = found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_near_id"))
    repeated = materialise(repeated, "near-repeated")
    own = F.col("doc_id").cast("long")
    once = keep.where("_near_id is not null").join(repeated, "_near_id", "left_anti")
    single = docs.join(once, own == F.col("_near_id"), "left_semi")
    many = with_key(docs.join(repeated, own.eqNullSafe(F.col("_near_id")), "left_semi"))
    many = many.join(keep, own.eqNullSafe(F.col("_near_id")) & (F.col("_near_fp") == F.col("_near_kept")), "left_semi")
    return single.unionByName(many.dropDuplicates(["doc_id", "_near_fp"]).select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, by keep_one."""
    return keep_one(docs, near_duplicates(docs, radius).select("doc_id", "fp", "root"), with_fingerprint)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_components": op6_simhash_components}
