"""Merkle dataset manifest: hashed rows, a tree for each group, a tree over their roots, octopus multiproofs.

Leaves. A row's leaf is the SHA-256 (lower-case hex, as all digests here) of its fields, each "-" if
null, else its UTF-8 byte count, ":" and its value. Leaves of a group ascend by key (nulls first, equal
keys by leaf); groups ascend by name (null first, by bytes). While a level has several nodes, every two
consecutive ones become the hash of their texts side by side, and a last odd one the hash of its own.

Places. Rows are dealt by range of (group, key, leaf), so a group of any size is spread over many tasks;
a row's index is its place in its range plus what earlier ranges hold of its group. That sum runs over
a row for each range and group, never over rows.

Nodes. A round folds FOLD levels: aligned runs of 2^FOLD nodes are hashed where they meet, and only their
tops go on. All levels are kept in one table by (tree, level, idx): the manifest's node store.

Proofs. A leaf partition is a run of at most PART leaves of a range, perhaps of several trees. From the
coordinates alone it finds the least union of nodes that can't be derived from its own leaves: level by
level the siblings of known nodes that aren't known themselves (the octopus), in its trees and in the
tree over them. It fetches these once by a join with the node store, derives the interiors that its
proofs share, and expands each leaf's own list of siblings from them.

Defined cases: null keys come first in their group and null names form a group; equal rows stay, each
with a proof of its own; a row alone in its group is its group's root; an empty table has no rows and no
root; columns besides the ones named are never read, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialise, table

#: Levels hashed in a round, and the most leaves of a leaf partition.
FOLD, PART = 12, 1 << 13
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The number of the tree over all trees' roots.
TOP = -1
_NODES = "tree long, level int, idx long, size long, digest string"


@dataclass
class Manifest:
    """leaves(key, leaf, claimed, tree, idx, size, part), nodes(tree, level, idx, size, digest), the number of trees and the root."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """The leaf digest of a row's values."""
    texts = [v.cast("string") for v in values]
    fields = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of size leaves."""
    return F.when(size <= 1, 0).otherwise(F.length(F.bin(size - 1)))


def _ranges(df: DataFrame, group: Column, order: list, tag: str) -> tuple[DataFrame, DataFrame]:
    """df by ranges of (group, order) with its place _at, and a row for each range and group: _shift turns _at into the index."""
    spread = df.withColumn("_group", group).repartitionByRange(F.col("_group").asc_nulls_first(), *order).sortWithinPartitions(F.col("_group").asc_nulls_first(), *order)
    spread = materialise(spread.withColumn("_at", F.monotonically_increasing_id()), tag)
    pieces = spread.groupBy("_group", F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_first"), F.count("*").alias("_here"))
    by, before = Window.partitionBy("_group"), Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = (F.coalesce(F.sum("_here").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    return spread, pieces.select("_group", "_range", shift, F.sum("_here").over(by).alias("size"))


def fold_levels(leaves: DataFrame, tag: str) -> DataFrame:
    """All levels, the leaves' included, of trees given by leaves(tree, idx, size, digest); size is the tree's number of leaves."""

    def run(key, rows):
        tree, size = rows.column("tree")[0].as_py(), rows.column("size")[0].as_py()
        level, first = rows.column("level")[0].as_py(), key[1].as_py() << FOLD
        order = np.argsort(rows.column("idx").to_numpy())
        nodes, out = [rows.column("digest")[i].as_py() for i in order.tolist()], {"level": [], "idx": [], "digest": []}
        wide = -(-size >> level)  # nodes of the whole tree at this level
        for _ in range(FOLD):
            if wide <= 1:
                break
            nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
            level, first, wide = level + 1, first >> 1, (wide + 1) // 2
            out["level"] += [level] * len(nodes)
            out["idx"] += range(first, first + len(nodes))
            out["digest"] += nodes
        n = len(out["idx"])
        return pa.table({"tree": pa.array([tree] * n, pa.int64()), "level": pa.array(out["level"], pa.int32()), "idx": pa.array(out["idx"], pa.int64()), "size": pa.array([size] * n, pa.int64()), "digest": pa.array(out["digest"], pa.string())})

    leaves = leaves.select("tree", F.lit(0).alias("level"), "idx", "size", "digest")
    most = leaves.agg(F.max("size")).first()[0] or 0
    found, level = leaves, leaves
    for base in range(0, (most - 1).bit_length() if most > 1 else 0, FOLD):
        above = level.where(height(F.col("size")) > base).groupBy("tree", F.shiftright("idx", FOLD).alias("run")).applyInArrow(run, _NODES)
        above = materialise(above, f"{tag}-{base}")
        found, level = found.unionByName(above), above.where(F.col("level") == base + FOLD)
    return found


def build(rows: DataFrame) -> Manifest:
    """The manifest of rows(name, key, leaf, claimed): claimed is the leaf that a proof is checked for."""
    spread, pieces = _ranges(rows.select("name", "key", "leaf", "claimed"), F.col("name"), [F.col("key").asc_nulls_first(), "leaf"], "merkle-leaves")
    pieces = materialise(pieces, "merkle-ranges")
    names, name_pieces = _ranges(pieces.select("_group").distinct().withColumnRenamed("_group", "name"), F.lit(0), [F.col("name").asc_nulls_first()], "merkle-names")
    trees = names.join(name_pieces, F.col("_range") == F.shiftright("_at", 33)).select("name", (F.col("_at") + F.col("_shift")).alias("tree"))
    places = pieces.join(trees, F.col("_group").eqNullSafe(F.col("name"))).select(F.col("_group").alias("_place"), "_range", "_shift", "size", "tree")
    found = spread.join(places, F.col("_place").eqNullSafe(F.col("name")) & (F.col("_range") == F.shiftright("_at", 33)))
    leaves = found.select("key", "leaf", "claimed", "tree", (F.col("_at") + F.col("_shift")).alias("idx"), "size", F.shiftright("_at", (PART - 1).bit_length()).alias("part"))
    leaves = materialise(leaves, "merkle-places")
    nodes = fold_levels(leaves.withColumnRenamed("leaf", "digest"), "merkle-nodes")
    tops = materialise(nodes.where(F.col("level") == height(F.col("size"))).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest"), "merkle-subroots")
    count = tops.count()
    over = fold_levels(tops.withColumn("size", F.lit(count).cast("long")), "merkle-top")
    root = over.where(F.col("level") == height(F.col("size"))).select("digest").first()
    return Manifest(leaves, nodes.unionByName(over), count, root and root[0])


def missing(known: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """(level, indices) of the nodes that, with the known leaves of a tree of size leaves, give its root: no fewer do."""
    found, level = [], 0
    known = np.unique(known)
    while size > 1:
        wanted = np.setdiff1d(known ^ 1, known)
        found.append((level, wanted[wanted < size]))
        known, size, level = np.unique(known >> 1), (size + 1) // 2, level + 1
    return found


def interiors(leaves: dict, size: int, fetched: dict) -> list[dict]:
    """For each level a map from index to digest: what was fetched and what follows from it and the leaves."""
    levels, known, level = [], dict(leaves), 0
    while True:
        here = known | fetched.get(level, {})
        levels.append(here)
        if size <= 1:
            return levels
        known = {i: digest(here[2 * i] + here.get(2 * i + 1, "")) for i in {j >> 1 for j in known}}
        size, level = (size + 1) // 2, level + 1


def siblings(levels: list[dict], idx: int) -> list[str]:
    """A leaf's proof within one tree; a node without a neighbour adds nothing."""
    return [h for level, here in enumerate(levels[:-1]) if (h := here.get((idx >> level) ^ 1)) is not None]


def fold_up(found: str, idx: int, levels: list[dict]) -> str:
    """The root that follows from a digest at idx and its siblings."""
    for level, here in enumerate(levels[:-1]):
        i = idx >> level
        other = here.get(i ^ 1, "")
        found = digest(other + found if i & 1 else found + other)
    return found


def prove(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """(key, leaf, subroot, proof, folded_root) of the given rows of manifest.leaves, all of them by default."""
    leaves, trees = manifest.leaves if leaves is None else leaves, manifest.trees

    def by_tree(rows):
        tree, idx, size = (rows.column(c).to_numpy() for c in ("tree", "idx", "size"))
        for t in np.unique(tree).tolist():
            at = np.flatnonzero(tree == t)
            yield t, int(size[at[0]]), at, idx[at]

    def ask(rows):
        part, held = rows.column("part")[0].as_py(), list(by_tree(rows))
        wanted = [(t, level, i) for t, size, _, idx in held for level, some in missing(idx, size) for i in some.tolist()]
        wanted += [(TOP, level, i) for level, some in missing(np.array([x[0] for x in held]), trees) for i in some.tolist()]
        tree, level, idx = zip(*wanted) if wanted else ((), (), ())
        return pa.table({"tree": pa.array(tree, pa.int64()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64()), "part": pa.array([part] * len(tree), pa.int64())})

    def expand(rows, answers):
        got: dict = {}
        for t, level, i, h in zip(*(answers.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
            got.setdefault(t, {}).setdefault(level, {})[i] = h
        leaf, claimed, held = rows.column("leaf").to_pylist(), rows.column("claimed").to_pylist(), []
        for t, size, at, idx in by_tree(rows):
            held.append((t, at, idx, interiors({i: leaf[p] for i, p in zip(idx.tolist(), at.tolist())}, size, got.get(t, {}))))
        over = interiors({t: levels[-1][0] for t, _, _, levels in held}, trees, got.get(TOP, {}))
        subroot, proof, folded = ([None] * rows.num_rows for _ in range(3))
        for t, at, idx, levels in held:
            above = siblings(over, t)
            for p, i in zip(at.tolist(), idx.tolist()):
                subroot[p], proof[p] = levels[-1][0], siblings(levels, i) + above
                folded[p] = fold_up(fold_up(claimed[p], i, levels), t, over)
        return pa.table({"key": rows.column("key"), "leaf": rows.column("leaf"), "subroot": pa.array(subroot, pa.string()), "proof": pa.array(proof, pa.list_(pa.string())), "folded_root": pa.array(folded, pa.string())})

    asked = leaves.select("tree", "idx", "size", "part").groupBy("part").applyInArrow(ask, "tree long, level int, idx long, part long")
    answers = asked.join(manifest.nodes.drop("size"), ["tree", "level", "idx"])
    kind = leaves.schema["key"].dataType.simpleString()
    return leaves.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(expand, f"key {kind}, leaf string, subroot string, proof array<string>, folded_root string")


def op11_merkle_octopus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof against the root; where 7 divides crc32(doc_id), one is added to n_chars before it is checked."""
    docs = table(spark, sf_dir, "documents")
    values = {c: docs[c] for c in FIELDS}
    more = values | {"n_chars": F.coalesce(F.try_add(docs["n_chars"], F.lit(1)), docs["n_chars"])}
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    rows = docs.select(docs["lang"].alias("name"), docs["doc_id"].alias("key"), leaf_of(*values.values()).alias("leaf"), F.when(tampered, leaf_of(*more.values())).alias("claimed"))
    manifest = build(materialise(rows.withColumn("claimed", F.coalesce("claimed", "leaf")), "merkle-rows"))
    found = prove(manifest).withColumn("root", F.lit(manifest.root).cast("string"))
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "case when {0} is null then '-' else octet_length(encode(cast({0} as varchar))) || ':' || cast({0} as varchar) end"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS)
_CHANGED = " || ".join(_FIELD.format(c if c != "n_chars" else "(n_chars + 1)") for c in FIELDS)
#: crc32 of the decimal digits, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(0, 8 * length(cast(doc_id as varchar))), lambda i: (ascii(substr(cast(doc_id as varchar), cast(i // 8 + 1 as bigint), 1)) >> cast(i % 8 as integer)) & 1)), lambda c, b: xor(c >> 1, case when xor(c, b) & 1 = 1 then 3988292384 else 0 end)))"
ORACLE_SQL = f"""
with recursive d as (
  select *, row_number() over () rid, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 idx, count(*) over (partition by lang) n, dense_rank() over (order by lang nulls first) - 1 tree
  from (select doc_id, lang, sha256({_LEAF}) leaf, case when {_CRC} % 7 = 0 then sha256({_CHANGED}) else sha256({_LEAF}) end claimed from documents)),
t as (
  select tree, 0 level, idx, leaf h, n from d
  union all
  select tree, level + 1, idx // 2, sha256(h || coalesce(beside, '')), (n + 1) // 2
  from (select *, lead(h) over (partition by tree order by idx) beside from t where n > 1) where idx % 2 = 0),
u as (
  select 0 level, tree idx, h, count(*) over () n from t where n = 1
  union all
  select level + 1, idx // 2, sha256(h || coalesce(beside, '')), (n + 1) // 2
  from (select *, lead(h) over (order by idx) beside from u where n > 1) where idx % 2 = 0),
step as (
  select tree, level, idx, h, n, false over_ from t where n > 1 union all select 0, level, idx, h, n, true from u where n > 1),
levels as (select tree, max(level) + 1 k from step where not over_ group by tree),
p as (
  select d.rid, l.level step, (d.idx >> cast(l.level as integer)) place, s.h sibling
  from d join (select distinct tree, level from step where not over_) l on l.tree = d.tree
  left join step s on not s.over_ and s.tree = d.tree and s.level = l.level and s.idx = xor(d.idx >> cast(l.level as integer), 1)
  union all
  select d.rid, coalesce(k, 0) + l.level, (d.tree >> cast(l.level as integer)) place, s.h
  from d left join levels on levels.tree = d.tree join (select distinct level from step where over_) l on true
  left join step s on s.over_ and s.level = l.level and s.idx = xor(d.tree >> cast(l.level as integer), 1)),
f as (
  select rid, 0 step, claimed h from d
  union all
  select f.rid, f.step + 1, sha256(case when p.place % 2 = 1 then p.sibling || f.h else f.h || coalesce(p.sibling, '') end) from f join p on p.rid = f.rid and p.step = f.step)
select d.doc_id, d.leaf, sub.h subroot, root.h root, sha256(coalesce(proof, '')) proof_sha256, last.h folded_root, last.h = root.h verified
from d join (select tree, h from t where n = 1) sub on sub.tree = d.tree cross join (select h from u where n = 1) root
left join (select rid, string_agg(sibling, '' order by step) proof from p group by rid) pr on pr.rid = d.rid
join (select rid, arg_max(h, step) h from f group by rid) last on last.rid = d.rid
"""

QUERIES = {"op11_merkle_octopus": op11_merkle_octopus}
ORACLES = {"op11_merkle_octopus": ORACLE_SQL}
