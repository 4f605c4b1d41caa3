"""The Merkle manifest, centroid tables and the Voronoi join against brute force, and on odd rows."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, merkle, voronoi
from tests.compare import check

SF = "/root/testdata/sf0.001"
FLOATS = "vec_id long, embedding array<float>, label int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tables(tmp_path, **frames):
    """A folder of tables, as queries read them."""
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# Merkle manifest


def plain_leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


def plain_path(levels, i):
    """(sibling or none, whether it is on the left) for each level below the top."""
    found = []
    for below in levels[:-1]:
        j = i ^ 1
        found.append((below[j] if j < len(below) else "", j < i))
        i >>= 1
    return found


def plain_manifest(rows):
    """Rows of op11 for (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for name in names:
        ordered = sorted(((r[0] is not None, r[0] or 0, plain_leaf(r)), r) for r in groups[name]) if all(all(v is not None for v in r) for r in groups[name]) else sorted((((r[0] is not None, r[0] or 0, plain_leaf(r)), r) for r in groups[name]), key=lambda x: x[0])
        trees.append((plain_levels([k[2] for k, _ in ordered]), [r for _, r in ordered]))
    over, out = plain_levels([t[0][-1][0] for t in trees]), []
    for t, (levels, ordered) in enumerate(trees):
        for i, r in enumerate(ordered):
            path = plain_path(levels, i) + plain_path(over, t)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            found = plain_leaf((*r[:3], r[3] + 1, r[4]) if changed else r)
            for other, left in path:
                found = h(other, found) if left else h(found, other)
            out.append((r[0], plain_leaf(r), levels[-1][0], over[-1][0], h(*(s for s, _ in path)), found, found == over[-1][0]))
    return sorted(out, key=str)


def odd_documents(n=37):
    rows = [(i % 23 if i % 11 else None, ("a", None, "ü")[i % 3], (None, "de", "en", "en", "en", "é", "zz")[i % 7] if i else "alone", i if i % 5 else None, ("", None, "x😀" * i, "y")[i % 4]) for i in range(n)]
    return rows + [rows[4], rows[4], (7, "s", "en", 2**63 - 1, "t" * 100_000)]


@pytest.mark.parametrize("part, fold", [(8192, 12), (4, 1), (2, 2)])
def test_merkle_against_brute_force(spark, tmp_path, monkeypatch, part, fold):
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "FOLD", fold)
    rows = odd_documents()
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"leaf": F.lit(1), "tree": F.lit("x"), "_at": F.lit(2), "name": F.lit("n"), "key": F.lit("k")})
    found = merkle.op11_merkle_octopus(spark, tables(tmp_path, documents=df)).collect()
    # the largest long stays as it is: one more isn't a long
    wanted = plain_manifest([r if r[3] != 2**63 - 1 or zlib.crc32(b"7") % 7 else r for r in rows])
    assert sorted((tuple(r) for r in found), key=str) == wanted
    assert {r["verified"] for r in found} == {True, False}


def test_merkle_matches_sql(spark):
    check(merkle.op11_merkle_octopus, merkle.ORACLE_SQL, spark, SF)


def test_merkle_empty_and_single(spark, tmp_path):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.op11_merkle_octopus(spark, tables(tmp_path / "none", documents=spark.createDataFrame([], kind))).count() == 0
    row = (3, None, None, None, None)
    found = merkle.op11_merkle_octopus(spark, tables(tmp_path / "one", documents=spark.createDataFrame([row], kind))).collect()
    assert [tuple(r) for r in found] == [(3, plain_leaf(row), plain_leaf(row), plain_leaf(row), h(), plain_leaf(row), True)]


def test_octopus_asks_for_no_node_that_it_can_derive():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 7, 16, 33, 100):
        levels = plain_levels([h(str(i)) for i in range(size)])
        for known in (np.arange(size), np.array([size - 1]), np.unique(rng.integers(0, size, max(1, size // 3)))):
            asked = {(level, i) for level, some in merkle.missing(known, size) for i in some.tolist()}
            have = {(0, i) for i in known.tolist()}
            for level, nodes in enumerate(levels[:-1]):
                assert not asked & have
                have |= {(level + 1, i >> 1) for x, i in have if x == level}
            fetched = {}
            for level, i in asked:
                fetched.setdefault(level, {})[i] = levels[level][i]
            given = {i: levels[0][i] for i in known.tolist()}
            assert merkle.interiors(given, size, fetched)[-1] == {0: levels[-1][0]}
            for level, i in asked:  # and none can be left out
                with pytest.raises(KeyError):
                    less = {x: {j: v for j, v in some.items() if (x, j) != (level, i)} for x, some in fetched.items()}
                    found = merkle.interiors(given, size, less)[-1]
                    if found != {0: levels[-1][0]}:
                        raise KeyError
            if set(known.tolist()) == set(range(size)):
                assert not asked


def test_merkle_proves_some_rows_alone(spark):
    rows = spark.range(50).select((F.col("id") % 3).cast("string").alias("name"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf")).withColumn("claimed", F.col("leaf"))
    manifest = merkle.build(rows)
    whole = {r["key"]: r for r in merkle.prove(manifest).collect()}
    some = merkle.prove(manifest, manifest.leaves.where("key % 7 = 3")).collect()
    assert len(some) == 7 and all(r == whole[r["key"]] for r in some)
    assert {r["folded_root"] for r in some} == {manifest.root}


# centroids


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    text = lambda i: "" if i is None else str(i)
    middle = [v for _, v in sorted(kept, key=lambda r: (h("2:", text(r[0])), r[0] is not None, r[0] or 0, r[1]))][:k]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        of = [j for _, j in assign()]
        middle = [[sum(x) // len(own) for x in zip(*own)] if (own := [v for (_, v), o in zip(kept, of) if o == j]) else c for j, c in enumerate(middle)]
    last = assign()
    total = {}
    for d, j in last:
        total[j] = total.get(j, 0) + d
    return sorted(((i, j, d, total[j], sum(total.values()), h(",".join(map(str, middle[j])))) for (i, _), (d, j) in zip(kept, last)), key=str)


def odd_vectors(seed, n, width=64):
    rng = np.random.default_rng(seed)
    f = lambda v: np.asarray(v, np.float32).tolist()
    rows = [(i, f(rng.normal(size=width) / 8)) for i in range(n)]
    rows += [(n, f(np.ones(width) * 1000)), (n + 1, f(-np.ones(width) * 1e5)), rows[3], rows[3], (rows[3][0], rows[4][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(1, None), (2, []), (3, [None] * width), (4, f([np.nan] * width)), (5, f([np.inf] * width)), (6, f(np.ones(width + 1))), (100, f(np.ones(width // 2)))]
    return rows


@pytest.mark.parametrize("pairs, n", [(1 << 16, 150), (10, 60), (1 << 16, 20)])
def test_centroids_against_brute_force(spark, tmp_path, monkeypatch, pairs, n):
    monkeypatch.setattr(centroids, "TABLE_PAIRS", pairs)
    monkeypatch.setattr(centroids, "BLOCK", 16)
    rows = odd_vectors(1, n)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], FLOATS).withColumns({"v": F.lit("x"), "cluster": F.lit("x"), "distance": F.lit("x")})
    found = centroids.op12_centroid_tables(spark, tables(tmp_path, embeddings=df)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_clusters(rows)


def test_centroids_match_sql(spark):
    check(centroids.op12_centroid_tables, centroids.ORACLES["op12_centroid_tables"], spark, SF)


def test_centroids_of_nothing_and_of_too_much(spark, tmp_path):
    none = centroids.op12_centroid_tables(spark, tables(tmp_path / "none", embeddings=spark.createDataFrame([], FLOATS)))
    some = centroids.op12_centroid_tables(spark, SF)
    assert none.count() == 0 and [t for _, t in none.dtypes] == [t for _, t in some.dtypes] and none.columns == some.columns
    large = spark.createDataFrame([(1, [1e9] * 64, 0)], FLOATS)
    with pytest.raises(Exception, match="too large"):
        centroids.op12_centroid_tables(spark, tables(tmp_path / "large", embeddings=large)).collect()


# Voronoi join


def plain_top(rows, k=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(kept):
        if q is not None and q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(kept) if a != b)[:k]
            out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scores, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("group, rows_", [(8192, 1 << 16), (2, 16)])
def test_voronoi_against_brute_force(spark, tmp_path, monkeypatch, group, rows_):
    monkeypatch.setattr(voronoi, "GROUP_QUERIES", group)
    monkeypatch.setattr(voronoi, "SLICE_ROWS", rows_)
    monkeypatch.setattr(voronoi, "BLOCK_SCORES", 64)
    rows = [(i * 10, v) if i is not None and i < 120 else (i, v) for i, v in odd_vectors(5, 120, 16)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)]  # a hot vector: queries and ties
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], FLOATS).withColumns({"row": F.lit("x"), "query": F.lit("x"), "score": F.lit("x")})
    found = voronoi.op13_voronoi_topk(spark, tables(tmp_path, embeddings=df)).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_top(rows)


def test_voronoi_matches_sql(spark):
    check(voronoi.op13_voronoi_topk, voronoi.ORACLE_SQL, spark, "/root/testdata/sf0.01")


def test_voronoi_small_tables(spark, tmp_path):
    kind = "query_id long, rank int, vec_id long, score long"
    for name, rows in (("none", []), ("alone", [(0, [1.0], 0)]), ("unasked", [(1, [1.0], 0), (2, [1.0], 0)]), ("two", [(0, [1.0], 0), (7, [-2.0], 0)]), ("flat", [(0, [], 0), (100, [], 0), (5, [3.0], 0)])):
        df = voronoi.op13_voronoi_topk(spark, tables(tmp_path / name, embeddings=spark.createDataFrame(rows, FLOATS)))
        assert [f"{a} {b.replace('bigint', 'long')}" for a, b in df.dtypes] == kind.split(", ")
        assert sorted((tuple(r) for r in df.collect()), key=str) == plain_top([r[:2] for r in rows]), name


def test_voronoi_large_components_are_exact(spark, tmp_path):
    rows = [(i * 50, [float(2**18 + i), float(2**19 + 3 * i), -float(2**18 + 7)], 0) for i in range(12)]
    found = voronoi.op13_voronoi_topk(spark, tables(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain_top([r[:2] for r in rows])
    assert any(abs(r["score"]) > 1 << 53 for r in found)


def test_voronoi_leaves_far_cells_out(spark, tmp_path, monkeypatch):
    """Where vectors lie in bundles, a group of queries gets the bundles it needs and no others, and results are whole."""
    monkeypatch.setattr(voronoi, "GROUP_QUERIES", 4)
    rng = np.random.default_rng(2)
    middles = np.eye(32)
    rows = [(i * 20, (middles[i % 32] + rng.normal(size=32) * 0.005).astype(np.float32).tolist()) for i in range(1600)]
    sent = []
    slices = voronoi.dealt
    monkeypatch.setattr(voronoi, "dealt", lambda row, parts: (sent.append(len(row)), slices(row, parts))[1])
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], FLOATS)
    out = voronoi.op13_voronoi_topk(spark, tables(tmp_path, embeddings=df))
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_top(rows)
    joined = json.loads(json.dumps(out._jdf.queryExecution().executedPlan().toString()))
    assert "FlatMapCoGroupsInArrow" in joined
