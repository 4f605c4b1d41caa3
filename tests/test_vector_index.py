"""The approximate index: recall measured against all vectors, exact scores, lists of any size, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vector_index as I

VECTORS = "chunk_id long, collection int, vector array<double>"


def first(df):
    return {(r["query_id"], r["collection"], r["chunk_id"]): round(r["score"], 9) for r in df.collect()}


def built(spark, tmp_path, passages, **more):
    book = I.fit(passages, **more)
    return I.write_index(passages, book, f"file://{tmp_path}/index"), book


def test_recall_on_the_given_vectors(spark, tmp_path):
    """Every id divisible by 20 against all rows: 0.9 or more of the first eight, by collection and over all."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    for n, collection in enumerate((F.lit(0), F.col("label"))):
        passages = table.select(F.col("vec_id").alias("chunk_id"), collection.alias("collection"), F.col("embedding").alias("vector"))
        index, book = built(spark, tmp_path / str(n), passages)
        assert index.count() == passages.count()
        queries = passages.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
        want = first(I.search(index, book, queries, exact=True))
        got = first(I.search(index, book, queries))
        assert len(set(got) & set(want)) >= 0.9 * len(want)
        assert all(got[k] == want[k] for k in set(got) & set(want))  # scores are exact


def test_all_lists_and_all_candidates_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "MAX_QUERIES", 4)
    monkeypatch.setattr(I, "BLOCK_SCORES", 50)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(200, 10))
    rows = [(i, i % 2 if i % 9 else None, v.tolist()) for i, v in enumerate(vectors)] + [(500 + i, 1, vectors[0].tolist()) for i in range(150)] + [(900, 1, None), (901, 1, [1.0]), (902, 1, [1.0] * 11)]
    passages = spark.createDataFrame(rows, VECTORS).repartition(3)
    index, book = built(spark, tmp_path, passages, lists=7, parts=4)
    assert book.words.shape[0] == 4 and index.count() == 350
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 60, 5)] + [(77, None), (78, [1.0]), (None, vectors[0].tolist())], "query_id long, vector array<double>")
    for threshold in (None, 0.5):
        want = first(I.search(index, book, queries, exact=True, threshold=threshold))
        assert want and first(I.search(index, book, queries, probes=7, keep=400, threshold=threshold)) == want
    assert I.search(index, book, queries.limit(0)).count() == 0


def test_bundled_vectors_need_few_lists(spark, tmp_path):
    """Where vectors lie in bundles, one list of many finds what all find, and the others aren't read."""
    rng = np.random.default_rng(3)
    rows = [(i, 0, (np.eye(16)[i % 16] + rng.normal(size=16) * 0.02).tolist()) for i in range(640)]
    passages = spark.createDataFrame(rows, VECTORS)
    index, book = built(spark, tmp_path, passages, lists=16, parts=4)
    queries = passages.where("chunk_id = 32").select(F.col("chunk_id").alias("query_id"), "vector")
    few, want = I.search(index, book, queries, probes=2), first(I.search(index, book, queries, exact=True))
    assert first(few) == want
    read = I.candidates(index, book, [32], np.array([rows[32][2]]), queries.schema["query_id"], 2, 100)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in read or "list#" in read.split("PartitionFilters:")[1][:40]
    assert "vector" not in read.split("ReadSchema:")[1][:200]


def test_nothing_to_index(spark):
    assert I.fit(spark.createDataFrame([(1, 0, None)], VECTORS)) is None


@pytest.mark.parametrize("rows", [1, 3])
def test_fewer_vectors_than_lists(spark, tmp_path, rows):
    passages = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(rows)], VECTORS)
    index, book = built(spark, tmp_path, passages)
    found = first(I.search(index, book, passages.select(F.col("chunk_id").alias("query_id"), "vector")))
    assert len(found) == rows * rows


@pytest.mark.parametrize("size", [1, 7, 400])
def test_best_over_batches_is_best_of_all(size):
    draw = np.random.default_rng(3)
    score, ids = draw.integers(0, 40, (5, 400)).astype(float), draw.permutation(400)
    held = I.Best(5, 8)
    for a in range(0, 400, size):
        at = a + np.argsort(ids[a : a + size])
        held.add(np.arange(5), score[:, at], ids[at], at)
    want = [sorted(range(400), key=lambda i: (-score[q, i], ids[i]))[:8] for q in range(5)]
    assert held.place.tolist() == want
