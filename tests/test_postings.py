"""The stored inverted index against brute force, what it skips, and when it is made anew; vector search with odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import postings as P
from tessera.operators import retrieval as R

WORDS = ["zink", "kupfer", "haut", "knochen", "vitamin", "ruhe", "energie", "herz", "leber", "muskel"]


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def best(queries, chunks, k):
    out = set()
    for q, text in queries:
        asked = {t for t in tokens(text) if len(t) >= 3 and t not in X.QUERY_STOP_WORDS}
        scored = []
        for i, reference, snippet in chunks:
            s = sum(tokens(reference).count(t) + 0.4 * tokens(snippet).count(t) for t in asked)
            if s:
                scored.append((-round(s, 6), i is not None, i))
        out |= {(q, i, n + 1, round(-s, 4)) for n, (s, _, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("run, shard, queries", [(1024, 64, 10_000), (5, 2, 10_000), (3, 1, 2)])
def test_index_against_brute_force(spark, monkeypatch, tmp_path, run, shard, queries):
    for name, value in (("RUN", run), ("SHARD", shard), ("MAX_QUERIES", queries)):
        monkeypatch.setattr(P, name, value)
    draw = random.Random(run)
    some = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    chunks = [(i, some(draw.randrange(3)), some(draw.randrange(12))) for i in range(80)] + [(None, "zink", None), (200, None, None), (201, "", "Zink ZINK, zink_x Ünïcode"), (202, "herz " * 500, "herz")]
    asked = [(i, some(4)) for i in range(6)] + [(7, None), (8, "und die"), (9, "fehlt"), (10, "Ünïcode")]
    c = spark.createDataFrame(chunks, "chunk_id long, reference string, snippet string").repartition(3)
    q = spark.createDataFrame(asked, "query_id long, text string")
    P.write_index(c, f"file://{tmp_path}/i")
    index = P.read_index(spark, f"file://{tmp_path}/i", c.schema["chunk_id"].dataType)
    got = {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 4)) for r in R.keyword_top_k(q, index, 4).collect()}
    assert got == best(asked, chunks, 4)
    shards = index.select(F.floor(F.col("run") / shard)).distinct().count()
    assert P.search(index, q, 4).count() <= 4 * shards * len(asked)
    assert P.search(index, q.limit(0), 4).count() == 0


def test_index_of_nothing_and_of_names(spark, tmp_path):
    kind = "chunk_id string, reference string, snippet string"
    q = spark.createDataFrame([("a", "zink herz")], "query_id string, text string")
    for name, rows, want in (("none", [], []), ("two", [("x", "zink", ""), ("y", "", "herz")], [("a", "x", 1), ("a", "y", 2)])):
        path = f"file://{tmp_path}/{name}"
        P.write_index(spark.createDataFrame(rows, kind), path)
        index = P.read_index(spark, path, spark.createDataFrame([], kind).schema["chunk_id"].dataType)
        assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in R.keyword_top_k(q, index).orderBy("rank").collect()] == want


def test_runs_under_the_kth_score_are_not_scored(spark, monkeypatch):
    """One run holds the best chunks; the others' bounds are lower, so they are left alone."""
    monkeypatch.setattr(P, "RUN", 10)
    rows = [(i, "", "zink " * (50 if 30 <= i < 40 else 2)) for i in range(100)]
    chunks = spark.createDataFrame(rows, "chunk_id long, reference string, snippet string").coalesce(1)
    shard = P.Shard(P.index_rows(chunks).toArrow())
    assert [i for _, i in shard.top(["zink"], 5)] == [30, 31, 32, 33, 34] and shard.scored == 1
    assert [i for _, i in shard.top(["zink"], 15)] == [*range(30, 40), *range(5)] and shard.scored == 1 + 10
    assert shard.top(["fehlt"], 5) == []


def test_kept_index_is_made_once_for_the_same_files(spark, tmp_path, monkeypatch):
    made = []
    write = P.write_index
    monkeypatch.setattr(P, "write_index", lambda *a: (made.append(1), write(*a)))
    source = f"file://{tmp_path}/t"
    rows = lambda n: spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("zink").alias("snippet"))
    field = {"snippet": 0.4}
    rows(5).write.parquet(source)
    assert P.kept_index(spark.read.parquet(source), source, field).where("token = 'zink'").select(F.size("places")).first() is not None
    P.kept_index(spark.read.parquet(source), source, field)
    assert len(made) == 1
    P.kept_index(spark.read.parquet(source), source, {"snippet": 1.0})
    assert len(made) == 2
    rows(7).write.mode("overwrite").parquet(source)
    index = P.kept_index(spark.read.parquet(source), source, field)
    assert len(made) == 3 and index.where("token = 'zink'").agg(F.sum(F.size("places"))).first()[0] == 7


def test_one_odd_query_changes_nothing(spark, monkeypatch):
    """A longer query used to be taken for the width of all vectors; sets of any size give the same rows."""
    p = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(6)] + [(9, 0, [1.0] * 5)], "chunk_id long, collection int, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)] + [(50, [1.0, 1.0, 1.0]), (51, [1.0] * 5)], "query_id long, vector array<double>")
    rows = lambda: sorted(tuple(r) for r in R.vector_top_k(q, p, 3, None).collect())
    whole = rows()
    assert len(whole) == 24 and {r[0] for r in whole} == set(range(8))
    monkeypatch.setattr(R, "MAX_QUERIES", 3)
    monkeypatch.setattr(R, "BLOCK_SCORES", 7)
    assert rows() == whole
    assert R.vector_top_k(q, p, 3, None, width=5).count() == 1
