"""The incremental knowledge table: what is embedded, kept, removed and written, and search over it against plain ranking."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import embedding
from tessera.operators import knowledge_index as K
from tessera.plans.store_queries import knowledge_chunks

SF = "/root/testdata/sf0.001"
CHUNKS = "chunk_id string, source_type string, snippet string, reference string, url string, embedding_text string, metadata string"


def row(source, i, text):
    return (i, source, text, f"ref {i}", None, text, "{}")


@pytest.fixture
def counted(tmp_path):
    """An embedder that leaves a file for each batch it was given."""
    folder = tmp_path / "batches"
    folder.mkdir()
    at = str(folder)

    def embed(texts):
        import uuid

        Path(at, uuid.uuid4().hex).write_text(str(len(texts)))
        return K.hashed(texts)

    def sizes():
        found = sorted(int(p.read_text()) for p in folder.iterdir())
        for p in folder.iterdir():
            p.unlink()
        return found

    return embed, sizes


def done(df):
    return {r["source_type"]: (r["embedded"], r["kept"], r["removed"]) for r in df.collect()}


def test_only_changes_are_embedded_and_written(spark, tmp_path, counted):
    embed, sizes = counted
    path = f"file://{tmp_path}/kb"
    rows = [row("a", f"a{i}", f"zink {i}") for i in range(70)] + [row("b", "b1", "eisen"), row("b", "b2", None)]
    frame = lambda r: spark.createDataFrame(r, CHUNKS).coalesce(1)
    assert done(K.refresh(frame(rows), path, embed)) == {"a": (70, 0, 0), "b": (2, 0, 0)}
    assert max(sizes()) == K.BATCH
    files = lambda s: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "kb" / f"source_type={s}").iterdir()}
    before = files("a"), files("b")
    assert done(K.refresh(frame(rows), path, embed)) == {"a": (0, 70, 0), "b": (0, 2, 0)} and sizes() == []
    assert (files("a"), files("b")) == before
    rows[71] = row("b", "b2", "kupfer")
    assert done(K.refresh(frame([*rows[:71], rows[71], rows[71], (None, "b", "x", "", "", "", "")]), path, embed)) == {"a": (0, 70, 0), "b": (1, 1, 0)} and sizes() == [1]
    assert files("a") == before[0] and files("b") != before[1]
    assert done(K.refresh(frame([row("b", "b3", "neu"), rows[70]]), path, embed)) == {"b": (1, 1, 1)}
    assert files("a") == before[0] and sizes() == [1]
    table = K.read_table(spark, path)
    assert {(r["source_type"], r["chunk_id"]) for r in table.collect()} == {("a", f"a{i}") for i in range(70)} | {("b", "b1"), ("b", "b3")}
    assert all(np.allclose(r["vector"], K.hashed([r["embedding_text"] or ""])[0]) for r in table.collect())


def test_hashed_is_the_column_form(spark):
    texts = ["Zink trägt zu x bei, zink", "", "a b b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(embedding.embed(F.col("t")).alias("v")).collect()
    assert np.allclose([r["v"] for r in rows], K.hashed(texts))


def test_search_over_five_sources_against_plain_ranking(spark, tmp_path):
    path = f"file://{tmp_path}/kb"
    chunks = knowledge_chunks(spark, SF)
    report = done(K.refresh(chunks, path))
    assert len(report) == 4 and done(K.refresh(chunks, path)) == {s: (0, n, 0) for s, (n, _, _) in report.items()}
    table = K.read_table(spark, path)
    rows = [(f"{r['source_type']}/{r['chunk_id']}", r["source_type"], np.array(r["vector"]), r["reference"], r["snippet"]) for r in table.collect()]
    asked = [(1, "EU-Register Brand"), (2, "Curcuma longa EFSA"), (3, "BGH ZR 5 2018"), (4, "")]
    found = {}
    for r in K.search(table, spark.createDataFrame(asked, "query_id long, text string"), k=5, threshold=0.2).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["rrf"], 9)))
    for q, text in asked:
        v, score = np.array(K.hashed([text])[0], np.float32), {}
        rank = {}
        for number, source in enumerate(sorted({s for _, s, *_ in rows})):
            near = sorted((-round(float(v.astype(float) @ w.astype(float)), 12), i) for i, s, w, *_ in rows if s == source and float(v.astype(float) @ w.astype(float)) >= 0.2)[:8]
            for n, (_, i) in enumerate(near, 1):
                score[i] = score.get(i, 0) + 1 / (60 + n)
                rank.setdefault(i, (number, n))
        words = {w for w in re.findall(r"\w+", text.lower()) if len(w) >= 3 and w not in K.P.query_tokens.__globals__["QUERY_STOP_WORDS"]}
        count = lambda t: sum(re.findall(r"\w+", (t or "").lower()).count(w) for w in words)
        hits = sorted((-round(count(ref) + 0.4 * count(s), 6), i) for i, _, _, ref, s in rows if count(ref) + count(s))[:8]
        for n, (_, i) in enumerate(hits, 1):
            score[i] = score.get(i, 0) + 1 / (60 + n)
            rank.setdefault(i, (99, n))
        best = sorted(((-round(s, 9), rank[i], i) for i, s in score.items()))[:5]
        assert [(c, s) for _, c, s in sorted(found.get(q, []))] == [(i, -s) for s, _, i in best], q
