"""Queries without SQL against brute force, and small cases of retrieval, claims, language, chains, writers and streams."""

import datetime
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import embedding
from tessera.functions import formatting as M
from tessera.functions import text as X
from tessera.functions.stem import stem
from tessera.operators import chains as H
from tessera.operators import claims as C
from tessera.operators import lexicon as L
from tessera.operators import retrieval as R
from tessera.operators import writers as W
from tessera.plans.text_queries import TERMS
from tessera.streaming import limiter, scan

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_stemmed_keywords_against_brute_force(spark):
    docs = {r["doc_id"]: Counter(stem(w) for w in re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = {w for w in re.findall(r"\w+", r["text"].lower()) if len(w) >= 3 and w not in X.QUERY_STOP_WORDS}
        tokens = {stem(w) for w in words}
        scored = sorted((-round(sum(0.4 * n[t] for t in tokens), 6), i) for i, n in docs.items() if any(t in n for t in tokens))
        want |= {(r["item_id"], i): (round(-s, 4), k + 1) for k, (s, i) in enumerate(scored[:8])}
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["rank"]) for r in catalogue.QUERIES["keyword_rank_stemmed"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-3 and got[k][1] == want[k][1] for k in want)


def test_highlights_against_brute_force(spark):
    got = {r["doc_id"]: r for r in catalogue.QUERIES["segments_highlight"](spark, SF).collect()}
    seen = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        spans = sorted((m.start(), m.end()) for t in TERMS for m in re.finditer(re.escape(t), text, re.IGNORECASE))
        if not spans:
            assert r["doc_id"] not in got
            continue
        seen, at, out, kept = seen + 1, 0, "", 0
        escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for a, b in spans:
            if a >= at:
                out, at, kept = out + escape(text[at:a]) + "<mark>" + escape(text[a:b]) + "</mark>", b, kept + 1
        assert (got[r["doc_id"]]["html"], got[r["doc_id"]]["n_kept"]) == (out + escape(text[at:]), kept)
    assert seen


def test_hashed_embeddings_against_brute_force(spark):
    texts = ["a b b", "", None, "Zink trägt zu x bei, zink"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, v in df.select("i", embedding.embed(F.col("t"))).collect():
        want = np.zeros(embedding.WIDTH)
        for w in re.findall(r"\w+", (texts[i] or "").lower()):
            h = zlib.crc32(w.encode())
            want[h % embedding.WIDTH] += 1 if (h >> 16) % 2 == 0 else -1
        assert np.allclose(v, want / (np.linalg.norm(want) or 1))


@pytest.mark.parametrize("most", [1000, 3])
def test_vector_search_against_brute_force(spark, monkeypatch, most):
    """In one pass and in several; nulls, wrong lengths and ties."""
    monkeypatch.setattr(R, "MAX_QUERIES", most)
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 5)).astype(float)
    passages = [(i, i % 3 if i % 7 else None, vectors[i].tolist()) for i in range(60)] + [(98, 1, None), (99, 1, [1.0])]
    queries = [(i, vectors[i * 2].tolist()) for i in range(10)] + [(77, None), (None, vectors[0].tolist())]
    p = spark.createDataFrame(passages, "chunk_id long, collection int, vector array<double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = Counter((r["query_id"], r["collection"], r["chunk_id"], r["rank"]) for r in R.vector_top_k(q, p, 4, 0.5).collect())
    want = Counter()
    for i, v in queries[:10]:
        for c in (0, 1, 2, None):
            found = sorted((-float(np.dot(v, vectors[j])), j) for j, k, _ in passages[:60] if k == c and np.dot(v, vectors[j]) >= 0.5)[:4]
            want.update((i, c, j, n + 1) for n, (_, j) in enumerate(found))
    assert got == want
    assert R.vector_top_k(q.limit(0), p).collect() == [] and R.vector_top_k(q, p.limit(0)).collect() == []


def test_claims_are_found_word_for_word(spark):
    long = "eins zwei drei vier fünf sechs sieben acht"
    docs = spark.createDataFrame([(1, f"x{long}y und"), (2, long.replace(" ", "  ")), (3, "kurz, ja"), (4, None), (5, f"{long} {long}")], "doc_id long, text string")
    claims = spark.createDataFrame([(1, f" {long} "), (2, "kurz"), (3, ""), (4, None), (5, "fehlt ganz und gar in allen diesen Texten")], "item_id long, claim_text string")
    found = C.locate(C.candidates(claims, docs), docs).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start"]) for r in found) == [(1, 1, 1), (3, 2, 0), (5, 1, 0)]


def test_claims_of_every_length_are_found(spark):
    """Cut anywhere from the texts, at word borders and inside words, against comparison with every text."""
    draw = np.random.default_rng(5)
    names = ["zink", "Ü", "a", "kupfer-salz", "x😀y", "und", "oder", "leber", "  "]
    texts = {i: " ".join(draw.choice(names, int(draw.integers(1, 40)))) + ("\n" if i % 3 else "") for i in range(40)}
    pieces = []
    for t in texts.values():
        for _ in range(4):
            a = int(draw.integers(0, len(t)))
            pieces.append(t[a : a + int(draw.integers(1, 60))])
    claims = [(i, p) for i, p in enumerate([*pieces, "a", "zin", "fehlt", "x" * 9, "kein solcher Text hier"])]
    docs = spark.createDataFrame([*texts.items(), (99, None), (98, "")], "doc_id long, text string")
    found = C.locate(C.candidates(spark.createDataFrame(claims, "item_id long, claim_text string"), docs), docs)
    got = {(r["doc_id"], r["item_id"], r["start"]) for r in found.collect()}
    want = {(d, i, t.index(p.strip(" "))) for d, t in texts.items() for i, p in claims if p.strip(" ") and p.strip(" ") in t}
    assert got == want and found.count() == len(want)
    plan = C.candidates(spark.createDataFrame(claims, "item_id long, claim_text string"), docs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_offsets_are_those_of_the_text(spark):
    docs = spark.createDataFrame([(1, "İİ License und LICENSE"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["start"], r["end"], r["spelled"]) for r in L.literal_spans(docs, ["license"]).orderBy("start").collect()] == [(3, 10, "License"), (15, 22, "LICENSE")]


def test_repairs_and_quotes_have_no_limit(spark):
    text = "é ü"
    for _ in range(4):
        broken = text.encode().decode("latin-1")
        assert one(spark, M.repair_mojibake(F.lit(broken))) == "é ü"
        text = broken
    assert one(spark, X.strip_wrapping_quotes(F.lit("„" * 9 + " x " + "“" * 9))) == "x"
    assert one(spark, X.strip_wrapping_quotes(F.lit("'"))) == "'"
    assert one(spark, X.normalise(F.lit("Ã¤ <i>b</i>"))) == "ä b"


def test_chains_keep_what_they_must(spark):
    docs = spark.createDataFrame([(1, "Heilt alles.\n\nGut."), (2, None), (3, "Ruhe")], "doc_id long, text string")
    found = H.detect(docs, lambda r: ['{"claims": [{"claim_text": "Heilt"}, {"claim_text": "fehlt"}, {"claim_text": "Heilt"}]}'] * len(r)).collect()
    assert [(r["doc_id"], r["term"], r["origin"]) for r in found] == [(1, "Heilt", "model")]
    problems = L.spans(docs)
    gone = {r["doc_id"]: r["text"] for r in H.smart_apply(docs, problems, lambda r: ['{"text": "Heilkraft"}'] * len(r)).collect()}
    assert gone[1] == "Gut." and gone[3] == "Ruhe"
    new = {r["doc_id"]: r["text"] for r in H.smart_apply(docs, problems, lambda r: [json.dumps({"text": "Heilkraft" if a == 1 else "Besser"}) for a in r["attempt"]]).collect()}
    assert new[1] == "Besser\n\nGut."
    kept = H.polish(docs, lambda r: ['{"text": "Heilt und lindert"}'] * len(r)).where("doc_id = 1").collect()[0]
    assert not kept["kept"] and kept["polished"] == "Heilt alles.\n\nGut."
    claims = spark.createDataFrame([(1, "health_based", "x")], "claim_id long, claim_type string, claim_text string")
    failed = H.evaluate(claims, lambda r: 1 / 0, lambda r: [None] * len(r)).collect()[0]
    assert (failed["status"], failed["version"]) == ("unclear", "1+fallback")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "x"), (None, 2, "x"), (1, 2, " ")], "user_id long, project_id long, input_text string")
    first, again = (W.persist(rows, "2024-01-01").collect() for _ in range(2))
    assert [r["id"] for r in first] == [r["id"] for r in again] and [r["warning"] for r in first] == [None, "persist_failed", "persist_failed"]
    path = f"file://{tmp_path}/t"
    assert W.ensure_table(spark, path, "a long, p string", "p").count() == 0 and W.ensure_table(spark, path, "a long, p string", "p").count() == 0
    vectors = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert W.of_width(vectors, "v", 2).count() == 2
    with pytest.raises(Exception, match="a vector has 2 numbers"):
        W.of_width(vectors, "v", 3).collect()
    W.export_csv(rows, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").count() == 3
    assert W.in_one({"a": rows, "b": rows}).groupBy("table").count().count() == 2


def test_limiter_on_many_interleaved_files(spark, tmp_path):
    """130 files whose times interleave over a month: one micro-batch, nothing is late."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", start + datetime.timedelta(minutes=(i * 7919) % 43200), i) for i in range(520)]
    path = f"file://{tmp_path}/hits"
    spark.createDataFrame(rows, "key string, ts timestamp, event_id long").repartition(130).write.parquet(path)
    hits = spark.read.parquet(path)
    scan.run_to_table(limiter.limited_stream(scan.read_stream(spark, path, hits.schema), 2, 3600), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {r["event_id"]: r["used"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {r["event_id"]: r["used"] for r in limiter.limited(hits, 2, 3600).collect()} and len(got) == 520


def test_prompt_block_names_each_example_once():
    hard, soft = L.prompt_block().split("\n")
    assert hard.startswith("hard: ") and soft.startswith("soft: ") and hard.count("Therapie") == 1 and "Entspannung" in soft
