"""The rest of a source is filled from all of its documents, also where very long ones lie at the cut."""

import json

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import mixing


def greedy(rows, rest):
    taken = set()
    for _, i, size in sorted(rows):
        if 0 < size <= rest:
            rest -= size
            taken.add(i)
    return taken, rest


def test_rest_is_one_pass_in_the_seeded_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(2)
    for seed in range(3):  # long documents are first in some seeds and at the cut in others
        sizes = [*rng.integers(10, 30, 600).tolist(), 9000, 7000, 5000, 3000]
        docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
        decided, *_, flow = mixing.decide(docs.repartition(3), F.array(F.lit("s")), seed)
        rest = sum(flow.values()) % sum(sizes)
        draws = {r["doc_id"]: r["d"] for r in docs.select("doc_id", mixing.draw(mixing.row_key(F.col("doc_id"), F.array(F.lit("s")), F.col("text")), seed).alias("d")).collect()}
        want, left = greedy([(draws[i], i, n) for i, n in enumerate(sizes)], rest)
        got = {r["doc_id"] for r in decided.collect() if r["copies"] == 2}
        assert got == want and left < 10
        repeated = mixing.repeat_to_weights(docs, F.array(F.lit("s")), seed).groupBy("doc_id").count().where("count = 2").collect()
        assert {r["doc_id"] for r in repeated} == want


def test_rows_with_one_id_are_taken_one_by_one(spark):
    """Two sources; in one all ids are null and many rows are equal, in the other ids repeat."""
    rows = [(None, f"n{i % 40} w w w", "b") for i in range(200)] + [(i % 7, f"t{i} " * 5, "a") for i in range(100)] + [(None, None, "b")] * 5 + [(3, "", None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()
    sources = F.array("source")
    taken, sizes, wanted, _ = mixing.mix(docs, sources)
    words = {s: 0 for s in sizes}
    for r in mixing.repeat_to_weights(docs, sources).collect():
        words[r["source"]] += len((r["text"] or "").split())
    assert words == {s: sum(r["copies"] * r["size"] for r in taken.collect() if r["pattern"] == json.dumps([s], separators=(",", ":"))) for s in sizes}
    for s in sizes:
        assert 0 <= wanted[s] - words[s] < 6
    assert mixing.repeat_to_weights(docs.limit(0), sources).collect() == []
