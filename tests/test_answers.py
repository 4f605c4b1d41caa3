"""Model answers are given once, whatever plans read them and however often; chains on a model that answers at random."""

import json
import random
import time
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import chains as H
from tessera.operators import lexicon as L
from tessera.sources import models
from tessera.sources.models import Answers


def either(*choices):
    return random.SystemRandom().choice(choices)


class Counting:
    """A model that writes down each request it gets, in a folder, and answers by a function of the request."""

    def __init__(self, folder, answer):
        self.folder, self.answer = str(folder), answer

    def __call__(self, requests):
        out = []
        for r in requests.to_dict("records"):
            Path(self.folder, uuid.uuid4().hex).write_text(json.dumps([str(r.get("claim_id", r.get("doc_id"))), int(r["attempt"])]))
            out.append(self.answer(r))
        return out

    def asked(self):
        return Counter(tuple(json.loads(p.read_text())) for p in Path(self.folder).iterdir())


@pytest.fixture
def counting(tmp_path):
    def make(answer):
        folder = tmp_path / uuid.uuid4().hex
        folder.mkdir()
        return Counting(folder, answer)

    return make


def claims(spark, n=100):
    return spark.range(n).select(F.col("id").alias("claim_id"), F.lit("health_based").alias("claim_type"), F.concat(F.lit("tut gut "), F.col("id").cast("string")).alias("claim_text")).repartition(5)


def test_evaluate_asks_each_claim_once_of_a_random_model(spark, counting):
    first = counting(lambda r: '{"status": "allowed", "confidence": 0.9}' if either(True, False) else None)
    second = counting(lambda r: '{"status": "forbidden", "confidence": 0.9}')
    found = H.evaluate(claims(spark), first, second)
    for _ in range(2):  # and reading the result again asks nothing
        rows = found.collect()
        assert sorted(r["claim_id"] for r in rows) == list(range(100))
    assert first.asked() == Counter({(str(i), 1): 1 for i in range(100)})
    again = {r["claim_id"] for r in rows if r["version"] == "1+fallback"}
    assert second.asked() == Counter({(str(i), 2): 1 for i in again}) and 10 < len(again) < 90
    assert all((r["status"] == "forbidden") == (r["claim_id"] in again) for r in rows)


def test_guarded_answers_and_polish_of_a_random_model(spark, counting):
    model = counting(lambda r: json.dumps({"rewrite": either("Ruhe.", "Heilkraft")}))
    rows = H.rewrite(claims(spark).withColumn("suggestion", F.when(F.col("claim_id") < 10, "da")), model).collect()
    assert sorted(r["claim_id"] for r in rows) == list(range(100))
    asked = model.asked()
    assert {k: v for k, v in asked.items() if k[1] == 1} == {(str(i), 1): 1 for i in range(10, 100)} and set(asked.values()) == {1}
    assert sum(r["rewrite"] is None for r in rows) <= sum(k[1] == 2 for k in asked)
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.lit("Ruhe").alias("text"))
    model = counting(lambda r: json.dumps({"text": either("Ruhe ok", "Heilkraft")}))
    rows = H.polish(docs, model).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(80)) and model.asked() == Counter({(str(i), 1): 1 for i in range(80)})
    assert all(r["polished"] == ("Ruhe ok" if r["kept"] else "Ruhe") for r in rows)


def test_detect_asks_each_text_once(spark, counting):
    docs = spark.createDataFrame([(i, f"Heilt {i}" if i % 2 else f"Gut {i}") for i in range(30)], "doc_id long, text string")
    model = counting(lambda r: json.dumps({"claims": [{"claim_text": r["text"][:3]}] if either(True, False) else []}))
    found = H.detect(docs, model).collect()
    assert model.asked() == Counter({(str(i), 1): 1 for i in range(30)})
    assert len({(r["doc_id"], r["term"], r["start"]) for r in found}) == len(found) and {i for i in range(30) if i % 2} <= {r["doc_id"] for r in found}


def test_a_table_is_gone_on_with(spark, counting, tmp_path):
    """What a broken run has written isn't asked again; new requests and equal ones are handled."""
    path = f"file://{tmp_path}/answers"
    rows = claims(spark, 40)
    broken = counting(lambda r: '{"rewrite": "a"}' if r["claim_id"] < 25 else (_ for _ in ()).throw(SystemExit("lost")))
    answers = Answers(spark, path, rounds=4)
    with pytest.raises(Exception):
        answers.ask(rows, broken, "rewrite")
    done = answers.table().count()
    model = counting(lambda r: '{"rewrite": "b"}')
    found = Answers(spark, path, rounds=4).ask(rows.unionByName(rows), model, "rewrite")
    assert found.count() == 80 and sum(model.asked().values()) == 40 - done
    assert found.where("output.rewrite is null").count() == 0
    more = Answers(spark, path).ask(claims(spark, 45), model, "rewrite")
    assert more.count() == 45 and sum(model.asked().values()) == 45 - done
    assert Answers(spark, path).ask(claims(spark, 45), model, "rewrite", 2).count() == 45 and sum(model.asked().values()) == 90 - done
    assert Answers(spark, path).ask(rows.limit(0), model, "rewrite").count() == 0


def test_failures_wait_and_overruns_are_cut(spark, tmp_path):
    import pandas as pd

    requests, calls = pd.DataFrame({"x": [1, 2]}), []

    def flaky(r):
        calls.append(time.perf_counter())
        if len(calls) < 3:
            raise OSError
        return ["a", "b"]

    assert models.tried(flaky, requests, 0.05) == (["a", "b"], None, 3)
    assert calls[1] - calls[0] >= 0.05 and calls[2] - calls[1] >= 0.1
    assert models.tried(lambda r: time.sleep(0.3) or ["a", "b"], requests, 0.0, 0.01) == ([None, None], "TimeoutError", 3)
    assert models.tried(lambda r: ["a"], requests, 0.0)[:2] == ([None, None], "ValueError")
    bad = models.call(spark.range(2), lambda r: ["{", '{"rewrite": "x"}'][: len(r)] * len(r), models.SCHEMAS["rewrite"]).collect()
    assert {r["error"] for r in bad} <= {"bad_json", None, "ValueError"}


def test_hints_are_verified_within_the_claim(spark):
    rows = spark.createDataFrame([(1, "health_based", "a"), (2, "health_based", "b"), (3, "disease_based", "heilt alles"), (4, "health_based", "c")], "claim_id long, claim_type string, claim_text string")
    evidence = spark.createDataFrame([(1, "k1", "http://one"), (2, "k2", None), (2, "k2", None)], "claim_id long, chunk_id string, url string")
    hints = [{"chunk_id": "k2", "reference": "r2", "rationale": "w"}, {"chunk_id": "k1", "reference": "r1", "rationale": "w"}, {"chunk_id": "k1", "reference": None, "rationale": "w"}, {"reference": "r0", "rationale": "w"}]
    model = lambda r: [json.dumps({"status": "allowed", "confidence": 0.9, "hints": hints if i != 4 else None}) for i in r["claim_id"]]
    found = {r["claim_id"]: [(h["reference"], h["verified"], h["chunk_id"], h["url"]) for h in r["hints"]] for r in H.evaluate(rows, model, model, evidence=evidence).collect()}
    assert found[1] == [("r2", False, None, None), ("r1", True, "k1", "http://one"), ("r0", False, None, None)]
    assert found[2] == [("r2", True, "k2", None), ("r1", False, None, None), ("r0", False, None, None)]
    assert [(v, c) for _, v, c, _ in found[3]] == [(False, None)] * 2 and found[4] == []


def test_smart_apply_outcomes_and_second_detection(spark, counting):
    docs = spark.createDataFrame([(1, "Heilt alles.\n\nGut."), (2, None), (3, "Ruhe"), (4, "Heilt.\n\nGut.")], "doc_id long, text string")
    silent = {r["doc_id"]: r["text"] for r in H.smart_apply(docs, L.spans(docs), lambda r: [None] * len(r)).collect()}
    assert silent[1] == "Heilt alles.\n\nGut."  # no answer: the paragraph stays
    gone = {r["doc_id"]: r["text"] for r in H.smart_apply(docs, L.spans(docs), lambda r: ['{"text": "[DROP_ROW]"}'] * len(r)).collect()}
    assert gone[1] == "Gut."
    after = spark.createDataFrame([(1, "Besser, lindert.\n\nGut."), (2, ""), (3, " Ruhe\n"), (4, "Neu.")], "doc_id long, text string")
    model = counting(lambda r: json.dumps({"claims": [{"claim_text": "Besser"}]}))
    found, told = H.residual(docs, after, model)
    assert sorted((r["doc_id"], r["term"]) for r in found.collect()) == [(1, "Besser"), (1, "lindert")]
    assert {r["doc_id"]: (r["changed"], r["checked"], r["n_residual"]) for r in told.collect()} == {1: (True, True, 2), 2: (False, True, 0), 3: (False, True, 0), 4: (True, True, 0)}
    assert model.asked() == Counter({("1", 1): 1, ("4", 1): 1})
    quick = Answers(spark, wait_s=0.0)
    found, told = H.residual(docs, after, lambda r: 1 / 0, answers=quick)
    assert found.count() == 0 and {r["doc_id"]: r["checked"] for r in told.collect()} == {1: False, 2: True, 3: True, 4: False}
