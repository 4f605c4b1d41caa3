"""Trigram profiles: accuracy on texts that weren't counted, small cases against plain counting, the plan."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import languages as G

SF = "/root/testdata/sf0.01"


def grams(text):
    t = " " + re.sub(r"[^\w]+|[\d_]+", " ", (text or "").lower()) + " "
    t = re.sub(" +", " ", t)
    return [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]


def test_accuracy_on_texts_that_were_not_counted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    profile = G.profiles(docs.where("doc_id % 2 = 0")).cache()
    rows = G.detect(docs.where("doc_id % 2 = 1 and n_chars > 100"), profile, ["lang"]).collect()
    assert sum(r["lang"] == r["language"] for r in rows) / len(rows) > 0.98
    german = [r for r in rows if r["lang"] == "de"]
    assert sum(r["confidence"] >= G.GATE and r["language"] == "de" for r in german) / len(german) > 0.97
    some = spark.createDataFrame([(1, "Das ist ein Text und nicht mehr als das"), (2, "This is a text and not more than that"), (3, None), (4, ""), (5, "12 34 !?"), (5, "12 34 !?")], "i int, text string")
    found = {r["i"]: (r["language"], r["german"]) for r in G.detect(some, profile, ["i"]).withColumn("german", G.is_german(F.col("language"), F.col("confidence"))).collect()}
    assert found == {1: ("de", True), 2: ("en", False), 3: ("unknown", False), 4: ("unknown", False), 5: ("unknown", False)}
    assert G.detect(some, profile, ["i"]).count() == 6


def test_profiles_and_scores_against_plain_counting(spark):
    texts = [("x", "Abc abd, ab"), ("x", "ábc 9 x"), ("y", "bcd bcd ab"), ("y", None), (None, "zzz zzz"), ("z", "qqq")]
    df = spark.createDataFrame(texts, "lang string, text string")
    counts = {}
    for lang, text in texts:
        if lang:
            counts.setdefault(lang, Counter()).update(grams(text))
    k = 3
    chosen = {g for c in counts.values() for g, _ in sorted(c.items(), key=lambda e: (-e[1], e[0]))[:k]}
    want = {(g, x): round(1000 * math.log((c[g] + 0.5) / c.total())) for g in chosen for x, c in counts.items()}
    profile = G.profiles(df, k)
    assert {(r["gram"], r["lang"]): r["weight"] for r in profile.collect()} == want
    for r in G.detect(df, profile, ["text"]).collect():
        scores = {x: sum(want[g, x] for g in grams(r["text"]) if g in chosen) for x in counts}
        if not any(g in chosen for g in grams(r["text"])):
            assert (r["language"], r["confidence"]) == ("unknown", 0.0)
            continue
        top = max(scores.values())
        assert r["language"] == min(x for x, s in scores.items() if s == top)
        assert abs(r["confidence"] - 1 / sum(math.exp((s - top) / 1000) for s in scores.values())) < 1e-9
    assert {r["language"] for r in G.detect(df, G.profiles(df.limit(0)), ["text"]).collect()} == {"unknown"}


def test_no_python_worker_and_one_row_a_text_leaves_a_task(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = G.detect(docs, G.profiles(docs), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "partial_sum" in plan
