"""Containment sweeps against comparison of all pairs."""

import random

import pytest

from tessera.operators import intervals as I

SPANS = "doc_id long, start int, end int, name long"


def held(spans, others):
    return {s for s in spans for o in others if s[0] is not None and s[0] == o[0] and None not in (*s[1:3], *o[1:3]) and o[1] <= s[1] and s[2] <= o[2]}


@pytest.mark.parametrize("width", [7, 4096])
def test_covered_against_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(I, "BIN", width)
    draw = random.Random(4)
    some = lambda n, most: [(draw.choice([1, 2, 2, 2, None]), a := draw.randrange(200), a + draw.randrange(most), i) for i in range(n)]
    inner, outer = some(300, 30), some(40, 60)
    inner += [(1, None, 4, 900), (1, 4, None, 901), inner[0]]
    outer += [(1, None, 500, 902), (1, 0, None, 903)]
    got = I.with_covered(spark.createDataFrame(inner, SPANS), spark.createDataFrame(outer, SPANS)).collect()
    want = held(inner, outer)
    assert sorted((repr(tuple(r)[:4]), r["covered"]) for r in got) == sorted((repr(s), s in want) for s in inner)
    assert I.with_covered(spark.createDataFrame(inner, SPANS), spark.createDataFrame([], SPANS)).where("covered").count() == 0


@pytest.mark.parametrize("width", [5, 4096])
def test_holder_against_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(I, "BIN", width)
    draw = random.Random(5)
    parts = []
    for doc in (1, 2):
        at = 0
        while at < 300:
            n = draw.randrange(1, 40)
            parts.append((doc, at, at + n, len(parts)))
            at += n + draw.randrange(3)
    spans = [(draw.choice([1, 2, 3, None]), a := draw.randrange(300), a + draw.randrange(25)) for _ in range(400)]
    got = I.with_holder(spark.createDataFrame(spans, "doc_id long, start int, end int"), spark.createDataFrame(parts, SPANS), "name").collect()
    want = [(*s, next((p[3] for p in parts if p[0] == s[0] and p[1] <= s[1] and s[2] <= p[2]), None)) for s in spans]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_text_with_many_spans_is_swept_not_paired(spark):
    """100,000 spans in one text: no join makes more rows than there are spans and bins."""
    inner = spark.range(100_000).selectExpr("1L doc_id", "cast(id as int) start", "cast(id + 3 as int) `end`")
    outer = spark.range(50_000).selectExpr("1L doc_id", "cast(id * 2 as int) start", "cast(id * 2 + 4 as int) `end`")
    found = I.with_covered(inner, outer)
    assert found.where("covered").count() == 100_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
