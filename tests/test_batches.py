"""How much of an Arrow batch the functions of tasks hold as Python objects at once."""

import pyarrow as pa

from tessera.operators import chains, postings
from tessera.sources import models, regulation


class Frame:
    """Takes the function that a plan would run in its tasks."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):
        return function

    mapInPandas = mapInArrow


def test_a_call_takes_a_bounded_part_of_a_batch(spark):
    seen = []
    run = models.asked(Frame(spark.range(0).schema), lambda r: seen.append(r["id"].tolist()) or [None if i % 2 else str(i) for i in r["id"]])
    out = pa.Table.from_batches(list(run([pa.record_batch({"id": pa.array(range(1300), pa.int64())})])))
    assert [len(s) for s in seen] == [500, 500, 300] and sum(seen, []) == list(range(1300))
    assert out.to_pydict() == {"id": list(range(1300)), "raw": [None if i % 2 else str(i) for i in range(1300)], "error": [None] * 1300, "attempts": [1] * 1300}


def test_pages_are_parsed_a_bounded_part_at_a_time(spark):
    run = regulation.paragraphs(Frame(spark.range(0).withColumnRenamed("id", "page_id").schema))
    html = [None if i == 7 else '<p class="a">x</p><p>y</p><p class="b">z' * (i % 3) for i in range(1300)]
    out = list(run([pa.record_batch({"page_id": pa.array(range(1300), pa.int64()), "html": pa.array(html, pa.string())})]))
    assert [len(set(b.column(0).to_pylist())) for b in out] == [sum(i % 3 > 0 and i != 7 for i in range(a, min(a + 500, 1300))) for a in (0, 500, 1000)]
    want = [(i, s, *((("a", "x"), ("b", "z"))[s % 2])) for i in range(1300) if i != 7 for s in range(2 * (i % 3))]
    assert [tuple(r.values()) for r in pa.Table.from_batches(out).to_pylist()] == want


def test_chunks_of_a_shard():
    assert postings.RUN * postings.SHARD <= 1 << 14


def test_polish_reads_its_answers_once(spark):
    docs = spark.createDataFrame([(1, "Gut."), (2, "Heilkraft"), (3, "Ruhe"), (4, None)], "doc_id long, text string")
    says = {1: '{"text": "Heilkraft"}', 2: '{"text": "Heilkraft ok"}', 3: None, 4: '{"text": "x"}'}
    out = chains.polish(docs, lambda r: [says[i] for i in r["doc_id"]])
    assert {r["doc_id"]: (r["polished"], r["kept"]) for r in out.collect()} == {1: ("Gut.", False), 2: ("Heilkraft ok", True), 3: ("Ruhe", False), 4: ("x", True)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
