"""Every pipeline stage against a plain version of it, and the whole pipeline on odd tables."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
import public_tokenizers
from tessera.llm import mixing, pii_feistel, quality_cnn
from tests.llm.test_near_copies import components, shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The river runs past the old mill and the people of the town walk there in the evening, talking about the day and the weather. "
OTHER = " ".join(reversed(GOOD.split())) + " and so on until the very end of it all."
ODD = [
    *[(i, GOOD * 3 + f"Note {i} of the series.", "en", f"s{i % 2}", 400) for i in range(12)],
    (3, GOOD * 3 + "Another text with a repeated id.", "en", "s0", 400),
    (None, GOOD * 2 + "No id here, write to a.b@example.org or 4111111111111111.", "en", None, 300),
    (None, GOOD * 2 + "No id here, write to a.b@example.org or 4111111111111111.", "en", None, 300),
    (50, None, None, None, None),
    (51, "", "en", "s1", 0),
    (52, "Ä ß 😀 end. " * 3000, "de", "s1", 36000),
    *[(60, OTHER, "en", "s0", 200)] * 3,
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('odd')}"
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit("x"), "fp": F.lit(1), "pattern": F.lit("y"), "size": F.lit("z"), "n_pii": F.lit(2)})
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(12)] + [(51, 0, 0), (50, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('none')}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_odd_rows_pass_all_stages(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        before = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        docs = p.materialise(stage(spark, docs, odd_dir), name)
        assert docs.columns == list(p.COLUMNS)
        after = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        if name != "pseudonymise":
            assert all(after[k] <= 2 * before[k] for k in after)
        if name == "deduplicate":
            assert after[60, OTHER] == min(1, before[60, OTHER]) and all(n == 1 for n in after.values())
        if name == "pseudonymise":
            assert not any("example.org" in (t or "") or "4111111111111111" in (t or "") for _, t in after)
    assert p.run(spark, odd_dir).count() == docs.count()


def test_empty_tables(spark, empty_dir):
    assert p.run(spark, empty_dir).collect() == []


def test_stages_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_cnn.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    scores = {i: float(quality_cnn.score_texts(model, [(r["text"] or "").encode()])[0]) for i, r in rows.items()}
    docs = p.materialise(p.quality(spark, docs, SF), "q")
    kept = {r["doc_id"] for r in docs.collect()}
    assert all((i in kept) == (s >= quality_cnn.KEEP_SCORE) for i, s in scores.items() if abs(s - quality_cnn.KEEP_SCORE) > 1e-4)

    want = components({i: shingles(rows[i]["text"] or "") for i in kept})
    docs = p.materialise(p.deduplicate(spark, docs, SF), "d")
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, root in want.items() if i == root}

    changed = {r["doc_id"]: r["text"] for r in pii_feistel.pseudonymise(docs, pii_feistel.EXAMPLE_KEY).collect()}
    docs = p.materialise(p.pseudonymise(spark, docs, SF), "p")
    for r in docs.collect():
        assert r["text"] == changed[r["doc_id"]] and (r["text"] == rows[r["doc_id"]]["text"] or r["n_chars"] == len(r["text"]))

    size, source = Counter(), {}
    for r in docs.collect():
        size[r["doc_id"]], source[r["doc_id"]] = len((r["text"] or "").split()), r["source"]
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    target = mixing.targets(dict(total))
    docs = p.materialise(p.mix(spark, docs, SF), "m")
    times = Counter(r["doc_id"] for r in docs.collect())
    taken = Counter()
    for i, n in times.items():
        taken[source[i]] += n * size[i]
    assert max(times.values()) <= 2 and sum(taken.values()) > 0.9 * sum(target.values())
    assert all(abs(taken[s] - t) <= max(60, 0.1 * t) for s, t in target.items() if total[s] > 2000)

    tool = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tool.no_truncation(), tool.no_padding()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want_rows: Counter = Counter()
    for (i, t), n in texts.items():
        ids = tool.encode(t or "", add_special_tokens=False).ids
        want_rows[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in p.encode(spark, docs, SF).collect()) == want_rows
    assert math.isclose(sum(want_rows.values()), docs.count())
