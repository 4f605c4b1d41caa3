"""The pipeline's deduplication against brute-force Jaccard over five-word shingles."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_copies, simhash


def components(sets):
    """Least id of each id's component; pairs are found through shingles, so it needs no cut."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter(p for ids in holders.values() for p in combinations(sorted(ids), 2))
    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: root(i) for i in sets}


def shingles(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def edited(rng, words, changes):
    words = list(words)
    for at in rng.integers(0, len(words), changes).tolist():
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stage_finds_all_that_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE_ROWS", 8)
    rng = np.random.default_rng(1)
    texts = {}
    for _ in range(25):
        words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        for _ in range(4):
            texts[len(texts)] = edited(rng, words, int(rng.integers(0, 6)))
        for _ in range(6):  # a chain: the ends are further apart than the links
            words = edited(rng, words, 2).split()
            texts[len(texts)] = " ".join(words)
    want = components({i: shingles(t) for i, t in texts.items()})
    kept = {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, frame(spark, texts), "").collect()}
    assert kept == set(want.values()) and 25 <= len(kept) < len(texts)


def test_rows_of_one_id_in_two_components_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "Q r s t u v w"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "k l m n o p"), (None, "k l m n o p"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("score", F.lit("x"))
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], (r["text"] or "")[:1]) for r in got.collect()) == Counter([(1, "a"), (1, "q"), (None, "k"), (3, "")])
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_one_row_of_each_component_whatever_the_ids(spark):
    one, two, three = "alpha beta gamma delta epsilon", "one two three four five six", "eins zwei drei vier"
    rows = [(5, two), (5, one), (3, two), (7, three), (None, one), (None, "solo"), (None, "solo"), (None, None), (8, ""), (8, "")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "x") for i, t in order], "doc_id long, text string, fp string").repartition(3)
        for drop in (near_copies.drop_near_copies, simhash.drop_near_duplicates):
            got = Counter((r["doc_id"], r["text"] or "") for r in drop(docs).collect())
            assert got == Counter([(5, one), (3, two), (7, three), (None, "solo"), (8, "")])
        assert near_copies.drop_near_copies(docs.limit(0)).collect() == []
