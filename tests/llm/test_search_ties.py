"""Searches in which ties and repeated ids decide."""

import random

import numpy as np

from terraspark.llm import search


def test_copies_over_shards_tie(spark, monkeypatch):
    """More than k copies of each text over several shards, the smallest ids last: these are the ones to be found."""
    monkeypatch.setattr(search, "MOST_DOCS", 150)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(rng.choice([5, 10, 30]))) for _ in range(30)]
    rows = [(1800 - i, texts[i % 30]) for i in range(1800)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = [tuple(r) for r in search.search(df, df.where("doc_id % 10 = 0")).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.undo()
    of = {}
    for i, t in rows:
        of.setdefault(t, []).append(i)
    want = {i: sorted(of[t])[:10] for i, t in rows if i % 10 == 0}
    for q, ids in want.items():
        assert [d for _, _, d, _ in sorted(r for r in got if r[0] == q)] == ids
    assert len(got) == 10 * len(want)


def test_a_tie_with_the_threshold_is_found():
    """A document whose exact score is the threshold itself."""
    rng = np.random.default_rng(2)
    for words in (5, 10, 30):
        for _ in range(50):
            n, terms = 64, np.arange(words, dtype=np.int64)
            lens = rng.integers(20, 300, n).astype(float)
            shard = search.Shard(list(range(n)), terms, np.arange(words + 1), np.zeros(words, np.int32), rng.integers(1, 6, words).astype(np.int32), 1.2 * (0.25 + 0.75 * lens / 120))
            idf = rng.uniform(3, 9, words)
            (_, score), = shard.search(terms, idf, 1)
            assert shard.search(terms, idf, 1, score) == [(0, score)]


def test_rows_of_one_id_ask_together(spark):
    rows = [(50, "alpha beta"), (50, "gamma"), (50, "gamma"), (1, "alpha one"), (2, "gamma two"), (3, "delta")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in search.search(df, df.where("doc_id = 50")).collect()]
    assert {d for _, _, d, _ in got} == {50, 1, 2}
    # As one row of all their words asks.
    one = spark.createDataFrame([(50, "alpha beta gamma")], "doc_id long, text string")
    assert sorted(got) == sorted(tuple(r) for r in search.search(df, one).collect())
